"""Repeated passages by compressed FM-indexes of shards.

Any two equal windows of WINDOW words share the smallest hash of their runs of ANCHOR words.
Documents are cut into segments, the stretches of windows with one such anchor, and equal
segments become one. Segments whose anchor occurs in several documents go to the shard of
their anchor, so equal windows always meet in one shard and a shard is read once, not by every
document. A shard's FM-index is a wavelet matrix of the Burrows-Wheeler transform over symbols
of STEP consecutive words. Each segment's windows are searched backward, symbol by symbol,
giving matching statistics up to the window's length and the smallest document that matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm.common import table, written
from filigree.llm.near_dedup import ODD, U64, WordHashes, mix

WINDOW, ANCHOR, STEP = 50, 8, 25
#: Windows of one segment at most, which bounds a row; words of a shard, about.
LONGEST, SHARD_WORDS = 1024, 300_000


def runs_hash(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` values."""
    out = np.full(len(h) - width + 1, U64(width))
    for i in range(width):
        out = mix(out * ODD[0] + h[i : i + len(out)])
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values, by doubling."""
    size, out = 1, x
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def segments(h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each segment of a document's word hashes."""
    if len(h) < window:
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    low = sliding_min(runs_hash(h, anchor), window - anchor + 1)
    change = np.flatnonzero(low[1:] != low[:-1]) + 1
    starts = np.concatenate([[0], change])
    ends = np.concatenate([change, [len(low)]])
    if (ends - starts).max() > LONGEST:
        starts = np.concatenate([np.arange(a, b, LONGEST) for a, b in zip(starts, ends, strict=True)])
        ends = np.concatenate([starts[1:], [len(low)]])
    return low[starts], starts, ends - starts


class WaveletMatrix:
    """Rank of any symbol in a sequence, a bit vector with counts for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        start, at = np.zeros_like(at), at.copy()
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            s1, a1 = ones[start], ones[at]
            start = np.where(bit, zeros + s1, start - s1)
            at = np.where(bit, zeros + a1, at - a1)
        return at - start


class FMIndex:
    """FM-index over chains of symbols: place p is followed by place p + step of its segment.

    Suffixes are sorted as deep as the longest pattern, `depth` symbols, which is all that
    backward search of such patterns needs.
    """

    def __init__(self, symbols: np.ndarray, segment_of: np.ndarray, step: int, depth: int):
        n = len(symbols)
        place = np.arange(n)
        columns = []
        for d in range(depth):
            after = place + d * step
            inside = (after < n) & (segment_of[np.minimum(after, n - 1)] == segment_of)
            columns.append(np.where(inside, symbols[np.minimum(after, n - 1)], 0))
        self.order = np.lexsort(columns[::-1])
        before = self.order - step
        inside = (before >= 0) & (segment_of[np.maximum(before, 0)] == segment_of[self.order])
        last = np.where(inside, symbols[np.maximum(before, 0)], 0)  # 0: nothing before
        top = int(symbols.max())
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        self.matrix = WaveletMatrix(last, top)

    def search(self, patterns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that start with each pattern; patterns[d] has the d-th symbols."""
        c = patterns[-1]
        low, high = self.less[c], self.less[c + 1]
        for c in reversed(patterns[:-1]):
            low = self.less[c] + self.matrix.rank(c, low)
            high = self.less[c] + self.matrix.rank(c, high)
        return low, high


def earliest(segs: list[np.ndarray], docs: np.ndarray, window: int, step: int) -> list[np.ndarray]:
    """For each segment's windows, the smallest document of the shard with the same window."""
    lengths = np.array([len(s) + 1 for s in segs])  # with a place for what follows the last symbol
    segment_of = np.repeat(np.arange(len(segs)), lengths)
    flat = np.concatenate([x for s in segs for x in (s, np.zeros(1, U64))])
    # a symbol for each place whose next `step` words lie in its segment
    hashed = runs_hash(np.concatenate([flat, np.zeros(step, U64)]), step)[: len(flat)]
    ends = np.cumsum(lengths) - 1
    whole = np.arange(len(flat)) + step <= ends[segment_of]
    symbols = np.zeros(len(flat), np.int64)
    symbols[whole] = np.unique(hashed[whole], return_inverse=True)[1] + 1
    index = FMIndex(symbols, segment_of, step, window // step)
    starts = np.flatnonzero(np.arange(len(flat)) + window <= ends[segment_of])
    low, high = index.search([symbols[starts + d * step] for d in range(window // step)])
    # patterns as long as the sorting is deep have ranges that don't overlap
    first, which = np.unique(low, return_inverse=True)
    last = np.zeros(len(first), np.int64)
    last[which] = high
    owner = docs[segment_of[index.order]]
    bounds = np.stack([first, last], 1).ravel()
    least = np.minimum.reduceat(np.append(owner, np.iinfo(np.int64).max), bounds)[::2]
    counts = np.bincount(segment_of[starts], minlength=len(segs))
    return np.split(least[which], np.cumsum(counts)[:-1])


def anchored(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """The segments of every document: anchor, a hash of the words, and where they lie."""

    key = docs.schema["doc_id"].dataType.simpleString()
    kind = np.int64 if key == "bigint" else object

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                found = (text or "").encode("utf-8", "replace").split()
                h = np.fromiter(map(words.__getitem__, found), U64, len(found))
                a, start, count = segments(h, window, anchor)
                raw = memoryview(h).cast("B") if len(h) else b""
                content = [xxhash.xxh3_64_intdigest(raw[8 * s : 8 * (s + n + window - 1)]) for s, n in zip(start.tolist(), count.tolist(), strict=True)]
                out.append((np.full(len(a), doc_id, kind), a.astype(np.int64), np.array(content, U64).astype(np.int64), start, count))
                if len(out) >= 2000:
                    yield pd.DataFrame(dict(zip(("doc_id", "anchor", "content", "start", "n"), map(np.concatenate, zip(*out, strict=True)), strict=True)))
                    out = []
            if out:
                yield pd.DataFrame(dict(zip(("doc_id", "anchor", "content", "start", "n"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return docs.where("doc_id is not null").select("doc_id", "text").mapInPandas(run, f"doc_id {key}, anchor long, content long, start int, n int")


def repeated_spans(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, step: int = STEP) -> DataFrame:
    """(doc_id, spans): stretches of words, [start, end), covered by windows that an earlier document has.

    Windows are `window` words, a multiple of `step`. Spans of one document may overlap. doc_id may be of any type that has an order.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    cut = written(anchored(docs, window, anchor))
    several = cut.groupBy("anchor").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).where("d0 < d1").select("anchor")
    shared = written(cut.join(several, "anchor"))
    key = ["anchor", "content", "n"]
    reps = shared.groupBy(*key).agg(F.min("doc_id").alias("first"), F.min_by("start", "doc_id").alias("at"))
    by_doc = reps.groupBy("first").agg(F.collect_list(F.struct("at", *key)).alias("cuts"))  # bounded by the document
    words_in = shared.agg(F.sum(F.col("n") + window)).first()[0] or 0
    shards = max(1, -(-words_in // SHARD_WORDS))

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for first, text, cuts in zip(pdf["first"], pdf["text"], pdf["cuts"], strict=True):
                words = (text or "").encode("utf-8", "replace").split()
                rows += [(c["anchor"], c["content"], c["n"], first, b" ".join(words[c["at"] : c["at"] + c["n"] + window - 1])) for c in cuts]
            yield pd.DataFrame(rows, columns=["anchor", "content", "n", "first", "words"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = WordHashes()
        segs = [np.fromiter(map(hashes.__getitem__, w), U64, len(w)) for w in map(bytes.split, pdf["words"])]
        places = np.unique(pdf["first"].to_numpy(), return_inverse=True)[1]  # ids of any type, in their order
        found = earliest(segs, places, window, step)
        early = []
        for least, first in zip(found, places, strict=True):
            on = np.flatnonzero(least < first)
            cuts = np.flatnonzero(np.diff(on) > 1)
            early.append([{"a": int(a), "b": int(b) + window} for a, b in zip(on[np.concatenate([[0], cuts + 1])], on[np.concatenate([cuts, [len(on) - 1]])], strict=True)] if len(on) else [])
        return pdf[["anchor", "content", "n", "first"]].assign(early=early)

    texts = docs.select("doc_id", "text")
    sliced = texts.join(by_doc, texts["doc_id"] == by_doc["first"]).select("first", "text", "cuts").mapInPandas(slices, f"anchor long, content long, n int, first {id_type}, words binary")
    judged = sliced.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInPandas(search, f"anchor long, content long, n int, first {id_type}, early array<struct<a:int,b:int>>")
    # a later document repeats the whole segment; the first one what still earlier ones have
    own = F.transform("early", lambda e: F.struct((F.col("start") + e["a"]).alias("a"), (F.col("start") + e["b"]).alias("b")))
    whole = F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n") + window - 1).alias("b")))
    spans = shared.join(judged, key).select("doc_id", F.when(F.col("doc_id") > F.col("first"), whole).otherwise(own).alias("spans")).where(F.size("spans") > 0)
    return spans.groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def without_repeats(docs: DataFrame, **how: int) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space), one row per row of docs.

    A null, empty or blank text has no words. Rows of equal doc_id are one document and don't
    repeat each other. Rows without doc_id come before and after nothing: they are kept whole.
    """
    spans = repeated_spans(docs, **how).withColumnRenamed("doc_id", "__doc")
    key = docs.schema["doc_id"].dataType.simpleString()

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts, removed, kept = [], [], []
            for text, cut in zip(pdf["text"], pdf["spans"], strict=True):
                words = (text or "").encode("utf-8", "replace").split()
                counts.append(len(words))
                if cut is None:
                    removed.append(0)
                else:
                    on = np.zeros(len(words) + 1, np.int64)
                    np.add.at(on, [c["a"] for c in cut], 1)
                    np.add.at(on, [c["b"] for c in cut], -1)
                    stay = np.flatnonzero(np.cumsum(on)[:-1] == 0)
                    removed.append(len(words) - len(stay))
                    words = [words[i] for i in stay]
                kept.append(b" ".join(words).decode())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": counts, "n_removed": removed, "kept_text": kept})

    both = docs.select("doc_id", "text").join(spans, F.col("doc_id") == F.col("__doc"), "left").select("doc_id", "text", "spans")
    return both.mapInPandas(rest, f"doc_id {key}, n_words long, n_removed long, kept_text string")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op6_substrings": op6_substrings}
ORACLES: dict[str, str] = {}
