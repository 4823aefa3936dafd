"""Benchmark decontamination by the q-gram lemma.

Texts are lower-cased and their white space made single spaces. Benchmark texts are cut into
overlapping pieces. A stretch of a document within `e` edits of a piece of m characters shares
at least m - Q + 1 - Q * e q-grams with it, all on diagonals (place in the document less place
in the piece) at most e apart. So shared q-grams are counted in overlapping bands of
diagonals, bands with enough of them are kept, and banded alignment finds their edits.
Lengths, q-grams and edits are of UTF-8 bytes. The pieces are dealt to blocks; one pass over the
documents holds one block, whatever the size of the benchmark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm.common import discard, table, written

#: One q-gram is exactly one 64-bit number.
Q = 8
#: Length of a piece of a benchmark text and the step between two. Any stretch of PIECE + STEP
#: characters of a benchmark text holds a whole piece. Shorter texts are one piece; those below
#: LEAST characters can't be told from chance within a sentence and are found as whole lines, letter by letter.
PIECE, STEP, LEAST = 120, 60, 24
#: Edits allowed for each character of a piece.
RATE = 0.08
#: Diagonals between the beginnings of two bands.
BAND = 16
#: Pieces of a block, about; places of one q-gram in an index; q-grams shared with one that are looked at at a time.
BLOCK_PIECES, POSTINGS, SHARED = 65_536, 50_000, 8_000_000
HASH_BITS = 22
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "replace").split())


def grams(data: bytes) -> np.ndarray:
    """The q-gram at each place as a number; a view without copying."""
    n = len(data) - Q + 1
    return np.ndarray((max(0, n),), "<u8", data, strides=(1,)) if n > 0 else np.empty(0, "u8")


def slot(g: np.ndarray) -> np.ndarray:
    return ((g * SPREAD) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def pieces_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, piece): each text in overlapping pieces of its normal form; a text below LEAST is one piece."""
    item = benchmark.schema["item_id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item_id, text in zip(pdf["item_id"], pdf["text"], strict=True):
                data = normal(text)
                last = max(0, len(data) - PIECE)
                rows += [(item_id, data[at : at + PIECE]) for at in sorted({*range(0, last + 1, STEP), last}) if data]
            yield pd.DataFrame(rows, columns=["item_id", "piece"])

    return benchmark.select("item_id", "text").mapInPandas(cut, f"item_id {item}, piece binary")


@dataclass
class Pieces:
    """Pieces of the benchmark with an index from q-grams to places in pieces."""

    items: list
    texts: list[bytes]
    edits: np.ndarray
    need: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    piece: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Pieces:
        items, texts = [r[0] for r in rows], [bytes(r[1]) for r in rows]
        m = np.array([len(t) for t in texts], np.int64)
        edits = np.minimum((RATE * m).astype(np.int64), np.maximum(0, (m - Q) // Q))
        need = m - Q + 1 - Q * edits
        all_grams = np.concatenate([np.array(grams(t)) for t in texts] or [np.empty(0, "u8")])
        piece = np.repeat(np.arange(len(texts)), np.maximum(0, m - Q + 1))
        place = np.concatenate([np.arange(max(0, n - Q + 1)) for n in m] or [np.empty(0, np.int64)]).astype(np.int64)
        order = np.argsort(all_grams, kind="stable")
        keys, first = np.unique(all_grams[order], return_index=True)
        return cls(items, texts, edits, need, keys, np.append(first, len(order)), piece[order], place[order])

    def filter(self) -> np.ndarray:
        on = np.zeros(1 << HASH_BITS, bool)
        on[slot(self.keys)] = True
        return on


def indexes(rows: list[tuple]) -> list[Pieces]:
    """Indexes of pieces, split until no q-gram has more than POSTINGS places in one."""
    made = Pieces.of(rows)
    if len(rows) > 1 and len(made.keys) and np.diff(made.first).max() > POSTINGS:
        return indexes(rows[::2]) + indexes(rows[1::2])
    return [made]


@dataclass
class Block:
    """What one pass over the documents looks for."""

    indexes: list[Pieces]
    lines: dict[bytes, list]

    @classmethod
    def of(cls, rows: list[tuple]) -> Block:
        rows, lines = sorted(rows, key=lambda r: (bytes(r[1]), str(r[0]))), {}
        for item, piece in rows:
            if len(piece) < LEAST:
                lines.setdefault(bytes(piece), []).append(item)
        return cls(indexes([r for r in rows if len(r[1]) >= LEAST]), lines)

    def ready(self) -> Callable[[str | None], list[tuple]]:
        """A function from a text to its hits (item, first word, last word, edits)."""
        filters = [(p, p.filter()) for p in self.indexes if p.texts]

        def find(text: str | None) -> list[tuple]:
            data = normal(text)
            hits = [(i, data.count(b" ", 0, a), data.count(b" ", 0, b), e) for p, on in filters for i, a, b, e in matches(data, p, on)]
            if self.lines and data:
                at = 0
                for line in (text or "").split("\n"):
                    words = normal(line)
                    n = words.count(b" ") + 1 if words else 0
                    hits += [(i, at, at + n - 1, 0) for i in self.lines.get(words, ())]
                    at += n
            return hits

        return find


def shared(data: bytes, pieces: Pieces, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, first diagonal) of the bands of `data` that share enough q-grams with a piece."""
    g = grams(data)
    # a stretch near a piece has its shared q-grams within PIECE and the most edits
    near = on[slot(g)]
    span, before = PIECE + int(pieces.edits.max()), np.concatenate([[0], np.cumsum(near)])
    dense = before[np.minimum(np.arange(len(g)) + span, len(g))] - before[:-1] >= pieces.need.min()
    if not dense.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.zeros(len(g) + 1, np.int64)
    edge[: len(g)] += dense
    np.subtract.at(edge, np.minimum(np.flatnonzero(dense) + span, len(g)), 1)
    at = np.flatnonzero(near & (np.cumsum(edge)[:-1] > 0))
    found = np.searchsorted(pieces.keys, g[at])
    real = pieces.keys[np.minimum(found, len(pieces.keys) - 1)] == g[at]
    at, found = at[real], found[real]
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n = pieces.first[found + 1] - pieces.first[found]
    bands = (len(data) + 2 * PIECE) // BAND + 2
    most = int(pieces.edits.max())
    reach, total = PIECE + BAND + most, np.cumsum(n)
    out, begin, done = [], 0, -1
    while begin < len(at):
        # a slice of places; it decides the bands whose last place lies in it, for which it looks back
        end = max(begin + 1, int(np.searchsorted(total, total[begin] - n[begin] + SHARED, side="right")))
        back = int(np.searchsorted(at, done - reach))
        part = slice(back, end)
        entry = np.repeat(pieces.first[found[part]] - (np.cumsum(n[part]) - n[part]), n[part]) + np.arange(n[part].sum())
        piece = pieces.piece[entry]
        diagonal = np.repeat(at[part], n[part]) - pieces.place[entry] + PIECE
        band = diagonal // BAND
        edge = np.flatnonzero(diagonal - band * BAND < pieces.edits[piece])  # also in the band before
        key = np.concatenate([piece * bands + band, piece[edge] * bands + band[edge] - 1])
        key, count = np.unique(key, return_counts=True)
        last = key % bands * BAND + BAND + most  # the last place of a band: its last diagonal with a piece's end
        upto = int(at[end - 1]) if end < len(at) else len(data) + reach
        own = (count >= pieces.need[key // bands]) & (last > done) & (last <= upto)
        out.append(key[own])
        begin, done = end, upto
    key = np.unique(np.concatenate(out))
    return key // bands, key % bands * BAND - PIECE


def align(piece: bytes, data: bytes, low: int, width: int, limit: int) -> tuple[int, int]:
    """Fewest edits between `piece` and a stretch of `data` within diagonals [low, low + width), and its end.

    Only those diagonals are worked on. More than `limit` edits are given as limit + 1.
    """
    if (at := data.find(piece, max(0, low), max(0, low + width - 1 + len(piece)))) >= 0:
        return 0, at + len(piece)
    p, far = np.frombuffer(piece, np.uint8), limit + 1
    d = np.full(len(piece) + width + 1, 256, np.int64)  # 256: outside the text
    a, b = max(0, low), min(len(data), low + len(d))
    d[a - low : max(a, b) - low] = np.frombuffer(data[a:b], np.uint8)
    step, cost = np.arange(width), np.zeros(width, np.int64)
    for i in range(len(p)):
        here = cost + (d[i : i + width] != p[i])
        here[:-1] = np.minimum(here[:-1], cost[1:] + 1)
        cost = np.minimum(np.minimum.accumulate(here - step) + step, far)
        if cost.min() >= far:
            return far, 0
    k = int(cost.argmin())
    return int(cost[k]), low + k + len(p)


def matches(data: bytes, pieces: Pieces, on: np.ndarray) -> list[tuple]:
    """(item, start, end, edits) of each stretch of a normal text that is found to be a piece."""
    found = set()
    for piece, low in zip(*(x.tolist() for x in shared(data, pieces, on)), strict=True):
        e, text = int(pieces.edits[piece]), pieces.texts[piece]
        edits, end = align(text, data, low - e, BAND + 3 * e + 1, e)
        if edits <= e:
            found.add((pieces.items[piece], max(0, end - len(text)), end, edits))
    return sorted(found, key=lambda m: m[1:])


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, tag, hits) of the documents that hold benchmark texts; tag is a hash of the text.

    Each pass holds one block of pieces, which is all that goes to the driver at once.
    """
    pieces = written(pieces_of(benchmark))
    blocks = max(1, -(-pieces.count() // BLOCK_PIECES))
    key, item = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {key}, tag long, hits array<struct<item_id:{item},first_word:int,last_word:int,edits:int>>"
    tagged = docs.select("doc_id", "text", F.xxhash64("text").alias("tag"))

    def one_pass(block: Block) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            find = block.ready()
            for pdf in batches:
                found = [[{"item_id": i, "first_word": a, "last_word": b, "edits": e} for i, a, b, e in find(text)] for text in pdf["text"]]
                yield pdf[["doc_id", "tag"]].assign(hits=found)[[bool(h) for h in found]]

        return tagged.mapInPandas(run, schema)

    part = F.pmod(F.xxhash64("item_id", "piece"), F.lit(blocks))
    passes = [written(one_pass(Block.of([tuple(r) for r in pieces.where(part == b).collect()])).distinct()) for b in range(blocks)]
    discard(pieces)
    return reduce(DataFrame.unionByName, passes)


def same_row(found: DataFrame) -> Column:
    """Joins hits to their rows; a row is told by its doc_id and text."""
    return F.col("doc_id").eqNullSafe(found["__doc"]) & F.xxhash64("text").eqNullSafe(found["__tag"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and hits, one row per row of docs: the benchmark items found and where.

    A hit has the item, the first and last word of the stretch, counted from 0, and its edits; of
    an item's hits that end in one word that with the fewest edits is given. Null and empty texts hold
    nothing; null and empty benchmark texts aren't looked for; items that repeat are reported alike.
    Rows that repeat get the same hits.
    """
    order = F.transform(F.flatten(F.collect_list("hits")), lambda h: F.struct(h["item_id"].alias("item_id"), h["last_word"].alias("last_word"), h["edits"].alias("edits"), h["first_word"].alias("first_word")))
    found = hits(docs, benchmark).groupBy(F.col("doc_id").alias("__doc"), F.col("tag").alias("__tag")).agg(F.array_sort(order).alias("__hits"))

    def fewest(h: Column, i: Column) -> Column:
        before = F.get(F.col("__hits"), i - 1)
        return (i == 0) | ~before["item_id"].eqNullSafe(h["item_id"]) | (before["last_word"] != h["last_word"])

    kept = F.transform(F.filter("__hits", fewest), lambda h: F.struct(h["item_id"].alias("item_id"), h["first_word"].alias("first_word"), h["last_word"].alias("last_word"), h["edits"].alias("edits")))
    found = found.withColumn("__hits", kept)
    kind = found.schema["__hits"].dataType.simpleString()
    return docs.select("doc_id", "text").join(found, same_row(found), "left").select("doc_id", F.coalesce("__hits", F.array().cast(kind)).alias("hits"))


def clean_only(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns unchanged, that hold no benchmark text; see contamination."""
    found = hits(docs, benchmark).select(F.col("doc_id").alias("__doc"), F.col("tag").alias("__tag")).distinct()
    return docs.join(found, same_row(found), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.array_sort(F.array_distinct("hits.item_id")).alias("items"), F.size("hits").alias("n_hits"))


QUERIES = {"op4_decontamination": op4_decontamination}
ORACLES: dict[str, str] = {}
