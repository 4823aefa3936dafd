"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

SuperMinHash gives every element one permutation of the signature's places and values that
grow along it, so an element's values at different places are correlated and an element is
left as soon as no place can fall any more: a document of n words costs some n rounds of one
value, not n times the signature. Documents of equal sets become one representative first;
representatives that share a band are candidates, confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm.common import discard, table, written
from filigree.llm.components import SKETCH_LONGS, Verifier, bits_agree, linked

#: A pair at the least similarity of 0.8 is missed by all bands with chance
#: (1 - 0.8 ** ROWS) ** BANDS = 3e-6.
BANDS, ROWS = 32, 5
U64 = np.uint64
ODD = tuple(U64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
NONE = U64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed permutation of 64-bit numbers."""
    x = (x ^ (x >> U64(30))) * ODD[1]
    x = (x ^ (x >> U64(27))) * ODD[2]
    return x ^ (x >> U64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        v = self[word] = xxhash.xxh64_intdigest(word)
        return v


def shingle_set(text: str | None, width: int, words: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles of `width` words, A-Z lower-cased.

    Fewer words are one shingle; no words are none.
    """
    found = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and spaces only
    if not found:
        return np.empty(0, U64)
    h = np.fromiter(map(words.__getitem__, found), U64, len(found))
    n = max(1, len(h) - width + 1)
    out = np.full(n, U64(min(width, len(h))))
    for i in range(min(width, len(h))):
        out = mix(out * ODD[0] + h[i : i + n])
    return np.unique(out)


def super_minhash(elements: np.ndarray, counts: np.ndarray, places: int) -> np.ndarray:
    """A signature of `places` values for each of several sets, laid end to end in `elements`."""
    n = len(counts)
    sig = np.full(n * places, NONE)
    owner = np.repeat(np.arange(n), counts)
    base, at = owner * places, np.arange(len(elements)) * places
    perm = np.tile(np.arange(places, dtype=np.int16), len(elements))
    for j in range(places):
        x = mix(elements + U64((j + 1) * int(ODD[0]) % 2**64))
        k = at + j + (((x & U64(0xFFFFFFFF)) * U64(places - j)) >> U64(32)).astype(np.int64)
        place = perm[k]
        perm[k] = perm[at + j]
        np.minimum.at(sig, base + place, (U64(j) << U64(32)) + (x >> U64(32)))
        open_ = sig.reshape(n, places).max(1) >= (U64(j + 1) << U64(32))
        go = open_[owner]
        if not go.all():
            elements, owner, base, at = elements[go], owner[go], base[go], at[go]
            if len(elements) == 0:
                break
    return sig.reshape(n, places)


def signatures(sets: list[np.ndarray], places: int) -> np.ndarray:
    """Signatures of many sets, a bounded number of elements at a time; the union's is the minimum of its parts'."""
    block = max(256, 2_600_000 // places)
    out = np.full((len(sets), places), NONE)
    parts = [(i, s[a : a + block]) for i, s in enumerate(sets) for a in range(0, len(s), block)]
    parts.sort(key=lambda p: len(p[1]))
    while parts:
        now, size = [], 0
        while parts and (not now or size + len(parts[-1][1]) <= block):
            now.append(parts.pop())
            size += len(now[-1][1])
        got = super_minhash(np.concatenate([p for _, p in now]), np.array([len(p) for _, p in now]), places)
        np.minimum.at(out, np.array([i for i, _ in now]), got)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band of each signature; bands never share keys but by chance."""
    key = np.tile(np.arange(bands, dtype=U64), (len(sig), 1)) + ODD[0]
    by_band = sig.reshape(len(sig), bands, rows)
    for r in range(rows):
        key = mix(key * ODD[0] + by_band[:, :, r])
    return key.astype(np.int64)


def signed(docs: DataFrame, *, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, a hash of the text, size of the shingle set, a 128-bit fingerprint of it, and band keys."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                sets = [shingle_set(t, width, words) for t in part["text"]]
                prints = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "int64") for s in sets]
                keys = band_keys(signatures(sets, bands * rows), bands, rows)
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"], "tag": part["tag"], "n_shingles": [len(s) for s in sets],
                        "p1": [p[0] for p in prints], "p2": [p[1] for p in prints],
                        "keys": [k if len(s) else k[:0] for k, s in zip(keys, sets, strict=True)],
                    }
                )

    tagged = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("tag"))
    return tagged.mapInPandas(run, f"doc_id {key}, tag long, n_shingles long, p1 long, p2 long, keys array<long>")


def confirmed(docs: DataFrame, reps: DataFrame, *, width: int, percent: int) -> Callable[[DataFrame], Verifier]:
    """A verifier that compares full shingle sets; its sketches are a bit of each place of a long signature."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, recent = WordHashes(), {}

        def of(key: int, text: str) -> np.ndarray:
            if (got := recent.get(key)) is None or got[0] != len(text):
                if len(recent) > 200:
                    recent.clear()
                got = recent[key] = (len(text), shingle_set(text, width, words))
            return got[1]

        for pdf in batches:
            keep = []
            for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"], strict=True):
                x, y = of(a, ta or ""), shingle_set(tb, width, words)
                common = 0
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and len(x):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield pdf.loc[keep, ["a", "b"]]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at : at + 200]
                sig = signatures([shingle_set(t, width, words) for t in part["text"]], 64 * SKETCH_LONGS)
                bits = np.packbits((sig & U64(1)).astype(np.uint8), axis=1).view(np.int64)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "bits": list(bits)})

    def prepare(ids: DataFrame) -> Verifier:
        wanted = reps.join(ids, "id", "left_semi").select("id", F.col("first.doc_id").alias("__doc"), F.col("first.tag").alias("__tag"))
        same = (F.col("doc_id") == F.col("__doc")) & (F.xxhash64("text") == F.col("__tag"))
        # a row that repeats gives its text twice, which makes no difference but to the time
        texts = written(docs.select("doc_id", "text").join(wanted, same).select("id", "text"))

        def confirm(pairs: DataFrame) -> DataFrame:
            right, left = texts.withColumnsRenamed({"id": "b", "text": "tb"}), texts.withColumnsRenamed({"id": "a", "text": "ta"})
            return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInPandas(compare, "a long, b long").distinct()

        def sketch(some: DataFrame) -> DataFrame:
            bits = texts.join(some, "id", "left_semi").mapInPandas(draw, "id long, bits array<long>").dropDuplicates(["id"])
            return bits.join(reps.select("id", "keys"), "id").select("id", F.struct("bits", "keys").alias("sketch"))

        alike = bits_agree(percent)

        def likely(x: Column, y: Column) -> Column:
            return alike(x["bits"], y["bits"])

        def once(key: Column, x: Column, y: Column) -> Column:
            return F.array_min(F.array_intersect(x["keys"], y["keys"])) == key

        return Verifier(confirm, sketch, lambda s: s["keys"], likely, once, close=lambda: discard(texts))

    return prepare


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id) and kept, one row per row of docs.

    doc_id may be of any type that has an order. A null, empty or blank text has no shingles and is
    linked with nothing. Rows that repeat under one doc_id are linked like any copies; if their texts
    differ, each is judged by its own. Rows without doc_id can't be named in a link; they are
    returned as kept, without a component.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    sets = written(signed(docs, width=width, bands=bands, rows=rows))
    # equal sets are one; the smallest document with such a set stands for all
    classes = sets.where("n_shingles > 0").groupBy("p1", "p2").agg(F.min(F.struct("doc_id", "tag")).alias("first"), F.first("keys").alias("keys"))
    reps = written(classes.withColumn("id", F.monotonically_increasing_id()))
    found = written(linked(reps.select(F.explode("keys").alias("key"), "id"), confirmed(docs, reps, width=width, percent=percent)))
    named = reps.join(found, "id", "left").select("p1", "p2", "first.doc_id", F.coalesce("component", "id").alias("component"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    groups = written(named.join(smallest, "component").select("p1", "p2", "component_id"))
    discard(reps, found)
    own = F.coalesce("component_id", "doc_id")
    out = sets.join(groups, ["p1", "p2"], "left").select("doc_id", "n_shingles", own.alias("component_id"), (F.col("doc_id") == own).alias("kept"))
    nameless = docs.where("doc_id is null").selectExpr(f"cast(null as {key}) as doc_id", "cast(null as bigint) as n_shingles", f"cast(null as {key}) as component_id", "true as kept")
    return out.unionByName(nameless)


def keep_one(docs: DataFrame, **how: int) -> DataFrame:
    """The rows of docs, all columns unchanged, of the first document of each group; one row of each doc_id."""
    kept = near_duplicates(docs, **how).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


QUERIES = {"op2_near_dedup": op2_near_dedup}
ORACLES: dict[str, str] = {}
