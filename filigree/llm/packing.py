"""Packing by Karmarkar-Karp multiway differencing.

Documents are tokenized where they lie. Only piece lengths are shuffled: pieces are
dealt round-robin to blocks of about BLOCK documents, and each block is split into
near-equal windows by the largest differencing method. Two partial partitions are
merged by adding the fullest windows of one to the emptiest of the other; when the
fullest final window exceeds the capacity, the block is solved again with more windows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm.common import table

#: Documents for each block. A block's windows are its own, so at most one window's
#: worth of padding and the rest of the differencing is lost for each block.
BLOCK = 512
WINDOW = 2048
#: What is left of a document behind its whole windows is cut at this length, because
#: differencing needs several items for each window to come out nearly equal.
PIECE = 512
#: Fixed value: the id that ends each document.
END_ID = 1
#: Fixed value: how byte-level BPE cuts a text before merging.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def ranked(json_path: str):
    """The vocabulary of x.json from x.tiktoken beside it, where that is: the same ids several times faster."""
    import base64
    import os

    ranks_path = json_path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_path):
        return None
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def tokenizer_of(json_path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(json_path)
    tok.encode_special_tokens = True
    return tok


def encoder(json_path: str, *, fast: bool = True):
    """A function from text to an array of ids. Control strings in a text are plain text."""
    if fast and (bpe := ranked(json_path)) is not None:
        return lambda text: np.asarray(bpe.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
    tok = tokenizer_of(json_path)
    return lambda text: np.asarray(tok.encode(text, add_special_tokens=False).ids, dtype="<u4")


def decoder(json_path: str, *, fast: bool = True):
    """A function from the ids of a whole text back to it."""
    if fast and (bpe := ranked(json_path)) is not None:
        return lambda ids: bpe.decode_bytes(ids.tolist()).decode("utf-8", "replace")
    tok = tokenizer_of(json_path)
    return lambda ids: tok.decode(ids.tolist(), skip_special_tokens=False)


def differencing(lengths: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of `lengths` split into at most `windows` lists of near-equal sums.

    A partial partition is its windows that aren't empty, fullest first. The two with the
    largest spread (fullest less emptiest) are merged until one is left.
    """
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = []
    for i, n in enumerate(lengths):
        heap.append((-n if windows > 1 else 0, i, [(n, [i])]))
    heapq.heapify(heap)
    tick = len(lengths)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = len(a) + len(b) - windows  # so many windows are filled by both
        if both <= 0:
            merged = a + b
        else:
            k = len(a) - both
            merged = a[:k] + b[: len(b) - both]
            merged += [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[k:], reversed(b[len(b) - both :]), strict=True)]
        merged.sort(key=lambda w: -w[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, tick, merged))
        tick += 1
    return [w[1] for w in heap[0][2]] if heap else []


def fill_windows(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most `capacity`; their count rises until the fullest fits."""
    if not lengths:
        return []
    count = -(-sum(lengths) // capacity)
    while True:
        windows = differencing(lengths, count)
        if all(sum(lengths[i] for i in w) <= capacity for w in windows):
            return windows
        count += max(1, count // 256)


def token_pieces(
    docs: DataFrame, tokenizer: str, *, window: int = WINDOW, piece: int = PIECE, blocks: int = 1, with_ids: bool = False
) -> DataFrame:
    """One row per piece: whole windows from the start of each document, then its rest in short pieces."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, block long" + (
        ", ids binary" if with_ids else ""
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, dealt = encoder(tokenizer), TaskContext.get().partitionId() * 7919
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4", copy=False)
                raw = ids.tobytes()
                whole = len(ids) // window * window
                starts = [*range(0, whole, window), *range(whole, len(ids), piece)]
                for start, end in zip(starts, [*starts[1:], len(ids)], strict=True):
                    part = raw[4 * start : 4 * end]
                    row = (doc_id, start, len(part) // 4, zlib.crc32(part), len(ids), dealt % blocks)
                    rows.append((*row, part) if with_ids else row)
                    dealt += 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "block"] + ["ids"] * with_ids
            yield pd.DataFrame(rows, columns=names)

    return docs.select("doc_id", "text").mapInPandas(cut, schema)


def pack(pieces: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """Give each piece of a block its sequence and its offset there."""

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        sequence, offset = np.zeros(len(pdf), "int64"), np.zeros(len(pdf), "int64")
        whole = np.flatnonzero(lengths >= window)
        sequence[whole] = np.arange(len(whole))
        rest = np.flatnonzero(lengths < window)
        for w, items in enumerate(fill_windows([int(n) for n in lengths[rest]], window), len(whole)):
            at = rest[sorted(items)]
            sequence[at] = w
            offset[at] = np.cumsum(lengths[at]) - lengths[at]
        pdf["sequence_id"] = pdf["block"] * 2**24 + sequence
        pdf["offset"] = offset
        return pdf.drop(columns="block")

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "block"]
    return pieces.groupBy("block").applyInPandas(assign, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, tokenizer: str, *, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Tokenize and pack every document.

    Each document's ids are followed by END_ID; a null text counts as empty, so it still has
    that one id. Rows that repeat are packed as often as they come, also under one doc_id.
    No documents give no pieces. with_ids adds each piece's ids as little-endian 32-bit bytes.
    """
    blocks = max(1, -(-docs.count() // BLOCK))
    return pack(token_pieces(docs, tokenizer, window=window, blocks=blocks, with_ids=with_ids), window=window)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())
    return out.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.col("offset")
    )


QUERIES = {"op8_packing": op8_packing}
ORACLES: dict[str, str] = {}
