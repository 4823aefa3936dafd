"""String similarity that has no native counterpart, in Arrow batches."""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@lru_cache(maxsize=1 << 17)
def matching_blocks(x: str, y: str) -> float:
    """Pairs of names repeat, so a worker keeps what it has worked out, for a bounded number of pairs."""
    return round(SequenceMatcher(None, x, y).ratio(), 4)


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio rounded to four places: 0 if either is empty, 1 if equal. Not symmetric: keep the order."""

    def one(x: str | None, y: str | None) -> float:
        if not x or not y:
            return 0.0
        return 1.0 if x == y else matching_blocks(x, y)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


#: Letters are told apart by so many of their low values; letters that share one only loosen a bound.
LETTERS = 256


class Entries:
    """Names with a score each that is low where a name has nothing of theirs, high where its ratio is 1, between in proportion, and `equal` for the name itself."""

    def __init__(self, names: Sequence[str], keys: Sequence[int], low: Sequence[float], high: Sequence[float], equal: Sequence[float]):
        self.names, self.keys, self.equal = list(names), np.asarray(keys), np.asarray(equal, float)
        self.low, self.high = np.asarray(low, float), np.asarray(high, float)
        self.lengths = np.array([len(n) for n in self.names])
        self.letters = np.full((len(self.names), max(1, self.lengths.max(initial=0))), LETTERS)
        for row, name in zip(self.letters, self.names, strict=True):
            row[: len(name)] = [ord(x) % LETTERS for x in name]

    def bounds(self, name: str) -> np.ndarray:
        """What the scores of a name can't exceed: matched letters are letters of both in the order of both, so a common subsequence bounds them."""
        common = np.minimum(self.lengths, len(name))
        if 0 < len(name) < 64:
            has = np.zeros(LETTERS + 1, np.uint64)
            for i, x in enumerate(name):
                has[ord(x) % LETTERS] |= np.uint64(1 << i)
            # a bit that is cleared is a letter of the subsequence (bit-parallel, all entries at once)
            left = np.full(len(self.names), (1 << len(name)) - 1, np.uint64)
            for letters in self.letters.T:
                met = left & has[letters]
                left = (left + met) | (left - met)
            common = len(name) - np.bitwise_count(left & np.uint64((1 << len(name)) - 1)).astype(int)
        share = np.round(2.0 * common / np.maximum(self.lengths + len(name), 1), 4)
        return np.round(self.low + (self.high - self.low) * share, 4)

    def best(self, name: str, k: int) -> list[int]:
        """The places of the k entries of highest score, smallest keys first among equal ones. Scores have four decimals."""
        bounds = self.bounds(name)
        if (same := [i for i, n in enumerate(self.names) if n == name]):
            bounds[same] = np.round(self.equal[same], 4)
        found: list[tuple[float, int, int]] = []
        for i in np.lexsort((self.keys, -bounds)).tolist():
            if len(found) == k and (-bounds[i], self.keys[i]) > found[-1][:2]:
                break
            score = bounds[i] if self.names[i] == name else round(float(self.low[i] + (self.high[i] - self.low[i]) * (matching_blocks(name, self.names[i]) if name and self.names[i] else 0.0)), 4)
            insort(found, (-score, self.keys[i], i))
            del found[k:]
        return [i for *_, i in found]


def best_of_blocks(k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas: rows (place, names, and of entries the arrays entry_names, keys, low, high, equal) become (place, name, entry_name, keys) of the k best entries of each name; an entry's keys are sorted."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                entries = Entries(r.entry_names, [x[0] for x in r.keys], r.low, r.high, r.equal)
                pairs = [(r.place, name, r.entry_names[i], r.keys[i]) for name in r.names for i in entries.best(name, k)]
                yield pd.DataFrame(pairs, columns=["place", "name", "entry_name", "keys"])

    return rows
