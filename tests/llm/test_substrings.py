import datetime

import numpy as np

from filigree.llm import substrings
from tests.llm.helpers import frame, odd_rows, prose


def brute(rows, window=50):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), b" ".join(x for n, x in enumerate(w) if n not in gone).decode()))
    return out


def test_same_as_brute_force(spark):
    shared, rows = prose(7, 70), odd_rows()
    rows += [(100 + k, f"{prose(400 + k, 40)} {shared} {prose(500 + k, 60)}") for k in range(5)]
    rows += [(110, f"{shared} {shared}"), (111, " ".join(shared.split()[:49])), (112, " ".join(shared.split()[:50])), (113, "ai " * 2000), (114, "ai " * 60), (99, "x " + shared)]
    got = [tuple(r) for r in substrings.without_repeats(frame(spark, rows)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_ids_of_other_types(spark):
    shared = prose(7, 70)
    texts = [f"{prose(400 + k, 40)} {shared} {prose(500 + k, 60)}" for k in range(3)] + ["é", None]
    for kind, ids in (("string", ["b", "é", "a", "c", None]), ("int", [5, 9, 2, 7, None]), ("date", [datetime.date(2020, 1, d) for d in (5, 9, 2, 7, 8)])):
        rows = list(zip(ids, texts, strict=True))
        got = [tuple(r) for r in substrings.without_repeats(spark.createDataFrame(rows, f"doc_id {kind}, text string")).collect()]
        assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_no_documents(spark):
    assert substrings.without_repeats(frame(spark, [])).count() == 0


def test_wavelet_ranks_and_search():
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 9, 400)
    tree = substrings.WaveletMatrix(symbols, 8)
    at, c = rng.integers(0, 401, 200), rng.integers(0, 9, 200)
    assert (tree.rank(c, at) == [(symbols[:p] == s).sum() for p, s in zip(at, c, strict=True)]).all()
    segs = [rng.integers(1, 4, n).astype(np.uint64) for n in (30, 12, 25, 40)]
    docs = np.array([5, 3, 9, 1])
    found = substrings.earliest(segs, docs, 6, 3)
    for seg, least in zip(segs, found, strict=True):
        for k in range(len(seg) - 5):
            held = [d for s, d in zip(segs, docs, strict=True) if any((s[j : j + 6] == seg[k : k + 6]).all() for j in range(len(s) - 5))]
            assert least[k] == min(held)
