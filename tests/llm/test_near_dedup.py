import numpy as np
import pytest

from filigree.llm import near_dedup
from filigree.llm import components as union
from filigree.llm.components import components
from tests.llm.helpers import edited, frame, odd_rows, prose


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute(rows, width):
    """Component of each doc_id by comparing all pairs."""
    docs = [(i, shingles(t, width)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (a, x) in enumerate(docs):
        for b, y in docs[:n]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i, _ in docs}


@pytest.mark.parametrize("width", [2, 5])
def test_same_as_brute_force(spark, width):
    rows = odd_rows()
    for g in range(6):
        base = prose(100 + g, 150)
        rows += [(1000 + 20 * g + k, edited(base, 12 + 7 * k, k)) for k in range(8)] + [(1000 + 20 * g + 10, base)]
    got = near_dedup.near_duplicates(frame(spark, rows), width=width).collect()
    wanted = brute(rows, width)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert r.component_id == wanted[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)
    sizes = {i: len(shingles(t, width)) for i, t in rows if i is not None}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got if r.doc_id is not None)


def test_empty_table_and_kept_rows(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    docs = frame(spark, odd_rows())
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, c in brute(odd_rows(), 5).items() if i == c)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 1500).astype(np.uint64)
    sets = [np.unique(pool[a : a + 1000]) for a in (0, 100, 250, 500)]
    sig = near_dedup.signatures(sets, 2048)
    for k, shift in ((1, 100), (2, 250), (3, 500)):
        true = (1000 - shift) / (1000 + shift)
        assert abs((sig[0] == sig[k]).mean() - true) < 0.05
    whole = near_dedup.super_minhash(sets[0], np.array([len(sets[0])]), 2048)[0]
    assert (whole == sig[0]).all()  # blocks of a set give the same as the set at once


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_graphs_and_hot_buckets_take_the_other_way(spark, monkeypatch):
    """Shuffled union-find, buckets dealt in parts and blocks of two members give the same."""
    rows = odd_rows() + [(1000 + k, edited(prose(77, 100), 9 + k, k)) for k in range(40)]
    for name, value in (("ONE_PARTITION", 0), ("SAMPLED", 1), ("HOT", 3), ("PARTS", 4), ("BLOCK", 2), ("PICKS", 1)):
        monkeypatch.setattr(union, name, value)
    wanted = brute(rows, 2)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows), width=2).collect() if r.doc_id is not None} == wanted


def test_string_ids(spark):
    docs = spark.createDataFrame([("b", prose(1, 50)), ("a", prose(1, 50)), ("c", prose(2, 50)), (None, prose(1, 50))], "doc_id string, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()} == {("b", "a", False), ("a", "a", True), ("c", "c", True), (None, None, True)}
