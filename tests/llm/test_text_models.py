import random
import zlib

import numpy as np

from filigree.llm import decontamination, quality, toxicity
from tests.llm.helpers import frame, odd_rows, prose


def labelled(n=400):
    """Documents of which some hold an insult in one sentence, and some are junk."""
    docs, labels = [], []
    for i in range(n):
        text, toxic, good = prose(i, 120), i % 4 == 0, i % 5 != 0
        if toxic:
            parts = text.split(". ")
            parts[len(parts) // 2] += " zoxious" if i % 8 else " vilgrim"
            text = ". ".join(parts)
        if not good:
            text = "\n".join(" ".join(f"{w}%%%" for w in line.split()) for line in text.split("\n"))
        docs.append((i, text))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_documents(spark):
    rows, marks = labelled()
    docs, labels = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(i, t) for i, _, t in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i].score >= 0.5) == bool(t) for i, t in held)
    assert right >= 0.95 * len(held)
    texts = dict(rows)
    for i, t in held:
        for s in got[i].offending:
            assert not t or "zoxious" in texts[i][s.start : s.end] or "vilgrim" in texts[i][s.start : s.end]


def test_quality_on_held_out_documents(spark):
    rows, marks = labelled()
    docs, labels = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [(i, q) for i, q, _ in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == bool(q) for i, q in held) >= 0.95 * len(held)
    kept = quality.keep_good(docs, model)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s >= 0.3}


def test_odd_rows_and_no_labels(spark):
    docs, none = frame(spark, odd_rows()), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module, model in ((toxicity, toxicity.fit(docs, none)), (quality, quality.fit(docs, none))):
        out = module.score(docs, model).collect()
        assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
        assert module.score(frame(spark, []), model).count() == 0


def test_forward_backward_is_exact():
    rng = np.random.default_rng(2)
    counts = np.array([3, 1, 4])
    emit, edge = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pairs, _ = quality.Chains(counts).marginals(emit, edge)
    at, total = 0, np.zeros((2, 2))
    for n in counts:
        weights, marg = 0.0, np.zeros(n)
        mine = np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            w = np.exp(sum(emit[at + k] * y[k] for k in range(n)) + sum(edge[y[k], y[k + 1]] for k in range(n - 1)))
            weights += w
            marg += w * np.array(y)
            for k in range(n - 1):
                mine[y[k], y[k + 1]] += w
        assert np.allclose(good[at : at + n], marg / weights)
        total += mine / weights
        at += n
    assert np.allclose(pairs, total)


def test_noisy_or_of_sentences():
    model = toxicity.NoisyOr(np.zeros(toxicity.DIM, "float32"), -2.0)
    p = 1 / (1 + np.exp(2.0))
    scores = [s for s, _ in model.sentence_scores(["one. two. three.", "", "one"], toxicity.WordWeights(model.weights))]
    assert np.allclose(scores, [1 - (1 - p) ** 3, p, p])


def test_contamination(spark):
    items = [(1, prose(901, 40)), (2, prose(902, 25)), (3, "too short"), (4, None), (5, prose(903, 60)), (5, prose(903, 60))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    noisy = list(items[0][1].replace("\n", " "))
    for k in range(10, len(noisy), 30):
        noisy[k] = "q"
    rows = odd_rows() + [(100, f"{prose(1, 50)} {items[0][1].upper()} {prose(2, 50)}"), (101, f"{prose(3, 30)} {''.join(noisy)} x"), (102, items[1][1]), (103, prose(904, 500)), (104, items[4][1][30:260])]
    got = {r.doc_id: {h.item_id for h in r.hits} for r in decontamination.contamination(frame(spark, rows), bench).collect()}
    assert {i for i, h in got.items() if h} == {100, 101, 102, 104}
    assert got[100] == got[101] == {1} and got[102] == {2} and got[104] == {5}
    docs = frame(spark, rows)
    kept = decontamination.clean_only(docs, bench)
    assert kept.schema == docs.schema and kept.count() == len(rows) - 4
    assert decontamination.contamination(docs, bench.limit(0)).where("size(hits) > 0").count() == 0


def test_alignment_counts_edits():
    piece = prose(5, 20).encode()[:100]
    for text, edits in ((piece, 0), (piece[:50] + b"#" + piece[51:], 1), (piece[:50] + piece[52:], 2), (piece[:50] + b"###" + piece[50:], 3)):
        assert decontamination.align(piece, b"x" * 30 + text + b"y" * 30, 22, 25, 8) == (edits, 30 + len(text))


def edits_within(piece: bytes, data: bytes) -> int:
    """Fewest edits between a piece and any stretch of data: the plain table, row by row."""
    row = [0] * (len(data) + 1)
    for i, p in enumerate(piece, 1):
        before, row = row, [i]
        for j, d in enumerate(data, 1):
            row.append(min(before[j - 1] + (p != d), before[j] + 1, row[-1] + 1))
    return min(row)


def contaminated(rows, items):
    """(doc_id, item) by comparing every piece with every stretch."""
    d, out = decontamination, set()
    for item, text in items:
        data = d.normal(text)
        last = max(0, len(data) - d.PIECE)
        pieces = {data[at : at + d.PIECE] for at in (*range(0, last + 1, d.STEP), last)}
        for i, t in rows:
            if 0 < len(data) < d.LEAST:
                hit = any(d.normal(x) == data for x in (t or "").split("\n"))
            else:
                hit = any(edits_within(p, d.normal(t)) <= min(int(d.RATE * len(p)), (len(p) - d.Q) // d.Q) for p in pieces if p)
            out |= {(i, item)} if hit else set()
    return out


def some_contaminated(n=14):
    r, items = random.Random(4), [(k, prose(910 + k, 8 + 9 * k)) for k in range(5)] + [(10, "to be or not"), (11, None), (12, "a" * 130)]
    rows = [(200, "x\nTo be  or not\ny"), (201, "to be or not to"), (202, "b" + "a" * 300), (203, None), (204, "")]
    for k in range(n):
        text = list(items[k % 5][1].replace("\n", " "))
        for _ in range(k):
            at = r.randrange(len(text))
            text[at : at + 1] = r.choice((["#"], [], [text[at], "z"]))
        rows.append((k, f"{prose(930 + k, 12)} {''.join(text)} {prose(950 + k, 8)}"))
    return rows, items


def test_contamination_same_as_edit_distance_everywhere(spark, monkeypatch):
    """The same with one block or many, whatever the size of indexes and slices."""
    rows, items = some_contaminated()
    bench = spark.createDataFrame(items, "item_id long, text string")
    wanted = contaminated(rows, items)
    docs = frame(spark, rows).drop("removed", "ids", "id", "component").repartition(2)
    first = sorted(map(str, decontamination.contamination(docs, bench).collect()))
    found = {(r.doc_id, h.item_id) for r in decontamination.contamination(docs, bench).collect() for h in r.hits}
    assert found == wanted and {(200, 10), (202, 12)} <= wanted
    monkeypatch.setattr(decontamination, "BLOCK_PIECES", 9)
    assert sorted(map(str, decontamination.contamination(docs, bench).collect())) == first
    assert decontamination.clean_only(docs, bench).count() == len(rows) - len({i for i, _ in wanted})


def test_small_slices_and_indexes_find_the_same(monkeypatch):
    rows, items = some_contaminated()
    pieces = [(i, decontamination.normal(t)[a : a + 120]) for i, t in items for a in range(0, len(t or ""), 60)]
    whole = [decontamination.Block.of(pieces).ready()(t) for _, t in rows]
    monkeypatch.setattr(decontamination, "SHARED", 3)
    monkeypatch.setattr(decontamination, "POSTINGS", 4)
    split = decontamination.Block.of(pieces)
    assert len(split.indexes) > 1
    assert [sorted(split.ready()(t)) for _, t in rows] == [sorted(x) for x in whole]
