import re
from itertools import permutations

from filigree.llm import filter_audit
from tests.llm.helpers import SCHEMA, odd_rows, prose

FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails(rows):
    lowest = {}
    for i, text, _ in rows:
        if i is not None:
            lowest[text or ""] = min(i, lowest.get(text or "", i))
    for i, text, _ in rows:
        t = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        told = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and lowest[t] < i)
        yield "".join(f for f, x in zip("ABCDE", told, strict=True) if x)


def brute(rows, labels):
    """Every order is run filter by filter over the documents."""
    out, orders = {}, list(map("".join, permutations("ABCDE")))
    failed = list(zip(rows, fails(rows), strict=True))
    for part in {p or "" for _, _, p in rows}:
        mine = [(i, f) for (i, _, p), f in failed if (p or "") == part]
        for order in orders:
            left = list(mine)
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                lost = [sum(any(k == i and y[n] == 1 for k, *y in labels) for i, _ in gone if i is not None) for n in (0, 1)]
                out[part, order, step] = [len(left), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == x for _, f in mine), *lost]
    for (part, order, step), values in out.items():
        values.append(sum(out[part, o, o.index(order[step - 1]) + 1][1] for o in orders))
    return out


def got(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, p, "s", 0, 0.5, "r", "i", 7, "c") for i, t, p in rows], SCHEMA)
    marks = spark.createDataFrame([(*x, "other") for x in labels], "doc_id long, quality int, toxic int, part string")
    return {(r.part, r.filter_order, r.step): [r[f] for f in FIELDS] for r in filter_audit.order_audit(docs, marks).collect()}


def test_every_order_against_brute_force(spark):
    texts = [prose(k, n) for k, n in ((1, 40), (2, 130), (3, 90))]
    made = [t + tail for t in texts for tail in ("", " #", " " + "A" * 400, " SHOUT" * 30, " $" * 60)] + [texts[1].upper()]
    rows = [(i, t, ("en", "de", None, "")[i % 4]) for i, t in odd_rows() if i is not None]
    rows += [(None, made[0], "en"), (None, None, None)] + [(100 + k, made[k % len(made)], ("en", "de", None)[k % 3]) for k in range(40)]
    labels = [(i, i % 3 == 0, i % 5 == 0) for i in range(100, 140)] + [(5, 1, None), (5, None, 1), (100, 0, 0), (None, 1, 1), (999, 1, 1)]
    labels = [(i, None if q is None else int(q), None if t is None else int(t)) for i, q, t in labels]
    assert got(spark, rows, labels) == brute(rows, labels)


def test_empty_tables(spark):
    assert got(spark, [], []) == {}
    assert len(got(spark, [(1, None, "x")], [])) == 600


def test_zeta_is_a_sum_over_subsets(spark):
    from pyspark.sql import functions as F

    values = [(7 * m + 3) % 11 for m in range(32)]
    out = spark.range(1).select(filter_audit.zeta(F.array(*map(F.lit, values))).alias("z")).first().z
    assert out == [sum(v for m, v in enumerate(values) if m & s == m) for s in range(32)]
