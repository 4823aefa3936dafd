import datetime as dt

import pytest
from pyspark.sql import functions as F

from filigree.operators import aggs, compliance, guard, joins, network, risk, rules, sets, windows


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_canonical_prefers_stamp_then_amended_then_id(spark):
    df = spark.createDataFrame(
        [(1, 7, 2020, None, "990", None), (2, 7, 2020, "2021-01-01", "990", None), (3, 7, 2020, "2021-01-01", "990", "1"), (4, 7, 2021, None, "990", None), (5, 7, 2021, None, "990", None), (6, 8, 2020, "x", "990T", None)],
        "filing_id int, ein int, tax_year int, return_ts string, return_type string, amended string",
    )
    assert rows(windows.canonical_filings(df, ["990"]).select("filing_id"), "filing_id") == [(3,), (5,)]


def test_rank_gap_of_a_single_candidate_is_its_score(spark):
    df = spark.createDataFrame([(1, 10, 5.0), (1, 11, 3.0), (2, 12, 4.0)], "k int, c int, s double")
    assert rows(windows.rank_gap(df, ["k"], "s", [F.col("c")]).where("rank = 1").select("k", "c", "score_gap", "candidate_count"), "k") == [(1, 10, 2.0, 2), (2, 12, 4.0, 1)]


def test_missing_years(spark):
    df = spark.createDataFrame([(1, 2000), (1, 2003), (1, 2003), (2, 2000)], "k int, y int")
    assert rows(windows.missing_years(df, "k", "y"), "y") == [(1, 2001), (1, 2002)]


def test_tiers_take_the_first_unique_match(spark):
    index = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3), (None, "x", 9)], "n string, c string, e int")
    asked = spark.createDataFrame([("a", "x"), ("a", "z"), ("b", "z"), (None, "x")], "n string, c string")
    got = joins.tiered_lookup(asked, index, (("both", ("n", "c"), 0.9), ("name", ("n",), 0.8)), "e")
    assert sorted((r.n or "", r.c, r.match, r.method) for r in got.collect()) == [("", "x", None, "unresolved"), ("a", "x", 1, "both"), ("a", "z", None, "unresolved"), ("b", "z", 3, "name")]


def test_hubs_are_strictly_above_the_limit(spark):
    edges = spark.createDataFrame([(i, "t1") for i in range(2)] + [(i, "t2") for i in range(3)], "s int, t string")
    assert rows(joins.shared_targets(edges, "s", "t", hub_over=2)) == [(0, 1, 1)]
    e = spark.createDataFrame([(i, f"person:{n}", 2000) for n, k in (("a b", 25), ("c d", 26)) for i in range(k)], "source_ein int, target_key string, tax_year int")
    assert rows(network.node_stats(e).select("target_key", "is_hub"), "target_key") == [("person:a b", 0), ("person:c d", 1)]


def test_two_hops_and_reciprocal(spark):
    e = spark.createDataFrame([(1, 2, 2000, 5.0), (2, 3, 2001, 6.0), (2, 4, 2004, 1.0), (2, 1, 2002, 2.0)], "a int, b int, y int, amount double")
    assert sorted((r.a, r.b, r.c) for r in joins.two_hops(e, "a", "b", "y").collect()) == [(1, 2, 1), (1, 2, 3)]
    assert [(r.a, r.b, r.y1, r.y2) for r in joins.reciprocal(e, "a", "b", "y").collect()] == [(1, 2, 2000, 2002)]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "c")], "k int, v string")
    h = F.xxhash64("v")
    assert rows(sets.duplicate_audit(df, ["k"], h).select("k", "action"), "k") == [(1, "identical_keep_one"), (2, "conflict_remove_all")]
    assert rows(sets.without_duplicates(df, ["k"], h), "k") == [(1, "a"), (3, "c")]


def test_multisets(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "f int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (2, "z")], "f int, v string")
    assert rows(sets.multiset_difference(a, b), "f", "v") == [(1, "x", 1), (2, "y", -1), (2, "z", -1)]
    assert rows(sets.multiset_digest(a)) == rows(sets.multiset_digest(a.orderBy(F.desc("v")))) != rows(sets.multiset_digest(b))
    assert rows(sets.replay_factor(a, a.unionByName(a), ["f"]), "f") == [(1, 2), (2, 2)]
    assert rows(sets.replay_factor(a, b, ["f"]), "f")[1] == (2, None)


def test_reconcile_and_concentration(spark):
    core = spark.createDataFrame([(1, 100_000.0), (2, 100_000.0), (3, 10.0)], "f int, core double")
    detail = spark.createDataFrame([(1, 90_000.0), (2, 130_000.0)], "f int, amount double")
    got = {r.f: (r.material, r.inflated) for r in aggs.reconcile(detail, core, ["f"]).collect()}
    assert got == {1: (False, False), 2: (True, True), 3: (False, False)}


@pytest.mark.parametrize(("received", "amendment", "hardship", "status", "late"), [("2020-03-30", 0, 0, "FILED_ON_TIME", 0), ("2020-03-31", 0, 0, "FILED_LATE", 1), ("2020-03-31", 0, 1, "HARDSHIP_REVIEW", 1), ("2020-01-31", 1, 0, "ORIGINAL_NOT_OBSERVED", 0)])
def test_timeliness(spark, received, amendment, hardship, status, late):
    df = spark.createDataFrame([(1, dt.date(2019, 12, 31), 5, amendment, dt.date.fromisoformat(received), hardship)], "f_num int, period_end date, rpt_id int, amendment int, receive_date date, hardship int")
    assert rows(compliance.filing_periods(df).select("status", "days_late")) == [(status, late)]


def test_expectations(spark):
    ends = [(1, "2015-12-31"), (1, "2018-12-31"), (2, "2018-12-31"), (3, "2016-12-31"), (3, "2017-12-31"), (4, "2016-12-31"), (4, "2017-06-30"), (5, "2016-12-31")]
    periods = spark.createDataFrame([(f, dt.date.fromisoformat(e)) for f, e in ends], "f_num int, period_end date")
    orgs = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 0), (5, 1)], "f_num int, terminated int")
    got = compliance.expectations(periods, orgs, F.lit("2019-06-01").cast("date"))
    assert sorted((r.f_num, r.result, str(r.expected_end)) for r in got.collect()) == [
        (1, "FYE_CHANGED_REVIEW", "None"), (1, "HISTORICAL_GAP", "2016-12-31"), (1, "HISTORICAL_GAP", "2017-12-31"), (2, "INSUFFICIENT_HISTORY", "None"),
        (3, "CURRENT_EXPECTATION", "2018-12-31"), (4, "FYE_CHANGED_REVIEW", "None"), (5, "TERMINATED", "None"),
    ]


def test_score_caps_and_bonus(spark):
    ind = [(1, 2000 + i, "High", "A", "t") for i in range(3)] + [(1, 2000, "Medium", "B", "u"), (1, 2000, "High", "Data Quality", "v"), (2, 2000, "Low", "A", "t")]
    ind += [(3, 2000, "High", c, str(i)) for c in "ABCD" for i in range(3)]
    df = spark.createDataFrame(ind, "ein int, tax_year int, severity string, category string, title string")
    assert rows(risk.score(df), "ein") == [(1, 33), (2, 3), (3, 100)]


def test_rules_in_order(spark):
    base = {"cs": 0.0, "ns": 0.0, "addr_score": 0.0, "gap": 0.0, "n": 2, "exact_name": 0, "exact_address": 0, "zip_match": 0, "city_state": 0, "state_match": 0, "reported": 0, "distinctive": 0}
    cases = [{"reported": 1, "cs": 130.0}, {"exact_name": 1, "zip_match": 1, "cs": 95.0, "gap": 2.0}, {"exact_name": 1, "zip_match": 1, "cs": 95.0, "gap": 1.0}, {"cs": 101.0, "gap": 30.0, "ns": 0.85}]
    df = spark.createDataFrame([tuple((base | c).values()) for c in cases], list(base))
    assert [r.rule for r in rules.accept(df).collect()] == ["reported_ein_candidate", "exact_name_zip", "needs_ai_or_review", "clear_best_candidate"]


@pytest.mark.parametrize("text", ["DELETE FROM t", "SELECT 1; SELECT 2", "SELECT * FROM t LIMIT x", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SELECT * FROM t, u",
    "SELECT x.id FROM (SELECT id FROM t) x, secret", "SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM t", "TABLE secret", "SELECT nope FROM t", "SET a = 1", "VALUES (1)",
    "SELECT id FROM t WHERE id IN (SELECT id FROM secret)", "WITH secret AS (SELECT id FROM secret) SELECT id FROM secret", "SELECT id FROM range(5)", "SELECT id FROM parquet.`/etc`", "SELECT id FROM t LIMIT 1 + 1",
])
def test_guard_refuses(spark, text):
    spark.range(3).createOrReplaceTempView("secret")
    with pytest.raises(guard.Refused):
        guard.ask(spark, text, {"t": spark.range(1), "u": spark.range(1)})
    spark.catalog.dropTempView("secret")


@pytest.mark.parametrize(
    "text",
    ["SELECT t.id FROM t JOIN u ON true", "SELECT t.id FROM t JOIN u ON t.id = t.id", "SELECT t.id FROM t JOIN u ON t.id = u.id OR true", "SELECT t.id FROM t JOIN u ON t.id > 3", "SELECT lpad('x', 2000000000, 'y') AS x FROM t", "SELECT rpad('x', id, 'y') AS x FROM t"],
)
def test_guard_refuses_products_and_long_padding(spark, text):
    with pytest.raises(guard.Refused):
        guard.ask(spark, text, {"t": spark.range(1), "u": spark.range(1)})


def test_guard_lets_joins_and_short_padding_through(spark):
    text = "SELECT lpad('x', 10, 'y') AS x FROM t LEFT JOIN u ON t.id + 1 = u.id AND u.id > 2"
    assert guard.ask(spark, text, {"t": spark.range(3), "u": spark.range(9)}).count() == 3


def test_guard_lets_queries_through(spark):
    assert guard.ask(spark, "WITH a AS (SELECT id FROM t) SELECT id, 'drop' AS w FROM a LIMIT 3", {"t": spark.range(9)}).count() == 3
    with pytest.raises(guard.Refused):
        guard.ask(spark, "SELECT * FROM other", {"t": spark.range(1)})
    spark.range(5).createOrReplaceTempView("t")
    assert guard.ask(spark, "SELECT 'a--b' AS x, t.id FROM t JOIN u ON t.id = u.id -- both", {"t": spark.range(9), "u": spark.range(4)}, most_rows=3).count() == 3
    assert spark.table("t").count() == 5 and not spark.catalog.tableExists("u")  # the session's own views are as before
    spark.catalog.dropTempView("t")
