import pytest
from pyspark.sql import functions as F

from filigree.functions import paths, search
from filigree.operators import risk, risk_families, views


def test_parameters():
    assert search.id_list("12-3456789, 987654321;123456789\n1234") == ["123456789", "987654321"] and search.id_list(None) == []
    assert search.bounds(None, 3) == (3, 3) and search.bounds(5, 2) == (2, 5) and search.bounds(None, None) is None


@pytest.mark.parametrize(
    ("a", "b", "score"),
    [("The Acme Fund, Inc.", "ACME FUND", 0.97), ("Acme Fund", "acme  fund.", 1.0), ("The Acme Fund", "Acme Fund", 0.99), ("Acme Incorporated", "Acme", 0.99), ("Acme", "Bcme", 0.0), (None, None, 0.0), ("Acme & Sons", "ACME AND SONS", 1.0), ("Inc", "Co", 0.0)],
)
def test_forms_of_names(spark, a, b, score):
    """A name without THE has its form without suffix in second place, so that one counts 0.99."""
    df = spark.createDataFrame([(a, b)], "a string, b string").select(search.name_forms(F.col("a")).alias("x"), search.name_forms(F.col("b")).alias("y"))
    assert df.select(search.form_score(F.col("x"), F.col("y"))).first()[0] == score


def test_distinctive_names(spark):
    rows = [("Springfield Orphan Relief Guild Society", "CA", True), ("Springfield Orphan Relief Guild Society", "", False), ("Cash", "CA", False), ("Short Co", "CA", False), (None, "CA", False)]
    df = spark.createDataFrame([(n, s) for n, s, _ in rows], "n string, s string")
    assert [r[0] for r in df.select(search.distinctive_name(F.col("n"), F.col("s"), ("CA", "NY"))).collect()] == [w for _, _, w in rows]


def test_foundations_may_have_no_employees_and_make_grants(spark):
    years = spark.createDataFrame([(1, 2020, False), (2, 2020, True), (3, 2020, None)], "ein int, tax_year int, private_foundation boolean")
    full = years.selectExpr("*", "1e6 AS revenue", "1e6 AS expenses", "1.0 AS net_assets", "10.0 AS assets", "0.0 AS liabilities", "0 AS employees", "9e5 AS grants_paid", "0.0 AS lobbying")
    assert sorted((r.ein, r.title) for r in risk.financial(full).collect()) == [(e, t) for e in (1, 3) for t in ("Grants dominate expenses", "High expenses with zero employees")]


def test_periods_and_shares(spark):
    df = spark.createDataFrame([("2020-01-01", "2020-12-31"), ("2020-05-01", "2020-04-30"), ("x", "2020-01-01")], "a string, b string")
    assert [r[0] for r in df.select(risk_families.period_days(F.col("a"), F.col("b"))).collect()] == [366, None, None]
    shares = spark.createDataFrame([(1, 2020, 0.5, 0.3, 2), (2, 2020, 0.1, 0.3, 1)], "ein int, tax_year int, total_share double, largest_share double, n_parts int")
    assert [(r.ein, r.severity) for r in risk.share_indicators(shares, total=0.3, single=0.2, category="c", titles=("a", "b")).orderBy("severity").collect()] == [(1, "Low"), (1, "Medium")]
    starts = spark.createDataFrame([("2024-09-30",), ("2024-10-01",)], "d string").select(risk.audit_threshold(F.col("d").cast("date")))
    assert [r[0] for r in starts.collect()] == [750_000, 1_000_000]


def test_budget_keeps_the_first_branch_first(spark):
    a, b = spark.range(5).toDF("v"), spark.range(3, 9).toDF("v")
    assert [r.v for r in views.within_budget([(a, [F.desc("v")]), (b, [F.col("v")])], 7).collect()] == [4, 3, 2, 1, 0]
    assert views.within_budget([(a, [F.desc("v")]), (b.limit(0), [F.col("v")])], 2).count() == 2


@pytest.mark.parametrize(
    ("path", "portable", "hint"),
    [("a//b/./c.xml", "a/b/c.xml", "a/b/c.xml"), ("a\\b.xml", "a/b.xml", "a/b.xml"), ("/a/b", None, "a/b"), ("C:/a/b", None, "a/b"), ("a/../b", None, None), ("", None, None), (None, None, None), ("C:", None, None)],
)
def test_paths(spark, path, portable, hint):
    df = spark.createDataFrame([(path,)], "p string")
    assert tuple(df.select(paths.portable_path(F.col("p")), paths.path_hint(F.col("p"))).first()) == (portable, hint)


def test_values_by_affinity(spark):
    rows = [(None, ("null", None, None, None)), ("12", ("integer", 12, None, None)), (" 1.0 ", ("integer", 1, None, None)), ("1e3", ("integer", 1000, None, None)), ("1.5", ("real", None, 1.5, None)), ("9223372036854775808", ("real", None, 9223372036854775808.0, None)), ("x1", ("text", None, None, "x1")), (" ", ("text", None, None, " ")), ("NaN", ("text", None, None, "NaN"))]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(rows)], "i int, v string").select("i", paths.numeric_affinity(F.col("v")).alias("a"))
    assert [tuple(r.a) for r in df.orderBy("i").collect()] == [w for _, w in rows]


def test_client_names(spark):
    rows = [("Acme Relief Inc", "THE ACME RELIEF", "NY", "ny", "exact"), ("Acme Relief", "Acme Relief Fund", "", "CA", ""), ("Acme Relief Guild West", "Acme Relief Guild East West", "NY", None, "strong"), ("Acme", "Acme", "NY", "CA", ""), ("Inc", "Acme", "", "", ""), ("Foundations of Light", "Foundation of Lights", "", "", "strong")]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, q string, k string, s string, t string")
    got = [r[0] for r in df.orderBy("i").select(paths.client_strength(F.col("q"), F.col("k"), F.col("s"), F.col("t"))).collect()]
    assert got == [r[4] for r in rows]
