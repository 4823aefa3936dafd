"""Audits, exclusions and leads: orders are audit reports and filings, their line items findings; with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators import outside, risk
from filigree.plans.roles import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def flag(column: str, at: int, of: int):
    """True for one value of a key in `of`, null for the next, false for the rest."""
    k = F.col(column) % of
    return F.when(k == at, True).when(k != at + 1, False)


def reports(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    flags = [flag("o_orderkey", 3 + i, 40 + 7 * i).alias(c) for i, (c, _, _) in enumerate(outside.REPORT_FLAGS)]
    return table(spark, d, "orders").select(
        k.alias("report_id"), F.when(k % 19 != 0, F.col("o_custkey")).alias("auditee_ein"), F.when(k % 9 != 0, F.year("o_orderdate")).alias("audit_year"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("fy_end_date"),
        F.when(k % 3 == 0, F.concat(F.lit("ab-c"), F.lpad((F.col("o_custkey") % 500).cast("string"), 9, "0"))).otherwise("short").alias("auditee_uei"), F.when(F.year("o_orderdate") >= 1995, "current").otherwise("historic").alias("source_era"), *flags,
    )


def findings(spark: SparkSession, d: str) -> DataFrame:
    flags = [flag("l_partkey", 5 + i, 90 + 11 * i).alias(c) for i, (c, _, _) in enumerate(outside.FINDING_FLAGS)]
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id"), *flags)


def additional(spark: SparkSession, d: str) -> DataFrame:
    """Further numbers; some reports name their own number again, some aren't there."""
    o = table(spark, d, "orders").where("o_orderkey % 6 = 0")
    return o.select(F.when(F.col("o_orderkey") % 5 == 0, -F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey")).alias("report_id"), (F.col("o_custkey") + F.col("o_orderkey") % 2 + F.col("o_orderkey") % 4).alias("additional_ein"))


def filings(spark: SparkSession, d: str) -> DataFrame:
    """A year of a customer and its neighbours far away, most of which no report names."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    start = F.when(k % 7 == 0, "unknown").when(k % 7 == 1, F.lit(None).cast("string")).when(k % 7 == 2, "2024-10-01").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select((F.col("o_custkey") + 10_000_000 * (k % 2)).alias("ein"), F.year("o_orderdate").cast("long").alias("tax_year"), start.alias("period_start"), F.when(k % 11 != 0, F.floor(F.col("o_totalprice")) * 5).alias("government_grants"))


def named(spark: SparkSession, d: str) -> DataFrame:
    return outside.reports_of(reports(spark, d), additional(spark, d))


def sql_labels(flags: tuple, level: str, key: str, first: int, base: int, step: int, wrap: str) -> list[str]:
    return [f"CASE WHEN {wrap.format(f'{key} % {base + step * i} = {first + i}')} THEN '{label}' END" for i, (_, label, g) in enumerate(flags) if g == level]


def sql_issues() -> str:
    found = [f"bool_or(l_partkey % {90 + 11 * i} = {5 + i}) AS f{i}" for i in range(len(outside.FINDING_FLAGS))]
    lists = []
    for level in ("High", "Medium"):
        own = sql_labels(outside.REPORT_FLAGS, level, "o_orderkey", 3, 40, 7, "{}")
        more = [f"CASE WHEN f{i} THEN '{label}' END" for i, (_, label, g) in enumerate(outside.FINDING_FLAGS) if g == level]
        lists.append(f"concat_ws('; ', {', '.join(own + more)})")
    return f"""f AS (SELECT l_orderkey, {", ".join(found)} FROM lineitem GROUP BY l_orderkey),
i AS (SELECT o_orderkey AS report_id, CAST(year(o_orderdate) AS BIGINT) AS audit_year, {lists[0]} AS high, {lists[1]} AS medium FROM orders LEFT JOIN f ON l_orderkey = o_orderkey),
issues AS (SELECT report_id, audit_year, CASE WHEN high <> '' THEN 'High' ELSE 'Medium' END AS severity, concat_ws('; ', nullif(high, ''), nullif(medium, '')) AS issues FROM i WHERE high <> '' OR medium <> '')"""


NAMED = """n AS (SELECT o_custkey AS ein, o_orderkey AS report_id, 0 AS m FROM orders WHERE o_orderkey % 19 <> 0 UNION ALL SELECT o_custkey + o_orderkey % 2 + o_orderkey % 4, o_orderkey, 1 FROM orders WHERE o_orderkey % 6 = 0 AND o_orderkey % 5 <> 0),
named AS (SELECT ein, report_id, CASE min(m) WHEN 0 THEN 'primary_ein' ELSE 'additional_ein' END AS ein_match FROM n GROUP BY ein, report_id)"""


@query(f"WITH {sql_issues()}, {NAMED} SELECT ein, report_id, ein_match, audit_year, severity, issues FROM named JOIN issues USING (report_id)")
def audit_report_issues(spark: SparkSession, d: str) -> DataFrame:
    """Every report with issues at every filer that it names."""
    issues = outside.report_issues(reports(spark, d), findings(spark, d))
    return named(spark, d).join(issues, "report_id").withColumn("issues", F.array_join("issues", "; "))


INDICATORS = f"""{sql_issues()}, {NAMED},
y AS (SELECT o_custkey + 10000000 * (o_orderkey % 2) AS ein, CAST(year(o_orderdate) AS BIGINT) AS tax_year, CASE WHEN o_orderkey % 11 <> 0 THEN floor(o_totalprice) * 5 ELSE 0 END AS g, CASE WHEN o_orderkey % 7 <= 1 THEN NULL WHEN o_orderkey % 7 = 2 THEN 1000000 WHEN CAST(o_orderdate AS DATE) >= DATE '2024-10-01' THEN 1000000 ELSE 750000 END AS due FROM orders),
ly AS (SELECT ein, max(tax_year) AS tax_year FROM y GROUP BY ein),
u AS (SELECT DISTINCT o_custkey AS ein, 'ABC' || lpad(CAST(o_custkey % 500 AS VARCHAR), 9, '0') AS uei FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 19 <> 0),
x AS (SELECT 'ABC' || lpad(CAST(s_suppkey % 70 AS VARCHAR), 9, '0') AS uei, count(*) AS n FROM supplier GROUP BY 1),
ex AS (SELECT ein, CAST(sum(n) AS BIGINT) AS n_exclusions FROM u JOIN x USING (uei) GROUP BY ein),
ind AS (SELECT ein, audit_year AS tax_year, severity, 'Federal Audit' AS category, 'Federal Single Audit issues reported' AS title FROM named JOIN issues USING (report_id)
  UNION ALL SELECT ein, max(tax_year), 'Low', 'External Coverage', 'No FAC match despite large Form 990 government-grant revenue' FROM y WHERE g >= due AND ein NOT IN (SELECT ein FROM named) GROUP BY ein
  UNION ALL SELECT ein, tax_year, 'High', 'Federal Exclusions', 'Active SAM exclusion record returned for a FAC-linked UEI' FROM ex LEFT JOIN ly USING (ein)
  UNION ALL SELECT DISTINCT s_suppkey % 90 + 1, tax_year, 'Low', 'External Lead', 'OFAC or HHS exclusion name candidates require identity verification' FROM supplier LEFT JOIN ly ON ein = s_suppkey % 90 + 1
  UNION ALL SELECT DISTINCT s_suppkey % 40 + 1, tax_year, 'Low', 'External Lead', 'Federal lobbying client match' FROM supplier LEFT JOIN ly ON ein = s_suppkey % 40 + 1 WHERE s_suppkey % 2 = 0)"""


def exclusions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.concat(F.lit("ABC"), F.lpad((F.col("s_suppkey") % 70).cast("string"), 9, "0")).alias("uei"))


def indicators(spark: SparkSession, d: str) -> DataFrame:
    own, names, years = reports(spark, d), named(spark, d), filings(spark, d)
    latest, s = outside.latest_years(years), table(spark, d, "supplier")
    return outside.all_outside(
        outside.audit_issues(names, outside.report_issues(own, findings(spark, d))), outside.missing_audits(years, names), outside.excluded(own, exclusions(spark, d), latest),
        outside.leads("screening", s.select((F.col("s_suppkey") % 90 + 1).alias("ein")), latest), outside.leads("lobbying", s.where("s_suppkey % 2 = 0").select((F.col("s_suppkey") % 40 + 1).alias("ein")), latest),
    )


@query(f"WITH {INDICATORS} SELECT * FROM ind")
def risk_outside(spark: SparkSession, d: str) -> DataFrame:
    return indicators(spark, d)


@query(f"WITH {INDICATORS} SELECT ein, tax_year, n_exclusions FROM ex LEFT JOIN ly USING (ein)")
def excluded_filers(spark: SparkSession, d: str) -> DataFrame:
    return outside.excluded(reports(spark, d), exclusions(spark, d), outside.latest_years(filings(spark, d))).select("ein", "tax_year", "n_exclusions")


@query(
    f"""WITH {INDICATORS}, t AS (SELECT ein, category, title, max(CASE severity WHEN 'High' THEN 20 ELSE 9 END) AS w, count(*) AS n FROM ind WHERE category NOT LIKE 'External%' GROUP BY ein, category, title),
c AS (SELECT ein, category, least(30, sum(w + least(8, (n - 1) * CASE w WHEN 20 THEN 2 ELSE 1 END))) AS p FROM t GROUP BY ein, category) SELECT ein, CAST(least(100, sum(p)) AS BIGINT) AS risk_score FROM c GROUP BY ein"""
)
def risk_outside_score(spark: SparkSession, d: str) -> DataFrame:
    """Audits and exclusions carry points, coverage and leads none."""
    return risk.score(indicators(spark, d))


@query(
    """WITH d AS (SELECT 'awards' AS part, l_orderkey AS r FROM lineitem UNION ALL SELECT 'additional_eins', CASE WHEN o_orderkey % 5 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END FROM orders WHERE o_orderkey % 6 = 0 UNION ALL SELECT 'texts', CASE WHEN p_partkey % 3 <> 0 THEN p_partkey END FROM part)
SELECT 'reports' AS part, e.era, CAST(min(year(o_orderdate)) AS BIGINT) AS first_year, CAST(max(year(o_orderdate)) AS BIGINT) AS last_year, count(o_orderkey) AS n, CAST(NULL AS BIGINT) AS n_orphans
  FROM (VALUES ('current'), ('historic')) e(era) LEFT JOIN orders ON (year(o_orderdate) >= 1995) = (era = 'current') GROUP BY e.era
UNION ALL SELECT part, '', NULL, NULL, count(*), count(*) FILTER (o_orderkey IS NULL) FROM d LEFT JOIN orders ON o_orderkey = r GROUP BY part
UNION ALL SELECT 'rejected', '', NULL, NULL, count(*), NULL FROM supplier"""
)
def audit_coverage(spark: SparkSession, d: str) -> DataFrame:
    own = reports(spark, d).withColumn("audit_year", F.substring("fy_end_date", 1, 4).cast("int"))
    texts = table(spark, d, "part").select(F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey")).alias("report_id"))
    return outside.coverage(own, {"awards": findings(spark, d), "additional_eins": additional(spark, d), "texts": texts}, table(spark, d, "supplier"))
