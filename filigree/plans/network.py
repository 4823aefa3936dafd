"""Queries on timeliness, relationships and risk, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators import aggs, compliance, joins, network, risk, sets
from filigree.plans import graph
from filigree.plans.roles import FLOWS, GRANTS, PAIRS, RETURNS, flows, grants, returns, table, with_

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


REPORTS = """reports AS (SELECT o_custkey AS f_num, make_date(year(o_orderdate), 12, 31) AS period_end, o_orderkey AS rpt_id, CAST(o_orderkey % 3 = 0 AS INTEGER) AS amendment,
  CAST(o_orderdate AS DATE) + CAST(200 + o_orderkey % 300 AS INTEGER) AS receive_date, CAST(o_orderkey % 17 = 0 AS INTEGER) AS hardship FROM orders)"""


def reports(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("f_num"), F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31)).alias("period_end"), k.alias("rpt_id"), (k % 3 == 0).cast("int").alias("amendment"),
        F.date_add(F.col("o_orderdate").cast("date"), (200 + k % 300).cast("int")).alias("receive_date"), (k % 17 == 0).cast("int").alias("hardship"),
    )


@query(
    with_(
        REPORTS,
        """ranked AS (SELECT *, row_number() OVER (PARTITION BY f_num, period_end ORDER BY amendment, receive_date NULLS LAST, rpt_id) AS o,
  row_number() OVER (PARTITION BY f_num, period_end ORDER BY receive_date DESC NULLS LAST, amendment DESC, rpt_id DESC) AS l FROM reports)""",
        """p AS (SELECT f_num, period_end, max(CASE WHEN o = 1 AND amendment = 0 THEN rpt_id END) AS original_rpt_id, max(CASE WHEN o = 1 AND amendment = 0 THEN receive_date END) AS received,
  max(CASE WHEN l = 1 THEN rpt_id END) AS latest_rpt_id, max(hardship) AS hardship FROM ranked GROUP BY f_num, period_end)""",
    )
    + """SELECT f_num, period_end, original_rpt_id, latest_rpt_id, CAST(greatest(0, coalesce(received - (period_end + 90), 0)) AS INTEGER) AS days_late,
  CASE WHEN original_rpt_id IS NULL OR received IS NULL THEN 'ORIGINAL_NOT_OBSERVED' WHEN received > period_end + 90 AND hardship = 1 THEN 'HARDSHIP_REVIEW'
       WHEN received > period_end + 90 THEN 'FILED_LATE' ELSE 'FILED_ON_TIME' END AS status FROM p"""
)
def period_timeliness(spark: SparkSession, d: str) -> DataFrame:
    return compliance.filing_periods(reports(spark, d)).select("f_num", "period_end", "original_rpt_id", "latest_rpt_id", "days_late", "status")


@query(
    with_(
        "ends AS (SELECT DISTINCT o_custkey AS f_num, make_date(year(o_orderdate), 12, 31) AS e FROM orders)",
        "orgs AS (SELECT c_custkey AS f_num, CAST(c_custkey % 10 = 0 AS INTEGER) AS terminated FROM customer)",
        "n AS (SELECT *, lead(e) OVER (PARTITION BY f_num ORDER BY e) AS nx, max(e) OVER (PARTITION BY f_num) AS last_end, count(*) OVER (PARTITION BY f_num) AS c FROM ends)",
        "s AS (SELECT n.*, terminated FROM n JOIN orgs USING (f_num))",
        "j AS (SELECT * FROM s WHERE terminated = 0 AND c >= 2 AND nx IS NOT NULL)",
    )
    + """SELECT f_num, make_date(y, 12, 31) AS expected_end, 'HISTORICAL_GAP' AS result FROM (SELECT f_num, unnest(generate_series(year(e) + 1, year(nx) - 1)) AS y FROM j WHERE year(nx) - year(e) > 1) WHERE make_date(y, 12, 31) + 90 <= DATE '2002-06-30'
UNION ALL SELECT f_num, NULL, 'FYE_CHANGED_REVIEW' FROM j WHERE nx = last_end AND year(nx) - year(e) <> 1
UNION ALL SELECT f_num, make_date(year(nx) + 1, 12, 31), 'CURRENT_EXPECTATION' FROM j WHERE nx = last_end AND year(nx) - year(e) = 1 AND make_date(year(nx) + 1, 12, 31) + 90 <= DATE '2002-06-30'
UNION ALL SELECT DISTINCT f_num, NULL::DATE, 'TERMINATED' FROM s WHERE terminated = 1
UNION ALL SELECT DISTINCT f_num, NULL::DATE, 'INSUFFICIENT_HISTORY' FROM s WHERE terminated = 0 AND c < 2"""
)
def compliance_expectations(spark: SparkSession, d: str) -> DataFrame:
    orgs = table(spark, d, "customer").select(F.col("c_custkey").alias("f_num"), (F.col("c_custkey") % 10 == 0).cast("int").alias("terminated"))
    return compliance.expectations(reports(spark, d), orgs, F.lit("2002-06-30").cast("date"))


def edge_sql(source: str, row: str, kind: str, target: str, confidence: str, scored: str, rows: str) -> str:
    made = f"sha256(concat_ws(chr(31), {source}, {row}, {kind}, CAST(ein AS VARCHAR), {target})) AS edge_id, {kind} AS edge_type, ein AS source_ein, {target} AS target_key, tax_year, {confidence}::DOUBLE AS confidence, {scored} AS scored"
    return f"SELECT {made} FROM {rows}"


ROW = "concat_ws('-', CAST(filing_id AS VARCHAR), CAST(recipient AS VARCHAR), CAST(part AS VARCHAR), CAST(cash AS VARCHAR))"
LINES = "lines AS (SELECT ein, tax_year, filing_id, recipient, part, cash FROM grants JOIN returns USING (filing_id))"
# five kinds of edges: grants, people, contractors, related organisations, addresses
EDGES = ",\n".join((
    LINES,
    """gr AS (SELECT *, CASE WHEN recipient % 10 = 0 THEN 'orgname:CAFE ORG ' || recipient ELSE 'ein:' || lpad(CAST(recipient AS VARCHAR), 9, '3') END AS t, CASE WHEN amount > 50000 THEN 0.9 ELSE 0.7 END AS c FROM pairs JOIN returns USING (filing_id))""",
    "pe AS (SELECT *, CASE part % 9 WHEN 0 THEN 'NONE' WHEN 1 THEN '' WHEN 2 THEN 'SOLO' || (part % 50) WHEN 3 THEN 'NOT APPLICABLE' ELSE 'JO SMITH ' || (part % 50) END AS nm FROM lines)",
    "co AS (SELECT *, CASE recipient % 7 WHEN 0 THEN 'VARIOUS' WHEN 1 THEN '' WHEN 2 THEN 'ABC' ELSE 'BUILD IT ' || (recipient % 50) END AS nm FROM lines)",
    """re AS (SELECT *, ['schedule_r_related_tax_exempt', 'schedule_r_related_taxable_corp_trust', 'schedule_r_related_taxable_partnership', 'schedule_r_unrelated_taxable_partnership', 'schedule_r_disregarded_entity', 'schedule_r_related_transaction'][part % 6 + 1] AS kind,
  CASE WHEN part % 3 = 0 THEN 'ein:12' || lpad(CAST(recipient AS VARCHAR), 7, '0') END AS e, trim(CASE WHEN recipient % 4 <> 0 THEN 'SISTER ORG' ELSE '' END || CASE WHEN recipient % 2 = 0 THEN ' UNIT ' || (recipient % 10) ELSE '' END) AS nm FROM lines)""",
    "ad AS (SELECT c_custkey AS ein, 2000 AS tax_year, 'address:' || substr(sha256(concat_ws('|', CAST(c_nationkey AS VARCHAR), c_mktsegment)), 1, 32) AS t FROM customer)",
    "edges AS (" + " UNION ALL ".join((
        edge_sql("'grants'", "CAST(filing_id AS VARCHAR)", "'grant_paid'", "t", "c", "recipient % 10 <> 0 AND amount > 50000 AND (recipient % 3 = 0 OR recipient % 7 > 1)", "gr"),
        edge_sql("'officers'", ROW, "'person_role'", "'person:' || nm", "CASE WHEN nm LIKE 'JO SMITH%' THEN 0.9 ELSE 0.55 END", "nm LIKE 'JO SMITH%'", "pe WHERE nm <> ''"),
        edge_sql("'contractors'", ROW, "'contractor_payment'", "'contractor:' || nm", "CASE WHEN nm LIKE 'BUILD%' THEN 0.88 ELSE 0.5 END", "nm LIKE 'BUILD%'", "co WHERE nm <> ''"),
        edge_sql("kind", ROW, "kind", "coalesce(e, 'schedr-name:' || nm)", "CASE WHEN e IS NOT NULL THEN 1.0 ELSE 0.6 END", "e IS NOT NULL AND part % 6 < 3", "re WHERE e IS NOT NULL OR nm <> ''"),
        edge_sql("'filers'", "CAST(ein AS VARCHAR)", "'filed_address'", "t", "1.0", "true", "ad"),
    )) + ")",
))


def all_edges(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("recipient")
    # dealt by the key of the join, which groups pairs as well
    pairs = sets.dealt(grants(spark, d).select("filing_id", "recipient", "cash"), "filing_id").groupBy("filing_id", "recipient").agg(F.round(F.sum("cash"), 2).alias("amount"))
    paid = pairs.join(returns(spark, d).select("filing_id", "ein", "tax_year"), "filing_id").withColumns({
        "recipient_ein": F.when(r % 10 != 0, F.lpad(r.cast("string"), 9, "3")), "recipient_name": F.concat(F.lit("Café  Org "), r.cast("string")), "confidence": F.when(F.col("amount") > 50000, 0.9).otherwise(0.7),
        "match_status": F.when(r % 7 == 0, "Unresolved").when(r % 7 == 1, "conflicting_ein_match").otherwise("ein_exact"), "match_source": F.when(r % 3 == 0, "AI_assisted").otherwise("deterministic"),
    })
    grant = network.grant_edges(paid, source="grants", row_id=F.col("filing_id"))
    filers = table(spark, d, "customer").withColumnRenamed("c_custkey", "ein").withColumn("tax_year", F.lit(2000).cast("long"))
    address = network.edges(filers, kind="filed_address", source="filers", row_id=F.col("ein"), target=network.address_key(F.col("c_nationkey").cast("string"), F.col("c_mktsegment")), confidence=F.lit(1.0), scored=F.lit(True))
    return reduce(DataFrame.unionByName, (grant, graph.line_edges(graph.lines(spark, d)), address))


@query(with_(RETURNS, GRANTS, PAIRS, EDGES) + "SELECT edge_id, edge_type, source_ein, target_key, tax_year, confidence, scored FROM edges")
def edges_all_sources(spark: SparkSession, d: str) -> DataFrame:
    return all_edges(spark, d)


@query(
    with_(RETURNS, GRANTS, PAIRS, EDGES)
    + "SELECT target_key, count(DISTINCT source_ein) AS distinct_org_count, count(*) AS edge_count, min(tax_year) AS first_tax_year, max(tax_year) AS last_tax_year, CAST(coalesce(CASE WHEN target_key LIKE 'address:%' OR target_key LIKE 'contractor:%' THEN count(DISTINCT source_ein) > 50 WHEN target_key LIKE 'person:%' THEN count(DISTINCT source_ein) > 25 END, false) AS INTEGER) AS is_hub FROM edges GROUP BY target_key"
)
def hub_stats(spark: SparkSession, d: str) -> DataFrame:
    return network.node_stats(all_edges(spark, d))


@query(
    with_(
        RETURNS, GRANTS, "s AS (SELECT DISTINCT ein, part FROM grants JOIN returns USING (filing_id))", "ok AS (SELECT part FROM s GROUP BY part HAVING count(*) <= 25)",
        "k AS (SELECT s.* FROM s JOIN ok USING (part))",
    )
    + "SELECT a.ein, b.ein AS other, count(*) AS shared FROM k a JOIN k b ON a.part = b.part AND a.ein < b.ein GROUP BY a.ein, b.ein"
)
def shared_neighbors(spark: SparkSession, d: str) -> DataFrame:
    edges = grants(spark, d).join(returns(spark, d).select("filing_id", "ein"), "filing_id").select("ein", "part")
    return joins.shared_targets(edges, "ein", "part", hub_over=25)


@query(
    with_(RETURNS, GRANTS, FLOWS, "e AS (SELECT ein, recipient, tax_year AS y FROM flows)")
    + "SELECT f.ein AS a, count(*) AS n_paths, count(DISTINCT s.recipient) AS n_ends FROM e f JOIN e s ON s.ein = f.recipient WHERE s.y - f.y BETWEEN 0 AND 2 AND f.recipient <> s.recipient AND f.ein <> f.recipient GROUP BY f.ein"
)
def two_hop_paths(spark: SparkSession, d: str) -> DataFrame:
    paths = joins.two_hops(flows(spark, d).select("ein", "recipient", F.col("tax_year").alias("y")), "ein", "recipient", "y")
    return sets.dealt(paths.select("a", "c"), "a", "c").groupBy("a").agg(F.count("*").alias("n_paths"), F.countDistinct("c").alias("n_ends"))


@query(
    with_(RETURNS, GRANTS, FLOWS)
    + "SELECT x.ein AS a, x.recipient AS b, x.tax_year AS y1, y.tax_year AS y2, x.amount AS amount_there, y.amount AS amount_back FROM flows x JOIN flows y ON y.ein = x.recipient AND y.recipient = x.ein WHERE x.ein < x.recipient AND abs(x.tax_year - y.tax_year) <= 2"
)
def reciprocal_flows(spark: SparkSession, d: str) -> DataFrame:
    return joins.reciprocal(flows(spark, d), "ein", "recipient", "tax_year").select("a", "b", "y1", "y2", "amount_there", "amount_back")


@query(
    with_(GRANTS, RETURNS, "s AS (SELECT filing_id, sum(cash) AS s FROM grants GROUP BY filing_id)")
    + """SELECT filing_id, total AS core, round(coalesce(s, 0), 2) AS detail, abs(round(coalesce(s, 0), 2) - total) >= greatest(10000, 0.2 * total) AS material, round(coalesce(s, 0), 2) > 1.25 * total AS inflated
FROM returns LEFT JOIN s USING (filing_id)"""
)
def reconcile_detail_core(spark: SparkSession, d: str) -> DataFrame:
    detail = grants(spark, d).groupBy("filing_id").agg(F.round(F.sum("cash"), 2).alias("amount"))
    return aggs.reconcile(detail, returns(spark, d).select("filing_id", F.col("total").alias("core")), ["filing_id"])


SHARES = "shares AS (SELECT ein, tax_year, round(sum(amount), 2) AS total, max(amount) AS largest, count(*) AS n_parts FROM flows GROUP BY ein, tax_year)"


@query(with_(RETURNS, GRANTS, FLOWS, SHARES) + "SELECT ein, tax_year, total, largest, n_parts, round(CASE WHEN total = 0 THEN 0 ELSE largest / total END, 6) AS largest_share FROM shares")
def concentration_share(spark: SparkSession, d: str) -> DataFrame:
    out = aggs.concentration(graph.lines(spark, d), ["ein", "tax_year"], "recipient", "cash", places=2)
    return out.select("ein", "tax_year", F.round("total", 2).alias("total"), "largest", "n_parts", F.round("largest_share", 6).alias("largest_share"))


YEARS = """years AS (SELECT ein, tax_year, round(sum(total), 2) AS revenue, round(sum(s), 2) AS expenses, round(sum(total) - 200000, 2) AS net_assets, sum(total) AS assets, sum(total) * (ein % 10) / 10.5 AS liabilities, ein % 4 AS employees,
  sum(s) * (ein % 5) / 5 AS grants_paid, sum(s) * (ein % 7) / 28 AS lobbying FROM returns JOIN (SELECT filing_id, round(sum(cash), 2) AS s FROM grants GROUP BY filing_id) USING (filing_id) GROUP BY ein, tax_year)"""
INDICATORS = """ind AS (
  SELECT ein, tax_year, CASE WHEN abs(revenue - expenses) / greatest(revenue, expenses, 1) >= 0.25 THEN 'High' ELSE 'Medium' END AS severity, 'Financial' AS category, 'Operating deficit' AS title FROM years WHERE revenue - expenses < 0
  UNION ALL SELECT ein, tax_year, 'High', 'Financial', 'Negative net assets' FROM years WHERE net_assets < 0
  UNION ALL SELECT ein, tax_year, 'Medium', 'Financial', 'High liability-to-asset ratio' FROM years WHERE net_assets >= 0 AND ein % 10 = 9
  UNION ALL SELECT ein, tax_year, 'Medium', 'Operations', 'High expenses with zero employees' FROM years WHERE expenses >= 500000 AND employees = 0
  UNION ALL SELECT ein, tax_year, 'Medium', 'Grants', 'Grants dominate expenses' FROM years WHERE expenses > 0 AND ein % 5 = 4
  UNION ALL SELECT ein, tax_year, CASE WHEN ein % 7 >= 6 THEN 'High' ELSE 'Medium' END, 'Political', 'Material lobbying expense' FROM years WHERE expenses > 0 AND ein % 7 >= 2)"""


def years(spark: SparkSession, d: str) -> DataFrame:
    spent = grants(spark, d).groupBy("filing_id").agg(F.round(F.sum("cash"), 2).alias("s"))
    total, s, ein = F.sum("total"), F.sum("s"), F.col("ein")
    return returns(spark, d).join(spent, "filing_id").groupBy("ein", "tax_year").agg(
        F.round(total, 2).alias("revenue"), F.round(s, 2).alias("expenses"), F.round(total - 200000, 2).alias("net_assets"), total.alias("assets"), (total * (ein % 10) / 10.5).alias("liabilities"),
        F.first(ein % 4).alias("employees"), (s * (ein % 5) / 5).alias("grants_paid"), (s * (ein % 7) / 28).alias("lobbying"),
    )


@query(with_(RETURNS, GRANTS, YEARS, INDICATORS) + "SELECT ein, tax_year, severity, category, title FROM ind")
def indicator_union(spark: SparkSession, d: str) -> DataFrame:
    return risk.financial(years(spark, d))


@query(
    with_(
        RETURNS, GRANTS, YEARS, INDICATORS,
        "t AS (SELECT ein, category, title, max(CASE severity WHEN 'High' THEN 20 WHEN 'Medium' THEN 9 ELSE 3 END) AS w, count(*) AS n FROM ind GROUP BY ein, category, title)",
        "c AS (SELECT ein, category, least(30, sum(w + least(8, (n - 1) * CASE WHEN w = 20 THEN 2 ELSE 1 END))) AS p FROM t GROUP BY ein, category)",
    )
    + "SELECT ein, CAST(least(100, sum(p)) AS BIGINT) AS risk_score FROM c GROUP BY ein"
)
def risk_score(spark: SparkSession, d: str) -> DataFrame:
    return risk.score(risk.financial(years(spark, d)))
