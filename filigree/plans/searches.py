"""Queries on searches, unions and projections, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.functions import paths, search
from filigree.operators import aggs, risk_families, unions, views, windows
from filigree.plans.filings import canonical
from filigree.plans.risk_families import HEAD, RES, resolved
from filigree.plans.roles import CANONICAL, FLOWS, GRANTS, RETURNS, flows, grants, returns, table, with_

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(
    """SELECT c_custkey, CASE WHEN a = b THEN a ELSE a || ',' || b END AS ids, c_custkey % 2 = 0 AS nine
FROM (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS a, '1234' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS b FROM customer)"""
)
def ein_list_parse(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    nine, five = F.lpad(key, 9, "0"), F.lpad(key, 5, "0")
    text = F.concat(F.lit(" "), nine, F.lit(", 12-34"), five, F.lit(";;"), nine, F.lit("\n99"))
    checked = search.nine_digits(F.when(F.col("c_custkey") % 2 == 0, nine).when(F.col("c_custkey") % 3 == 0, F.concat(nine, F.lit("x"))))
    return table(spark, d, "customer").select("c_custkey", F.array_join(search.id_lists(text), ",").alias("ids"), checked.alias("nine"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0 AND year(o_orderdate) BETWEEN 1995 AND 1997")
def year_from_text(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 5 == 0, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").where(search.in_years(search.year_of(text), 1997, 1995)).select("o_orderkey")


NAME_A = "CASE p_partkey % 7 WHEN 0 THEN 'The ' || p_name || ', Inc.' WHEN 1 THEN p_name || ' Corporation ' WHEN 2 THEN 'the ' || p_name WHEN 3 THEN p_name || ' & Sons (Co.)' WHEN 4 THEN NULL WHEN 5 THEN 'Co Ltd' ELSE p_name END"
NAME_B = "CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' Corp' WHEN 2 THEN 'THE ' || p_name || ' LLC' WHEN 3 THEN p_name || ' AND SONS' ELSE 'Co Ltd' END"


def forms_sql(c: str) -> str:
    padded = f"' ' || replace(upper(coalesce({c}, '')), '&', ' AND ') || ' '"
    for long, short in (("INCORPORATED", "INC"), ("CORPORATION", "CORP"), ("LIMITED", "LTD"), ("COMPANY", "CO")):
        padded = f"replace({padded}, ' {long} ', ' {short} ')"
    core = f"trim(regexp_replace(regexp_replace({padded}, '[.,''\"()/\\\\-]+', ' ', 'g'), '\\s+', ' ', 'g'))"
    the = f"regexp_replace({core}, '^THE( |$)', '')"

    def bare(x: str) -> str:
        return f"trim(regexp_replace({x}, '(( |^)(INC|CORP|CO|LTD|LLC))+$', ''))"

    return f"[{core}, {the}, {bare(core)}, {bare(the)}]"


@query(
    f"""WITH n AS (SELECT p_partkey, {NAME_A} AS a, {NAME_B} AS b FROM part),
f AS (SELECT p_partkey, list_filter({forms_sql('a')}, lambda x: x <> '') AS x, list_filter({forms_sql('b')}, lambda x: x <> '') AS y FROM n),
u AS (SELECT p_partkey, list_filter(x, lambda v, i: list_position(x, v) = i) AS x, list_filter(y, lambda v, i: list_position(y, v) = i) AS y FROM f)
SELECT p_partkey, array_to_string(x, '|') AS forms, CASE WHEN x[1] = y[1] THEN 1.0 WHEN x[2] = y[1] OR x[2] = y[2] OR y[2] = x[1] THEN 0.99 WHEN x[3] = y[1] OR x[3] = y[3] OR y[3] = x[1] THEN 0.98
  WHEN list_contains(y, x[4]) OR list_contains(x, y[4]) THEN 0.97 ELSE 0 END::DOUBLE AS score FROM u"""
)
def name_forms_and_score(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select("p_partkey", F.expr(NAME_A).alias("a"), F.expr(NAME_B).alias("b"))
    forms = names.select("p_partkey", search.name_forms(F.col("a")).alias("x"), search.name_forms(F.col("b")).alias("y"))
    return forms.select("p_partkey", F.array_join("x", "|").alias("forms"), search.form_score(F.col("x"), F.col("y")).alias("score"))


@query(
    """SELECT p_partkey, p_name, CASE WHEN lower(n) = 'cold widget' THEN 100 WHEN lower(n) LIKE 'cold widget%' THEN 90 WHEN lower(n) LIKE 'the cold widget%' THEN 85 WHEN lower(n) LIKE '%cold widget%' THEN 75 ELSE 50 END::INTEGER AS relevance
FROM (SELECT *, trim(CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' shop' WHEN 2 THEN 'The ' || p_name ELSE 'old ' || p_name END) AS n FROM part) ORDER BY relevance DESC, p_size DESC, p_name, p_partkey LIMIT 25"""
)
def name_relevance(spark: SparkSession, d: str) -> DataFrame:
    name, k = F.col("p_name"), F.col("p_partkey") % 4
    full = F.when(k == 0, name).when(k == 1, F.concat(name, F.lit(" shop"))).when(k == 2, F.concat(F.lit("The "), name)).otherwise(F.concat(F.lit("old "), name))
    scored = table(spark, d, "part").withColumn("relevance", search.relevance(full, " Cold Widget "))
    return scored.orderBy(F.desc("relevance"), F.desc("p_size"), "p_name", "p_partkey").limit(25).select("p_partkey", "p_name", "relevance")


UNION_NAME = "CASE c_custkey % 6 WHEN 0 THEN 'Springfield Teachers' WHEN 1 THEN 'American  Federation of Teachers Nurses' WHEN 2 THEN 'Dock Workers & Co' WHEN 3 THEN 'Faculty Guild' WHEN 4 THEN NULL ELSE 'Hospital Staff' END"
AFFILIATION = "CASE c_custkey % 4 WHEN 0 THEN 'nea' WHEN 1 THEN 'AFT' WHEN 2 THEN 'SEIU' END"
SCOPE_SQL = """CASE WHEN aff = 'NEA' THEN 'likely_education' WHEN (aff = 'AFT' OR n LIKE '%AMERICAN FEDERATION OF TEACHERS%') AND (n LIKE '%NURSE%' OR n LIKE '%HOSPITAL%') AND n NOT LIKE '%TEACHER%' AND n NOT LIKE '%FACULTY%' THEN 'uncertain'
  WHEN aff = 'AFT' OR n LIKE '%AMERICAN FEDERATION OF TEACHERS%' THEN 'education_or_mixed' WHEN n LIKE '%TEACHER%' OR n LIKE '%FACULTY%' THEN 'likely_education' ELSE 'uncertain' END"""
SCOPES = f"scopes AS (SELECT *, {SCOPE_SQL} AS scope FROM (SELECT c_custkey, upper(coalesce({AFFILIATION}, '')) AS aff, regexp_replace(upper(coalesce({UNION_NAME}, '')), '\\s+', ' ', 'g') AS n FROM customer))"


@query(with_(SCOPES) + "SELECT c_custkey, scope, scope IN ('likely_education', 'education_or_mixed', 'manual_include') AS education, aff IN ('NEA', 'AFT') AS nea_aft FROM scopes")
def education_scopes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.expr(AFFILIATION).alias("affiliation"), F.expr(UNION_NAME).alias("n"))
    named = rows.withColumn("education_scope", search.education_scope(F.col("affiliation"), F.col("n"))["scope"])
    return named.select("c_custkey", F.col("education_scope").alias("scope"), search.in_scope("education").alias("education"), search.in_scope("nea_aft").alias("nea_aft"))


UF = """uf AS (SELECT o_custkey % 97 AS f_num, o_orderkey AS rpt_id, CASE WHEN o_orderkey % 13 <> 0 THEN strftime(o_orderdate, '%Y') || '-12-31' END AS pd_covered_to, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS receive_date,
  CASE WHEN o_orderkey % 41 = 0 THEN 't' END AS terminate, CASE WHEN o_orderkey % 43 = 0 THEN '1999-01-01' END AS term_date, CASE o_custkey % 3 WHEN 0 THEN ' Unit  ' || (o_custkey % 97) WHEN 1 THEN '  ' END AS unit_name, o_orderpriority AS union_name,
  CASE o_custkey % 97 % 5 WHEN 0 THEN 'NEA' WHEN 1 THEN 'AFT' END AS aff_abbr FROM orders)"""
ORGS = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY f_num ORDER BY coalesce(pd_covered_to, '') DESC, coalesce(receive_date, '') DESC, rpt_id DESC) AS rn FROM uf) WHERE rn = 1),
sums AS (SELECT f_num, min(pd_covered_to) AS first_period_end, max(pd_covered_to) AS latest_period_end, max(receive_date) AS latest_report_received, count(*) AS filing_count FROM uf GROUP BY f_num),
orgs AS (SELECT f_num, CASE WHEN trim(coalesce(unit_name, '')) <> '' THEN trim(regexp_replace(unit_name, '\\s+', ' ', 'g')) ELSE union_name END AS display_name, aff_abbr AS affiliation, first_period_end, latest_period_end, latest_report_received,
  CAST(terminate IS NOT NULL OR term_date IS NOT NULL AS INTEGER) AS terminated, rpt_id AS latest_rpt_id, filing_count,
  CASE WHEN f_num % 11 = 0 THEN 'manual_include' WHEN f_num % 11 = 1 THEN 'manual_exclude' WHEN aff_abbr = 'NEA' THEN 'likely_education' WHEN aff_abbr = 'AFT' THEN 'education_or_mixed' ELSE 'uncertain' END AS education_scope,
  CASE WHEN f_num % 11 = 0 THEN 'seen' WHEN f_num % 11 = 1 THEN 'Manual exclude' WHEN aff_abbr = 'NEA' THEN 'NEA affiliation or name' WHEN aff_abbr = 'AFT' THEN 'AFT affiliation or name' ELSE 'No deterministic education indicator' END AS education_scope_reason,
  CAST(f_num % 11 < 2 AS INTEGER) AS scope_manual_override FROM latest JOIN sums USING (f_num))"""


def union_filings(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    number = c % 97
    return table(spark, d, "orders").select(
        number.alias("f_num"), k.alias("rpt_id"), F.when(k % 13 != 0, F.date_format("o_orderdate", "yyyy-12-31")).alias("pd_covered_to"), F.when(k % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("receive_date"),
        F.when(k % 41 == 0, "t").alias("terminate"), F.when(k % 43 == 0, "1999-01-01").alias("term_date"), F.when(c % 3 == 0, F.concat(F.lit(" Unit  "), number.cast("string"))).when(c % 3 == 1, "  ").alias("unit_name"),
        F.col("o_orderpriority").alias("union_name"), F.when(number % 5 == 0, "NEA").when(number % 5 == 1, "AFT").alias("aff_abbr"),
    )


def union_orgs(spark: SparkSession, d: str) -> DataFrame:
    numbers = union_filings(spark, d).select("f_num").distinct()
    n = F.col("f_num") % 11
    overrides = numbers.select("f_num", F.when(n == 0, " Include").when(n == 1, "exclude").otherwise("look").alias("action"), F.when(n == 0, " seen ").alias("note"))
    return unions.organizations(union_filings(spark, d), overrides)


@query(with_(UF, ORGS) + "SELECT * FROM orgs")
def union_organizations(spark: SparkSession, d: str) -> DataFrame:
    return union_orgs(spark, d)


PAY = """periods AS (SELECT f_num, pd_covered_to AS period_end, max(rpt_id) AS latest_rpt_id FROM uf WHERE pd_covered_to IS NOT NULL GROUP BY ALL),
pp AS (SELECT l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS row_id, l_orderkey AS rpt_id, l_suppkey % 4 AS payer_payee_id, CASE WHEN l_partkey % 6 = 0 THEN 1001 ELSE 1002 END AS type, 501 + l_partkey % 8 AS code, l_suppkey AS payee, l_extendedprice AS total FROM lineitem),
v AS (SELECT pp.row_id AS payer_payee_row_id, uf.f_num, o.display_name AS union_name, p.period_end, pp.rpt_id, pp.payer_payee_id, pp.code AS disbursement_code,
  CASE pp.code WHEN 501 THEN 'Representation' WHEN 502 THEN 'POLITICAL' WHEN 503 THEN 'CONTRIBUTIONS, GIFTS AND GRANTS' WHEN 504 THEN 'GENERAL OVERHEAD' WHEN 505 THEN 'UNION ADMINISTRATION' WHEN 506 THEN 'GENERAL DISBURSEMENTS' WHEN 508 THEN 'eight' END AS disbursement_category,
  CASE WHEN payee % 5 <> 0 THEN payee END AS counterparty_id, CASE WHEN payee % 5 <> 0 AND payee % 3 = 0 THEN payee + 1000 END AS matched_ein, total AS total_amount
  FROM pp JOIN periods p ON p.latest_rpt_id = pp.rpt_id JOIN uf ON uf.rpt_id = pp.rpt_id JOIN orgs o ON o.f_num = uf.f_num WHERE pp.type = 1002)"""


def union_payees(spark: SparkSession, d: str) -> DataFrame:
    uf = union_filings(spark, d)
    periods = uf.where("pd_covered_to is not null").groupBy("f_num", F.col("pd_covered_to").alias("period_end")).agg(F.max("rpt_id").alias("latest_rpt_id")).withColumn("period_start", F.lit(None).cast("string"))
    lines = table(spark, d, "lineitem").withColumn("row_id", F.expr("l_orderkey * 1000000000 + l_linenumber * 100000000L + l_partkey * 1000 + l_suppkey"))
    payees = lines.select(
        "row_id", F.col("l_orderkey").alias("rpt_id"), (F.col("l_suppkey") % 4).alias("payer_payee_id"), F.when(F.col("l_partkey") % 6 == 0, 1001).otherwise(1002).alias("payer_payee_type"),
        (F.col("l_partkey") % 8 + 501).alias("rcpt_disb_type"), F.col("l_suppkey").cast("string").alias("name"), F.col("l_extendedprice").alias("total"),
    )
    assigned = lines.where("l_suppkey % 5 <> 0").select(F.col("row_id").alias("payer_payee_row_id"), F.col("l_suppkey").alias("counterparty_id")).distinct()
    parties = table(spark, d, "supplier").select(F.col("s_suppkey").alias("counterparty_id"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey") + 1000).alias("matched_ein"))
    codes = spark.createDataFrame([("DISBURSEMENT_CODE", 501, "r", "Representation"), ("DISBURSEMENT_CODE", 508, "eight", None), ("OTHER", 502, "no", "no")], "code_type string, code long, code_name string, code_description string")
    return unions.payment_payees(payees, periods, uf, union_orgs(spark, d), assigned, parties, codes)


@query(with_(UF, ORGS, PAY) + "SELECT * FROM v")
def union_payment_payees(spark: SparkSession, d: str) -> DataFrame:
    return union_payees(spark, d).drop("period_start", "payee_name")


@query(with_(UF, ORGS, PAY) + "SELECT v.payer_payee_row_id, v.rpt_id, l.l_orderkey * 10 + l.l_linenumber AS transaction_oid, l.l_extendedprice AS transaction_amount FROM v JOIN lineitem l ON l.l_orderkey = v.rpt_id AND l.l_suppkey % 4 = v.payer_payee_id")
def union_payment_transactions(spark: SparkSession, d: str) -> DataFrame:
    general = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("rpt_id"), (F.col("l_suppkey") % 4).alias("payer_payee_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("oid"), F.col("l_extendedprice").alias("amount"))
    return unions.payment_transactions(union_payees(spark, d), general).select("payer_payee_row_id", "rpt_id", "transaction_oid", "transaction_amount")


@query(
    with_(UF, ORGS, PAY)
    + """SELECT counterparty_id, round(sum(total_amount), 2) AS total_amount, count(DISTINCT f_num) AS n_unions, min(period_end) AS first_period, max(period_end) AS last_period, round(sum(CASE WHEN disbursement_code = 503 THEN total_amount ELSE 0 END), 2) AS grants,
  round(sum(CASE WHEN disbursement_code = 502 THEN total_amount ELSE 0 END), 2) AS political, round(sum(CASE WHEN disbursement_code = 501 THEN total_amount ELSE 0 END), 2) AS representational,
  round(sum(CASE WHEN disbursement_code IN (504, 505, 506) THEN total_amount ELSE 0 END), 2) AS other FROM v WHERE counterparty_id IS NOT NULL GROUP BY counterparty_id"""
)
def union_counterparty_totals(spark: SparkSession, d: str) -> DataFrame:
    out = unions.totals_by_counterparty(union_payees(spark, d))
    return out.withColumns({c: F.round(c, 2) for c in ("total_amount", "grants", "political", "representational", "other")})


@query(
    with_(UF, ORGS, PAY)
    + """SELECT s_suppkey AS counterparty_id, s_name AS canonical_name, round(coalesce(sum(total_amount), 0), 2) AS total_amount, count(DISTINCT f_num) AS n_unions, min(period_end) AS first_period, max(period_end) AS last_period
FROM supplier LEFT JOIN v ON v.counterparty_id = s_suppkey WHERE s_nationkey < 12 GROUP BY s_suppkey, s_name
ORDER BY CASE WHEN upper(s_name) = 'SUPPLIER#000000003' THEN 0 ELSE 1 END, sum(total_amount) DESC NULLS LAST, s_name, s_suppkey LIMIT 100"""
)
def union_counterparty_search(spark: SparkSession, d: str) -> DataFrame:
    parties = table(spark, d, "supplier").select(F.col("s_suppkey").alias("counterparty_id"), F.col("s_name").alias("canonical_name"), "s_nationkey")
    return unions.counterparty_search(parties, union_payees(spark, d), F.col("s_nationkey") < 12, "Supplier#000000003").withColumn("total_amount", F.round("total_amount", 2))


@query(
    with_(UF, ORGS)
    + """SELECT 'total_reports' AS stat, count(*) AS value FROM uf UNION ALL SELECT 'years_loaded', count(DISTINCT pd_covered_to) FROM uf UNION ALL SELECT 'unique_labor_organizations', count(*) FROM orgs
UNION ALL SELECT 'affiliation_nea', count(*) FROM orgs WHERE affiliation = 'NEA' UNION ALL SELECT 'likely_education', count(*) FROM orgs WHERE education_scope IN ('likely_education', 'education_or_mixed', 'manual_include')
UNION ALL SELECT 'terminated', count(*) FROM orgs WHERE terminated = 1"""
)
def union_stats(spark: SparkSession, d: str) -> DataFrame:
    reports = aggs.long_stats(union_filings(spark, d), {"total_reports": F.count("*"), "years_loaded": F.countDistinct("pd_covered_to")})
    found = aggs.long_stats(
        union_orgs(spark, d),
        {"unique_labor_organizations": F.count("*"), "affiliation_nea": F.count_if(F.col("affiliation") == "NEA"), "likely_education": F.count_if(search.in_scope("education")), "terminated": F.count_if(F.col("terminated") == 1)},
    )
    return reports.unionByName(found)


@query(
    """SELECT o_orderkey, status FROM (SELECT o_orderkey, o_totalprice, CASE o_orderkey % 4 WHEN 0 THEN 'FILED_LATE' WHEN 1 THEN 'POTENTIAL_MISSING_FILING' WHEN 2 THEN 'TERMINATED' ELSE 'FILED_ON_TIME' END AS status FROM orders)
ORDER BY CASE status WHEN 'POTENTIAL_MISSING_FILING' THEN 0 WHEN 'FILED_LATE' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey"""
)
def status_sort(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    status = F.when(k == 0, "FILED_LATE").when(k == 1, "POTENTIAL_MISSING_FILING").when(k == 2, "TERMINATED").otherwise("FILED_ON_TIME")
    return table(spark, d, "orders").withColumn("status", status).orderBy(unions.status_order("status"), F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "status")


@query(
    """SELECT l_orderkey AS filing_id, CAST(l_suppkey AS VARCHAR) AS recipient_ein, trim(coalesce(l1, '') || CASE WHEN l2 IS NOT NULL AND l2 <> '' THEN ' ' || l2 ELSE '' END) AS recipient_name, coalesce(uc, fc) AS city, coalesce(us, fs) AS state,
  CASE WHEN us IS NOT NULL AND us <> '' THEN 'US' ELSE 'FR' END AS country, l_extendedprice AS cash_amount, l_discount AS noncash_amount, l_linestatus AS purpose
FROM (SELECT *, CASE WHEN l_partkey % 4 <> 0 THEN ' Name' || l_partkey END AS l1, CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Second ' END AS l2, CASE WHEN l_suppkey % 2 = 0 THEN 'Home' END AS uc, 'Paris' AS fc,
  CASE l_suppkey % 3 WHEN 0 THEN 'CA' WHEN 1 THEN '' END AS us, 'IDF' AS fs FROM lineitem)"""
)
def recipient_projection(spark: SparkSession, d: str) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("filing_id"), s.cast("string").alias("recipient_ein"), F.when(p % 4 != 0, F.concat(F.lit(" Name"), p.cast("string"))).alias("business_name_line1_txt"), F.when(p % 3 == 0, "").when(p % 3 == 1, "Second ").alias("business_name_line2_txt"),
        F.when(s % 2 == 0, "Home").alias("us_city_nm"), F.lit("Paris").alias("foreign_city_nm"), F.when(s % 3 == 0, "CA").when(s % 3 == 1, "").alias("us_state_abbreviation_cd"), F.lit("IDF").alias("foreign_province_or_state_nm"),
        F.lit("FR").alias("foreign_country_cd"), F.col("l_extendedprice").alias("cash_grant_amt"), F.col("l_discount").alias("non_cash_assistance_amt"), F.col("l_linestatus").alias("purpose_of_grant_txt"),
    )
    return views.recipients(rows)


@query(
    """SELECT id, filing_id, coalesce(nullif(trim(b), ''), nullif(trim(p), '')) AS contractor_name, coalesce(nullif(trim(a1), ''), nullif(trim(a2), '')) AS address1, coalesce(nullif(trim(st), ''), nullif(trim('Ontario '), '')) AS region,
  CASE WHEN nullif(trim(cc), '') IS NOT NULL THEN trim(cc) WHEN nullif(trim(st), '') IS NOT NULL OR nullif(trim(a1), '') IS NOT NULL THEN 'US' END AS country,
  CASE WHEN nullif(trim(st), '') IS NOT NULL OR nullif(trim(a1), '') IS NOT NULL THEN 1 ELSE 0 END AS is_us_address
FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS filing_id, CASE l_partkey % 3 WHEN 0 THEN ' Firm ' WHEN 1 THEN '  ' END AS b, CASE WHEN l_partkey % 2 = 0 THEN ' Jo ' END AS p, CASE l_suppkey % 3 WHEN 0 THEN ' 1 Way' WHEN 1 THEN '' END AS a1, 'rue' AS a2,
  CASE l_suppkey % 4 WHEN 0 THEN ' NY' WHEN 1 THEN ' ' END AS st, CASE l_suppkey % 5 WHEN 0 THEN ' CA ' WHEN 1 THEN ' ' END AS cc FROM lineitem)"""
)
def contractor_projection(spark: SparkSession, d: str) -> DataFrame:
    p, s, none = F.col("l_partkey"), F.col("l_suppkey"), F.lit(None).cast("string")
    rows = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("filing_id"), F.when(p % 3 == 0, " Firm ").when(p % 3 == 1, "  ").alias("business_name_line1_txt"), F.when(p % 2 == 0, " Jo ").alias("person_nm"),
        none.alias("services_desc"), F.col("l_extendedprice").alias("compensation_amt"), F.when(s % 3 == 0, " 1 Way").when(s % 3 == 1, "").alias("usaddress_address_line1_txt"), F.lit("rue").alias("address_line1_txt"), none.alias("usaddress_city_nm"),
        none.alias("city_nm"), F.when(s % 4 == 0, " NY").when(s % 4 == 1, " ").alias("state_abbreviation_cd"), F.lit("Ontario ").alias("province_or_state_nm"), none.alias("zipcd"), none.alias("foreign_postal_cd"),
        F.when(s % 5 == 0, " CA ").when(s % 5 == 1, " ").alias("country_cd"),
    )
    return views.contractors(rows).select("id", "filing_id", "contractor_name", "address1", "region", "country", "is_us_address")


@query(
    with_(*HEAD, RES)
    + """SELECT filing_id, recipient, part FROM res WHERE (coalesce(match_status, '') IN ('unresolved', 'conflicting_ein_match', 'reported_ein_not_found_name_matched', 'address_unique', 'address_narrowed_name_match', 'fuzzy_probable')
  OR coalesce(confidence <= 0.4, FALSE) OR trim(coalesce(warning_flags, '')) <> '') AND coalesce(total_amount, 0) >= 1000 AND filing_id >= 10"""
)
def signature_targets(spark: SparkSession, d: str) -> DataFrame:
    return resolved(spark, d).withColumn("grant_id", F.col("filing_id")).where(views.queued(low=0.4, least_amount=1000, ids=(10, None))).select("filing_id", "recipient", "part")


@query(
    with_(RETURNS, GRANTS, FLOWS)
    + """, a AS (SELECT ein, recipient, tax_year, amount FROM flows WHERE ein = 7 ORDER BY amount DESC, recipient, tax_year LIMIT 30), b AS (SELECT ein, recipient, tax_year, amount FROM flows WHERE recipient = 3 ORDER BY amount DESC, ein, tax_year LIMIT 30)
SELECT DISTINCT ein, recipient, tax_year, amount FROM (SELECT *, 0 AS part FROM a UNION ALL SELECT *, 1 FROM b ORDER BY part, amount DESC, recipient, ein, tax_year LIMIT 30)"""
)
def row_budget(spark: SparkSession, d: str) -> DataFrame:
    f = flows(spark, d).select("ein", "recipient", "tax_year", "amount")
    paid, received = f.where("ein = 7"), f.where("recipient = 3")
    return views.within_budget([(paid, [F.desc("amount"), F.col("recipient"), F.col("tax_year")]), (received, [F.desc("amount"), F.col("ein"), F.col("tax_year")])], 30)


@query("SELECT p_partkey, md5(CAST(p_partkey AS VARCHAR)) AS h FROM part WHERE md5(CAST(p_partkey AS VARCHAR)) > '80' ORDER BY h LIMIT 40")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return views.page_after(table(spark, d, "part").select("p_partkey", F.md5(F.col("p_partkey").cast("string")).alias("h")), "h", "80", 40)


FOCAL = "e AS (SELECT ein, recipient AS target, tax_year, (recipient % 7) / 10.0::DOUBLE AS confidence, ein || '-' || recipient || '-' || tax_year AS edge_id FROM flows WHERE ein IN (1, 4, 7, 10, 22))"


@query(
    with_(RETURNS, GRANTS, FLOWS, FOCAL, "b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ein, target ORDER BY tax_year DESC, confidence DESC, edge_id) AS rn FROM e) WHERE rn = 1)")
    + "SELECT ein, target, tax_year, edge_id FROM (SELECT *, row_number() OVER (PARTITION BY ein ORDER BY tax_year DESC, target) AS k FROM b) WHERE k <= 10"
)
def focal_edge_per_target(spark: SparkSession, d: str) -> DataFrame:
    edge = F.concat_ws("-", *(F.col(c).cast("string") for c in ("ein", "target", "tax_year")))
    edges = flows(spark, d).select("ein", F.col("recipient").alias("target"), "tax_year", ((F.col("recipient") % 7) / 10.0).alias("confidence")).withColumn("edge_id", edge)
    return views.focal_edges(edges, "ein", [1, 4, 7, 10, 22], 10).select("ein", "target", "tax_year", "edge_id")


@query(
    with_(RETURNS, GRANTS, FLOWS, "s AS (SELECT ein, recipient, round(sum(amount), 2) AS amount FROM flows GROUP BY ein, recipient)",
      "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ein ORDER BY amount DESC, recipient) AS k FROM s WHERE ein IN (1, 4, 7)) WHERE k <= 8)",
      "two AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ein ORDER BY amount DESC, recipient) AS k FROM s WHERE ein IN (SELECT recipient FROM one)) WHERE k <= 4)",
      "p AS (SELECT one.ein AS focus, one.recipient AS via, two.recipient AS end_, one.amount AS amount1, two.amount AS amount2 FROM one JOIN two ON two.ein = one.recipient)")
    + "SELECT focus, via, end_ AS \"end\", amount1, amount2 FROM (SELECT *, row_number() OVER (PARTITION BY focus ORDER BY least(amount1, amount2) DESC, via, end_) AS k FROM p) WHERE k <= 20"
)
def grant_paths_bounded(spark: SparkSession, d: str) -> DataFrame:
    return views.grant_paths(flows(spark, d), "ein", "recipient", [1, 4, 7]).select("focus", "via", "end", "amount1", "amount2")


@query(
    """WITH f AS (SELECT p_name || '/' || p_partkey AS relative_path, p_name AS object_id, md5(CAST(p_size AS VARCHAR)) AS sha256, CASE WHEN p_name LIKE 'c%' THEN 'same' WHEN p_name LIKE 's%' THEN 'ERROR: x' ELSE md5(p_brand) END AS canonical_sha256, p_size AS size_bytes FROM part)
SELECT object_id, count(*) AS file_count, count(DISTINCT sha256) AS byte_hash_count, count(DISTINCT canonical_sha256) AS canonical_hash_count, min(size_bytes) AS min_size_bytes, max(size_bytes) AS max_size_bytes,
  CASE WHEN count(DISTINCT canonical_sha256) = 1 AND min(canonical_sha256) NOT LIKE 'ERROR:%' THEN 'canonical_equivalent' ELSE 'canonical_different' END AS conflict_kind, string_agg(relative_path, chr(10) ORDER BY relative_path) AS source_files
FROM f GROUP BY object_id HAVING count(*) > 1"""
)
def file_conflict_groups(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("p_name")
    canonical_hash = F.when(name.startswith("c"), "same").when(name.startswith("s"), "ERROR: x").otherwise(F.md5("p_brand"))
    files = table(spark, d, "part").select(
        F.concat_ws("/", "p_name", F.col("p_partkey").cast("string")).alias("relative_path"), name.alias("object_id"), F.md5(F.col("p_size").cast("string")).alias("sha256"), canonical_hash.alias("canonical_sha256"), F.col("p_size").alias("size_bytes")
    )
    return views.conflict_groups(files)


@query(
    """SELECT p_partkey, 'name=' || coalesce(n, '') || CASE WHEN n IS NOT NULL THEN ' | ' ELSE '' END || 'title=' || p_type || ' | hrs/wk=' || coalesce(CAST(h AS VARCHAR), '') AS detail
FROM (SELECT *, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS n, CASE WHEN p_size % 3 <> 0 THEN p_size END AS h FROM part)"""
)
def detail_string(spark: SparkSession, d: str) -> DataFrame:
    hours = F.when(F.col("p_size") % 3 != 0, F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", search.detail(F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")), [("title", F.col("p_type")), ("hrs/wk", hours)]).alias("detail"))


@query(with_(RETURNS, CANONICAL) + "SELECT ein, tax_year, return_type FROM (SELECT *, row_number() OVER (PARTITION BY ein ORDER BY tax_year DESC, filing_id DESC) AS k FROM canonical) WHERE k = 1")
def latest_canonical_by_filing(spark: SparkSession, d: str) -> DataFrame:
    return windows.latest_per_key(canonical(spark, d), ["ein"], [F.desc("tax_year"), F.desc("filing_id")]).select("ein", "tax_year", "return_type")


@query(
    with_(GRANTS, "c AS (SELECT filing_id, recipient, max(cash) AS score FROM grants GROUP BY filing_id, recipient)")
    + "SELECT filing_id, recipient, CAST(k AS INTEGER) AS candidate_rank FROM (SELECT *, row_number() OVER (PARTITION BY filing_id ORDER BY score DESC, recipient) AS k FROM c) WHERE k <= 3"
)
def migration_rank_cut(spark: SparkSession, d: str) -> DataFrame:
    scored = grants(spark, d).groupBy("filing_id", "recipient").agg(F.max("cash").alias("score"))
    return windows.top_k_per_group(scored, ["filing_id"], [F.desc("score"), F.col("recipient")], 3, rank="candidate_rank").select("filing_id", "recipient", "candidate_rank")


@query(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '3' WHEN 1 THEN '19' WHEN 2 THEN '4' WHEN 3 THEN NULL ELSE '3' END AS subsection,
  CASE o_orderkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE o_custkey % 5 IN (2, 3, 4) END AS private_foundation, CASE o_orderkey % 3 WHEN 0 THEN date_diff('day', CAST(o_orderdate AS DATE), make_date(year(o_orderdate), 12, 31)) + 1 END AS period_days FROM orders"""
)
def filing_traits(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(k % 5 == 0, "501(c)(03)").when(k % 5 == 1, "x 501 ( C ) ( 19 )").when(k % 5 == 2, "4947(a)(1)")
    master = F.when(k % 5 == 2, "04").when(k % 5 == 3, "").when(k % 5 == 4, "3")
    form = F.when(k % 4 == 0, "990-PF").when(k % 4 == 1, "990 EZ").when(k % 4 == 2, "990T")
    start = F.when(k % 3 != 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"))
    end = F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-12-31")).when(k % 3 == 1, "2000-01-01").otherwise("1990-01-01")
    return table(spark, d, "orders").select(
        "o_orderkey", risk_families.subsection(status, master).alias("subsection"), risk_families.private_foundation(form, (F.col("o_custkey") % 5).cast("string")).alias("private_foundation"), risk_families.period_days(start, end).alias("period_days")
    )


@query(
    with_(*HEAD, RES)
    + """SELECT CASE WHEN source = 'ai' THEN 'accepted' WHEN match_status = 'conflicting_ein_match' THEN 'review' WHEN coalesce(trim(resolved_ein), '') <> '' THEN 'match' WHEN match_status = 'unresolved' THEN 'no_match' ELSE 'pending' END AS outcome,
  count(*) AS n, round(sum(total_amount), 2) AS amount FROM res GROUP BY 1"""
)
def enhanced_outcomes(spark: SparkSession, d: str) -> DataFrame:
    known = F.trim(F.coalesce("resolved_ein", F.lit(""))) != ""
    outcome = F.when(F.col("source") == "ai", "accepted").when(F.col("match_status") == "conflicting_ein_match", "review").when(known, "match").when(F.col("match_status") == "unresolved", "no_match").otherwise("pending")
    return resolved(spark, d).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.round(F.sum("total_amount"), 2).alias("amount"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a/' || p_partkey || '.xml' WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 'b/c' END AS portable, CASE p_partkey % 4 WHEN 0 THEN 'a/' || p_partkey || '.xml' WHEN 1 THEN 'x/' || p_partkey WHEN 3 THEN 'b/c' END AS hint,
  CASE p_partkey % 4 WHEN 0 THEN 'integer' WHEN 1 THEN 'real' WHEN 2 THEN 'text' ELSE 'null' END AS kind, CASE p_partkey % 4 WHEN 0 THEN p_partkey END AS whole, CASE p_partkey % 4 WHEN 1 THEN p_partkey + 0.5 END::DOUBLE AS real FROM part"""
)
def paths_and_affinity(spark: SparkSession, d: str) -> DataFrame:
    key, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 4
    path = F.when(k == 0, F.concat(F.lit("a//./"), key, F.lit(".xml"))).when(k == 1, F.concat(F.lit("C:\\x\\"), key)).when(k == 2, "../up").otherwise(" b\\c ")
    value = F.when(k == 0, F.concat(F.lit(" "), key, F.lit(".00"))).when(k == 1, F.concat(key, F.lit(".5"))).when(k == 2, F.concat(key, F.lit("-x")))
    typed = paths.numeric_affinity(value)
    return table(spark, d, "part").select("p_partkey", paths.portable_path(path).alias("portable"), paths.path_hint(path).alias("hint"), typed["kind"].alias("kind"), typed["whole"].alias("whole"), typed["real"].alias("real"))
