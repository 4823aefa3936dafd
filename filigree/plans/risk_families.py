"""Queries on the families of risk indicators, with their SQL; lines of an order stand for its schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators import risk_families as families
from filigree.plans.filings import canonical
from filigree.plans.roles import CANONICAL, GRANTS, RETURNS, grants, with_

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


F_SQL = """f AS (SELECT ein, tax_year, filing_id, CASE WHEN ein % 10 <> 9 THEN total END AS expenses, total * (0.5 + (filing_id % 30) / 10.0) AS revenue, total * 40 AS assets,
  CASE WHEN ein % 4 = 0 THEN total * 0.3 END AS grants_paid, CASE ein % 3 WHEN 0 THEN '3' WHEN 1 THEN '4' END AS subsection, total * (filing_id % 20) / 200.0 AS lobbying,
  CASE WHEN filing_id % 6 = 0 THEN ' x ' WHEN filing_id % 6 = 1 THEN 'false' END AS lobbying_ind, CASE WHEN filing_id % 7 = 0 THEN 'true' END AS political_campaign_activity_ind,
  CASE WHEN filing_id % 8 = 0 THEN '1' ELSE '0' END AS dues_assessments_ind, CASE WHEN filing_id % 50 = 0 THEN 'X' END AS final_return_ind,
  CASE WHEN filing_id % 60 = 0 THEN 'yes' END AS application_pending_ind, amended AS amended_return_ind,
  tax_year || '-01-01' AS period_start, CASE WHEN filing_id % 9 = 0 THEN tax_year || '-06-30' WHEN filing_id % 11 = 0 THEN 'unknown' ELSE tax_year || '-12-31' END AS period_end
  FROM canonical)"""
HEAD = (RETURNS, GRANTS, CANONICAL, F_SQL)


def filings(spark: SparkSession, d: str) -> DataFrame:
    k, e, total = F.col("filing_id"), F.col("ein"), F.col("total")

    def year(end: str) -> F.Column:
        return F.concat(F.col("tax_year").cast("string"), F.lit(end))

    return canonical(spark, d).select(
        "ein", "tax_year", "filing_id", F.when(e % 10 != 9, total).alias("expenses"), (total * (0.5 + (k % 30) / 10.0)).alias("revenue"), (total * 40).alias("assets"),
        F.when(e % 4 == 0, total * 0.3).alias("grants_paid"), F.when(e % 3 == 0, "3").when(e % 3 == 1, "4").alias("subsection"), (total * (k % 20) / 200.0).alias("lobbying"),
        F.when(k % 6 == 0, " x ").when(k % 6 == 1, "false").alias("lobbying_ind"), F.when(k % 7 == 0, "true").alias("political_campaign_activity_ind"),
        F.when(k % 8 == 0, "1").otherwise("0").alias("dues_assessments_ind"), F.when(k % 50 == 0, "X").alias("final_return_ind"), F.when(k % 60 == 0, "yes").alias("application_pending_ind"),
        F.col("amended").alias("amended_return_ind"), year("-01-01").alias("period_start"), F.when(k % 9 == 0, year("-06-30")).when(k % 11 == 0, "unknown").otherwise(year("-12-31")).alias("period_end"),
    )


def indicators(source: str, *rows: tuple[str, str, str, str]) -> str:
    """SQL that unites indicator rows (condition, severity, category, title) of one source."""
    return " UNION ALL ".join(f"SELECT ein, tax_year, {s if s.startswith('CASE') else repr(s)} AS severity, '{c}' AS category, '{t}' AS title FROM {source} WHERE {w}" for w, s, c, t in rows)


PEOPLE = """people AS (SELECT DISTINCT f.ein, f.tax_year, 'P' || (part % 40) AS person, flag AS title, floor(cash * 0.25) AS a,
  CASE WHEN part % 5 = 0 THEN floor(cash * 0.0625) ELSE 0 END AS b, CASE WHEN recipient % 7 = 0 THEN -10.0 ELSE 0 END AS c FROM grants JOIN f USING (filing_id))"""
PEOPLE_T = "t AS (SELECT ein, tax_year, sum(a + b + c) AS total, max(a + b + c) AS largest, sum(CASE WHEN b > 0 THEN b ELSE 0 END) AS related, count(*) AS n FROM people GROUP BY ein, tax_year)"


def officers(spark: SparkSession, d: str) -> DataFrame:
    return grants(spark, d).select(
        "filing_id", F.concat(F.lit("P"), (F.col("part") % 40).cast("string")).alias("person_name"), F.col("flag").alias("title_txt"), F.floor(F.col("cash") * 0.25).alias("comp_from_org"),
        F.when(F.col("part") % 5 == 0, F.floor(F.col("cash") * 0.0625)).alias("comp_from_related"), F.when(F.col("recipient") % 7 == 0, -10.0).alias("other_compensation"),
    )


@query(with_(*HEAD, PEOPLE, PEOPLE_T) + "SELECT ein, tax_year, round(total, 1) AS total_comp, round(largest, 1) AS max_comp, round(related, 1) AS related_comp, n AS rows_count FROM t")
def compensation_aggregates(spark: SparkSession, d: str) -> DataFrame:
    out = families.compensation_totals(officers(spark, d), filings(spark, d))
    return out.withColumns({c: F.round(c, 1) for c in ("total_comp", "max_comp", "related_comp")})


@query(
    with_(*HEAD, PEOPLE, PEOPLE_T, "j AS (SELECT t.*, f.expenses FROM t JOIN f USING (ein, tax_year))")
    + indicators(
        "j", ("expenses <> 0 AND total / expenses >= 0.25", "Medium", "Compensation", "Compensation concentration"),
        ("expenses <> 0 AND largest / expenses >= 0.2", "Medium", "Compensation", "Single person compensation concentration"), ("related > 0", "Low", "Compensation", "Compensation from related organizations"),
    )
)
def risk_compensation(spark: SparkSession, d: str) -> DataFrame:
    return families.compensation(officers(spark, d), filings(spark, d))


PAYMENTS = "t AS (SELECT f.ein, f.tax_year, max(f.expenses) AS expenses, sum(coalesce(cash, 0)) AS total, max(coalesce(cash, 0)) AS largest, count(*) AS n FROM grants JOIN f USING (filing_id) WHERE flag = 'R' GROUP BY f.ein, f.tax_year)"


@query(with_(*HEAD, PAYMENTS) + "SELECT ein, tax_year, round(total, 2) AS total_contractors, largest AS largest_contractor, n AS contractor_rows FROM t")
def contractor_aggregates(spark: SparkSession, d: str) -> DataFrame:
    payments = grants(spark, d).where("flag = 'R'").select("filing_id", F.col("cash").alias("compensation_amt"))
    return families.contractor_totals(payments, filings(spark, d)).withColumn("total_contractors", F.round("total_contractors", 2))


@query(
    with_(*HEAD, PAYMENTS)
    + indicators(
        "t", ("expenses <> 0 AND total / expenses >= 0.3", "Medium", "Contractors", "Contractor payments are a large share of expenses"),
        ("expenses <> 0 AND largest / expenses >= 0.2 AND n > 1", "Low", "Contractors", "Single contractor concentration"),
    )
)
def risk_contractors(spark: SparkSession, d: str) -> DataFrame:
    payments = grants(spark, d).where("flag = 'R'").select("filing_id", F.col("cash").alias("compensation_amt"))
    return families.contractors(payments, filings(spark, d))


RELATED = """related AS (SELECT filing_id, CASE WHEN part % 3 = 0 THEN 'Transactions with Related Org' WHEN part % 3 = 1 THEN 'Unrelated Taxable Partnership' ELSE 'Related Tax-Exempt Org' END AS kind,
  CASE WHEN recipient % 2 = 0 THEN ' t' ELSE 'n' END AS controlled, CASE WHEN recipient % 5 <> 0 THEN cash END AS amount FROM grants WHERE status = 'F')"""
RELATED_T = """rt AS (SELECT filing_id, count(*) FILTER (kind NOT IN ('Transactions with Related Org', 'Unrelated Taxable Partnership')) AS entity_rows, count(*) FILTER (kind = 'Transactions with Related Org') AS transaction_rows,
  count(*) FILTER (kind = 'Unrelated Taxable Partnership') AS unrelated_rows, count(*) FILTER (kind <> 'Unrelated Taxable Partnership' AND upper(trim(controlled)) IN ('X', '1', 'TRUE', 'T', 'YES', 'Y')) AS controlled_count,
  sum(CASE WHEN kind = 'Transactions with Related Org' THEN coalesce(amount, 0) ELSE 0 END) AS involved_amount FROM related GROUP BY filing_id)"""


def related(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("part") % 3 == 0, "Transactions with Related Org").when(F.col("part") % 3 == 1, "Unrelated Taxable Partnership").otherwise("Related Tax-Exempt Org")
    return grants(spark, d).where("status = 'F'").select(
        "filing_id", kind.alias("relationship_category"), F.when(F.col("recipient") % 2 == 0, " t").otherwise("n").alias("controlled_organization_ind"), F.when(F.col("recipient") % 5 != 0, F.col("cash")).alias("involved_amt")
    )


@query(with_(*HEAD, RELATED, RELATED_T) + "SELECT filing_id, entity_rows, transaction_rows, unrelated_rows, controlled_count, round(involved_amount, 2) AS involved_amount FROM rt")
def related_org_sums(spark: SparkSession, d: str) -> DataFrame:
    return families.related_totals(related(spark, d)).withColumn("involved_amount", F.round("involved_amount", 2))


@query(
    with_(*HEAD, RELATED, RELATED_T, "t AS (SELECT ein, tax_year, sum(entity_rows) AS entity_rows, sum(involved_amount) AS amount, max(expenses) AS expenses FROM rt JOIN f USING (filing_id) GROUP BY ein, tax_year)")
    + indicators(
        "t", ("entity_rows > 0", "Low", "Disclosure Context", "Schedule R related organizations reported"),
        ("expenses <> 0 AND amount / expenses >= 0.2", "Medium", "Related Organizations", "Material related-organization transaction amount"),
    )
)
def risk_related_organizations(spark: SparkSession, d: str) -> DataFrame:
    return families.related_organizations(related(spark, d), filings(spark, d))


RES = """res AS (SELECT f.ein AS grantor_ein, f.tax_year, CASE WHEN part % 9 = 0 THEN -cash ELSE cash END AS total_amount, CASE WHEN part % 4 <> 0 THEN CAST(recipient AS VARCHAR) ELSE '' END AS reported_ein,
  CASE WHEN part % 3 = 0 THEN '  ' WHEN part % 7 = 0 THEN CAST(recipient + 1 AS VARCHAR) ELSE CAST(recipient AS VARCHAR) END AS resolved_ein,
  CASE part % 6 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'conflicting_ein_match' WHEN 2 THEN NULL ELSE 'resolved' END AS match_status,
  CASE WHEN recipient % 10 = 0 THEN 'name_conflict' END AS warning_flags, CASE WHEN recipient % 8 <> 0 THEN (recipient % 20) / 20.0::DOUBLE END AS confidence,
  CASE part % 4 WHEN 0 THEN 'deterministic' WHEN 1 THEN 'reported_ein_from_filing_unverified' WHEN 2 THEN 'ai' END AS source, grants.filing_id, recipient, part FROM grants JOIN f USING (filing_id))"""
RES_T = """t AS (SELECT grantor_ein AS ein, tax_year, count(*) AS row_count, sum(total_amount) AS total_amount, sum(CASE WHEN coalesce(trim(resolved_ein), '') = '' THEN total_amount ELSE 0 END) AS unresolved_amount,
  count(*) FILTER (coalesce(match_status, '') = 'conflicting_ein_match' OR coalesce(warning_flags, '') LIKE '%conflict%') AS conflict_rows,
  count(*) FILTER (reported_ein <> '' AND resolved_ein <> '' AND reported_ein <> resolved_ein) AS corrected_ein_rows, count(*) FILTER (confidence < 0.7) AS low_confidence_rows
  FROM res WHERE total_amount > 0 GROUP BY grantor_ein, tax_year)"""


def resolved(spark: SparkSession, d: str) -> DataFrame:
    p, r = F.col("part"), F.col("recipient")
    return grants(spark, d).join(filings(spark, d).select("filing_id", F.col("ein").alias("grantor_ein"), "tax_year"), "filing_id").select(
        "filing_id", "recipient", "part", "grantor_ein", "tax_year", F.when(p % 9 == 0, -F.col("cash")).otherwise(F.col("cash")).alias("total_amount"), F.when(p % 4 != 0, r.cast("string")).otherwise("").alias("reported_ein"),
        F.when(p % 3 == 0, "  ").when(p % 7 == 0, (r + 1).cast("string")).otherwise(r.cast("string")).alias("resolved_ein"),
        F.when(p % 6 == 0, "unresolved").when(p % 6 == 1, "conflicting_ein_match").when(p % 6 != 2, "resolved").alias("match_status"), F.when(r % 10 == 0, "name_conflict").alias("warning_flags"),
        F.when(r % 8 != 0, (r % 20) / 20.0).alias("confidence"), F.when(p % 4 == 0, "deterministic").when(p % 4 == 1, "reported_ein_from_filing_unverified").when(p % 4 == 2, "ai").alias("source"),
    )


@query(with_(*HEAD, RES, RES_T) + "SELECT ein, tax_year, row_count, round(total_amount, 2) AS total_amount, round(unresolved_amount, 2) AS unresolved_amount, conflict_rows, corrected_ein_rows, low_confidence_rows FROM t")
def grant_identity_counters(spark: SparkSession, d: str) -> DataFrame:
    return families.identity_counters(resolved(spark, d)).withColumns({c: F.round(c, 2) for c in ("total_amount", "unresolved_amount")})


@query(
    with_(*HEAD, RES, RES_T)
    + indicators(
        "t", ("unresolved_amount / total_amount >= 0.5", "Medium", "Data Quality", "Most grant dollars remain unresolved to a recipient EIN"), ("conflict_rows > 0", "Medium", "Data Quality", "Grant recipient EIN conflicts"),
        ("corrected_ein_rows > 0 OR low_confidence_rows > 0", "Low", "Data Quality", "Grant identity matching requires review"),
    )
)
def risk_grant_identity(spark: SparkSession, d: str) -> DataFrame:
    return families.grant_identity(resolved(spark, d))


@query(
    with_(*HEAD, RES)
    + """SELECT filing_id, recipient, part, coalesce(trim(resolved_ein), '') <> '' AND coalesce(confidence, 0) >= 0.85 AND coalesce(match_status, '') NOT IN ('unresolved', 'conflicting_ein_match') AS plain,
  coalesce(trim(resolved_ein), '') <> '' AND coalesce(confidence, 0) >= 0.85 AND coalesce(source, '') <> 'reported_ein_from_filing_unverified'
    AND (coalesce(source, '') <> 'deterministic' OR coalesce(match_status, '') NOT IN ('unresolved', 'conflicting_ein_match')) AS by_source FROM res"""
)
def trusted_grant_identity(spark: SparkSession, d: str) -> DataFrame:
    columns = ("resolved_ein", "confidence", "match_status")
    return resolved(spark, d).select("filing_id", "recipient", "part", families.trusted_identity(*columns).alias("plain"), families.trusted_identity(*columns, "source").alias("by_source"))


DETAIL = """gr AS (SELECT f.ein, f.tax_year, CASE WHEN part % 2 = 0 THEN recipient END AS recipient_ein, CAST(recipient % 5 AS VARCHAR) AS recipient_name, coalesce(cash, 0) + coalesce(noncash, 0) AS amount
  FROM grants JOIN f USING (filing_id) WHERE flag = 'N'),
rec AS (SELECT ein, tax_year, recipient_ein, recipient_name, sum(amount) AS one, count(*) AS n FROM gr GROUP BY ALL),
t AS (SELECT ein, tax_year, sum(n) AS n, sum(one) AS total, sum(CASE WHEN recipient_ein IS NULL THEN one ELSE 0 END) AS missing, max(one) AS largest FROM rec GROUP BY ein, tax_year),
bare AS (SELECT * FROM f WHERE grants_paid > 0 AND NOT EXISTS (SELECT 1 FROM t WHERE t.ein = f.ein AND t.tax_year = f.tax_year))"""


@query(
    with_(*HEAD, DETAIL)
    + indicators("t", ("missing / total >= 0.5", "Medium", "Data Quality", "Most grant dollars lack recipient EINs"), ("largest / total >= 0.6 AND n > 1", "Low", "Grants", "Grant concentration in one recipient"))
    + " UNION ALL " + indicators("bare", ("TRUE", "Low", "Data Quality", "Grants paid total has no grant-detail rows"))
)
def risk_grant_detail(spark: SparkSession, d: str) -> DataFrame:
    rows = grants(spark, d).where("flag = 'N'").select(
        "filing_id", F.when(F.col("part") % 2 == 0, F.col("recipient")).alias("recipient_ein"), (F.col("recipient") % 5).cast("string").alias("recipient_name"), F.col("cash").alias("cash_amount"), F.col("noncash").alias("noncash_amount")
    )
    return families.grant_detail(rows, filings(spark, d))


SC = """sc AS (SELECT f.*, CASE WHEN f.filing_id % 3 = 0 THEN expenses * (f.filing_id % 11) / 100 END AS political, CASE WHEN f.filing_id % 5 = 0 THEN 20.0 ELSE 0 END AS s527,
  CASE WHEN f.filing_id % 13 = 0 THEN 5.0 END AS excess, CASE WHEN f.filing_id % 17 = 0 THEN -1.0 END AS grass, expenses * (f.filing_id % 4) / 50 AS granted, CASE WHEN f.filing_id % 7 = 1 THEN 3.0 END AS nondeductible,
  CASE WHEN f.filing_id % 29 = 0 THEN 'X' END AS pol FROM f),
sp AS (SELECT *, coalesce(political, 0) + coalesce(s527, 0) AS spent, coalesce(subsection, '') = '3' AS charity FROM sc),
sm AS (SELECT *, spent >= 100000 OR coalesce(expenses > 0 AND spent / expenses >= 0.05, FALSE) AS material, granted >= 100000 OR coalesce(expenses > 0 AND granted / expenses >= 0.05, FALSE) AS gmaterial FROM sp)"""


@query(
    with_(*HEAD, SC)
    + indicators(
        "sm", ("(coalesce(political, 0) <> 0 OR s527 <> 0) AND charity", "High", "Lobbying / Political", "Schedule C political or section 527 expenditures"),
        ("(coalesce(political, 0) <> 0 OR s527 <> 0) AND NOT charity AND material", "Medium", "Lobbying / Political", "Schedule C political or section 527 expenditures"),
        ("(coalesce(political, 0) <> 0 OR s527 <> 0) AND NOT charity AND NOT material", "Low", "Disclosure Context", "Schedule C political or section 527 expenditures"),
        ("coalesce(excess, 0) <> 0 OR coalesce(grass, 0) <> 0", "High", "Lobbying / Political", "Schedule C lobbying-limit excess"),
        ("granted > 0 AND gmaterial", "Medium", "Lobbying / Political", "Grants used for lobbying activities"), ("granted > 0 AND NOT gmaterial", "Low", "Disclosure Context", "Grants used for lobbying activities"),
        ("nondeductible > 0", "Low", "Disclosure Context", "Nondeductible lobbying or political amount"), ("pol = 'X'", "Low", "Disclosure Context", "Form 1120-POL filing reported"),
    )
)
def risk_schedule_c(spark: SparkSession, d: str) -> DataFrame:
    f, k = filings(spark, d), F.col("filing_id")
    rows = f.select(
        "filing_id", F.when(k % 3 == 0, F.col("expenses") * (k % 11) / 100).alias("political_expenditures_amt"), F.when(k % 5 == 0, 20.0).otherwise(0.0).alias("expended527_activities_amt"),
        F.when(k % 13 == 0, 5.0).alias("lobbying_excess_amt"), F.when(k % 17 == 0, -1.0).alias("lobbying_grassroots_excess_amt"), (F.col("expenses") * (k % 4) / 50).alias("grants_other_organizations_amt"),
        F.when(k % 7 == 1, 3.0).alias("non_deductible_lbbyng_pltcl_cy_amt"), F.when(k % 29 == 0, "X").alias("form1120_pol_filed_ind"),
    )
    return families.schedule_c(rows, f)


SL = """ex AS (SELECT filing_id, count(*) AS n, count(*) FILTER (recipient % 3 <> 0) AS done FROM grants WHERE part % 20 = 0 GROUP BY filing_id),
exf AS (SELECT f.*, n, done FROM ex JOIN f USING (filing_id)),
ln AS (SELECT f.ein, f.tax_year, f.expenses, part % 3 AS kind, sum(cash) AS total FROM grants JOIN f USING (filing_id) WHERE part % 4 = 1 GROUP BY f.filing_id, f.ein, f.tax_year, f.expenses, part % 3),
lm AS (SELECT *, total >= 100000 OR coalesce(expenses > 0 AND total / expenses >= 0.1, FALSE) AS material FROM ln)"""
L_TITLES = ("Business transactions with interested persons", "Grants or assistance to interested persons", "Loans involving interested persons")


@query(
    with_(*HEAD, SL)
    + indicators("exf", ("TRUE", "CASE WHEN done = n THEN 'Medium' ELSE 'High' END", "Interested Persons", "Schedule L excess-benefit transaction")) + " UNION ALL "
    + indicators("lm", *((f"kind = {i}", "CASE WHEN material THEN 'Medium' ELSE 'Low' END", "Interested Persons", t) for i, t in enumerate(L_TITLES)))
)
def risk_schedule_l(spark: SparkSession, d: str) -> DataFrame:
    g = grants(spark, d)
    excess = g.where("part % 20 = 0").select("filing_id", F.when(F.col("recipient") % 3 != 0, "yes").alias("transaction_corrected_ind"))
    parts = [g.where(f"part % 4 = 1 and part % 3 = {i}").select("filing_id", F.col("cash").alias(c)) for i, c in enumerate(("transaction_amt", "cash_grant_amt", "balance_due_amt"))]
    return families.schedule_l(excess, *parts, filings(spark, d))


@query(
    with_(*HEAD)
    + indicators(
        "f", ("final_return_ind = 'X'", "Medium", "Filing Status", "Final return indicated"), ("application_pending_ind = 'yes'", "Medium", "IRS Status", "Exemption application pending"),
        ("amended_return_ind = '1'", "Low", "Filing Status", "Amended return selected as canonical"),
    )
    + " UNION ALL SELECT f.ein, max(tax_year), 'Medium', 'IRS Status', 'EO BMF status requires review' FROM f WHERE f.ein % 6 IN (1, 2) GROUP BY f.ein"
)
def risk_filing_status(spark: SparkSession, d: str) -> DataFrame:
    f = filings(spark, d)
    master = f.select("ein").distinct().withColumn("status", F.when(F.col("ein") % 6 == 0, "01").when(F.col("ein") % 6 == 1, "25").when(F.col("ein") % 6 == 2, "12").when(F.col("ein") % 6 == 3, ""))
    return families.both(families.filing_status(f), families.master_file_status(f, master))


@query(
    with_(*HEAD)
    + indicators(
        "f", ("upper(trim(lobbying_ind)) = 'X' AND coalesce(lobbying / nullif(expenses, 0), 0) < 0.05", "Low", "Disclosure Context", "Lobbying activity flag"),
        ("political_campaign_activity_ind = 'true'", "CASE subsection WHEN '3' THEN 'High' WHEN '4' THEN 'Low' ELSE 'Medium' END", "Lobbying / Political", "Political campaign activity flag"),
        ("dues_assessments_ind = '1'", "Low", "Disclosure Context", "Membership dues or proxy-tax flag"),
    )
)
def risk_campaign_flags(spark: SparkSession, d: str) -> DataFrame:
    return families.campaign_flags(filings(spark, d))


TREND = """p AS (SELECT *, date_diff('day', try_cast(period_start AS DATE), try_cast(period_end AS DATE)) + 1 AS days FROM f),
w AS (SELECT *, lag(tax_year) OVER o AS previous, lag(days) OVER o AS days_before, lag(revenue) OVER o AS r, lag(expenses) OVER o AS e, lag(grants_paid) OVER o AS g FROM p WINDOW o AS (PARTITION BY ein ORDER BY tax_year)),
t AS (SELECT *, coalesce(days < 300, FALSE) OR coalesce(days_before < 300, FALSE) AS short FROM w WHERE previous IS NOT NULL)"""


@query(
    with_(*HEAD, TREND)
    + indicators(
        "t", ("short", "Low", "Data Quality", "Short tax period excluded from annual trend scoring"),
        *((f"NOT short AND {c} >= 1 AND {b} >= 1 AND ({c} / {b} >= 2 OR {c} / {b} <= 0.5)", "Medium", "Trend", f"Large year-over-year {n} change") for c, b, n in (("revenue", "r", "revenue"), ("expenses", "e", "expenses"), ("grants_paid", "g", "grants paid"))),
    )
)
def risk_trends(spark: SparkSession, d: str) -> DataFrame:
    return families.trends(filings(spark, d))


GOV = """g AS (SELECT f.*, CASE filing_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS a, CASE filing_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS b, CASE filing_id % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS c,
  filing_id % 9 AS members, CASE WHEN filing_id % 8 <> 7 THEN filing_id % 8 END AS independent FROM f)"""


@query(
    with_(*HEAD, GOV)
    + indicators(
        "g", ("a", "High", "Governance", "Material diversion or misuse reported"), ("b AND NOT c", "High", "External Compliance", "Required federal grant audit reported as not performed"),
        ("members > 0 AND independent = 0", "Medium", "Governance", "No independent voting members reported"), ("members > 0 AND independent > 0 AND 2 * independent < members", "Medium", "Governance", "Independent members are a minority"),
        ("c", "Medium", "Governance", "Family or business relationships among leaders"), ("coalesce(NOT a, FALSE) OR coalesce(NOT b, FALSE)", "Medium", "Governance", "Contemporaneous minutes not maintained"),
        ("coalesce(NOT b, FALSE) OR coalesce(NOT c, FALSE) OR coalesce(NOT a, FALSE)", "Low", "Governance", "Governance policies reported absent"), ("NOT c", "Low", "Governance", "Form 990 not provided to governing body"),
        ("NOT b AND greatest(coalesce(assets, 0), coalesce(revenue, 0)) >= 5000000", "Low", "Governance", "Large organization reports no audited financial statements"),
    )
)
def risk_governance(spark: SparkSession, d: str) -> DataFrame:
    f, k = filings(spark, d), F.col("filing_id")
    a, b, c = (F.when(k % n == 0, True).when(k % n == 1, False) for n in (3, 4, 5))
    names = {
        "material_diversion": a, "federal_grant_audit_required": b, "federal_grant_audit_performed": c, "family_business_relationships": c, "minutes_governing_body": a, "minutes_committees": b, "conflict_policy": b,
        "whistleblower_policy": c, "document_retention_policy": a, "form990_provided_to_board": c, "financial_statements_audited": b, "voting_members": k % 9, "independent_members": F.when(k % 8 != 7, k % 8),
    }
    return families.governance(f.select("ein", "tax_year", *(v.alias(n) for n, v in names.items())), f)
