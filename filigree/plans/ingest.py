"""Queries that read raw records, pages and others' SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators.guard import ask
from filigree.sources import xml_filing
from filigree.plans.roles import returns, table
from filigree.sources.html_pages import extracted
from filigree.sources.pipe_records import Field, parsed

FIELDS = (Field("id", "int", False), Field("name", "text"), Field("day", "date"), Field("size", "int"))
RECORD = "concat_ws('|', p_partkey, concat(p_name, CASE p_partkey % 3 WHEN 0 THEN '|extra' ELSE '' END), CASE WHEN p_partkey % 10 = 0 THEN 'soon' ELSE '2020-02-02' END, p_size)"


def pipe_repair(spark: SparkSession, d: str) -> DataFrame:
    return parsed(table(spark, d, "part").select(F.expr(RECORD).alias("value")), FIELDS)


def html_extract(spark: SparkSession, d: str) -> DataFrame:
    return extracted(table(spark, d, "pages"))


def sql_guard(spark: SparkSession, d: str) -> DataFrame:
    text = "```sql\nSELECT ein, count(*) AS n -- filings\nFROM filings WHERE return_type <> 'DROP' GROUP BY ein ORDER BY n DESC, ein LIMIT 20;\n```"
    return ask(spark, text, {"filings": returns(spark, d)})


FILING = """concat('<Return xmlns="urn:x"><ReturnHeader><TaxYr>', year(o_orderdate), '</TaxYr><Filer><EIN>', o_custkey, '</EIN></Filer></ReturnHeader><ReturnData><IRS990ScheduleC><TotalDirectLobbyingGrp><FilingOrganizationsTotalAmt>',
  o_orderkey, '</FilingOrganizationsTotalAmt></TotalDirectLobbyingGrp><TotalLobbyingExpendGrp><x/><FilingOrganizationsTotalAmt> ', o_orderkey + 1, '</FilingOrganizationsTotalAmt></TotalLobbyingExpendGrp>',
  CASE WHEN o_orderkey % 3 = 0 THEN '<Form1120POLFiledInd>X</Form1120POLFiledInd>' ELSE '' END, '</IRS990ScheduleC><IRS990ScheduleI>',
  CASE WHEN o_orderkey % 4 = 0 THEN '<RecipientTable><CashGrantAmt>0</CashGrantAmt></RecipientTable>' ELSE '' END, '<RecipientTable><RecipientEIN>', o_custkey + 1, '</RecipientEIN><CashGrantAmt>0</CashGrantAmt></RecipientTable>',
  CASE WHEN o_orderkey % 5 = 0 THEN '<RecipientTable><y> </y></RecipientTable><RecipientTable><CashGrantAmt>7</CashGrantAmt><ZIPCd>123</ZIPCd></RecipientTable>' ELSE '' END, '</IRS990ScheduleI></ReturnData></Return>')"""
LAYOUT = xml_filing.Layout(
    header={"filing_id": ("ReturnHeader/FilingId",), "ein": ("ReturnHeader/Filer/EIN",), "tax_year": ("ReturnHeader/TaxYr", "ReturnHeader/TaxYear")} | xml_filing.schedule_c("form1120_pol_filed_ind"),
    required=("ein",),
    groups={"grants": ("//RecipientTable", xml_filing.anywhere("recipient_ein", "cash_grant_amt", "zipcd"))},
)


def parsed_filings(spark: SparkSession, d: str, layout: xml_filing.Layout) -> DataFrame:
    """Keys are dealt out before filings are made of them: parsing costs far more than the few bytes that a split is cut by."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate").repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    files = orders.select(F.col("o_orderkey").cast("string").alias("path"), F.expr(FILING).cast("binary").alias("content"))
    return xml_filing.parse_filings(files, layout)


def filings_parsed(spark: SparkSession, d: str) -> DataFrame:
    wanted = ("ein", "tax_year", "total_direct_lobbying_amt", "total_lobbying_expend_grp_amt", "total_grassroots_lobbying_amt", "form1120_pol_filed_ind")
    return parsed_filings(spark, d, LAYOUT.only()).select("path", *(f"header.{c}" for c in wanted), "error")


def grant_rows_parsed(spark: SparkSession, d: str) -> DataFrame:
    good = parsed_filings(spark, d, LAYOUT.only("grants", header=())).where("error is null").select(F.col("path").alias("filing_id"), F.posexplode("grants").alias("row_no", "row")).select("filing_id", "row_no", "row.*")
    return xml_filing.without_placeholders(good).select("filing_id", "recipient_ein", "cash_grant_amt", "zipcd")


QUERIES = {"filings_parsed": filings_parsed, "grant_rows_parsed": grant_rows_parsed, "pipe_repair": pipe_repair, "html_extract": html_extract, "sql_guard": sql_guard}
ORACLES = {
    "filings_parsed": """SELECT CAST(o_orderkey AS VARCHAR) AS path, CAST(o_custkey AS VARCHAR) AS ein, CAST(year(o_orderdate) AS VARCHAR) AS tax_year, CAST(o_orderkey AS VARCHAR) AS total_direct_lobbying_amt,
  CAST(o_orderkey + 1 AS VARCHAR) AS total_lobbying_expend_grp_amt, NULL::VARCHAR AS total_grassroots_lobbying_amt, CASE WHEN o_orderkey % 3 = 0 THEN 'X' END AS form1120_pol_filed_ind, NULL::VARCHAR AS error FROM orders""",
    "grant_rows_parsed": """SELECT CAST(o_orderkey AS VARCHAR) AS filing_id, CAST(o_custkey + 1 AS VARCHAR) AS recipient_ein, '0' AS cash_grant_amt, NULL::VARCHAR AS zipcd FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, '7', '123' FROM orders WHERE o_orderkey % 5 = 0""",
    "pipe_repair": """SELECT CASE WHEN ok THEN p_partkey END AS id, CASE WHEN ok THEN p_name || CASE p_partkey % 3 WHEN 0 THEN '|extra' ELSE '' END END AS name,
  CASE WHEN ok THEN DATE '2020-02-02' END AS day, CASE WHEN ok THEN CAST(p_size AS BIGINT) END AS size, CASE WHEN ok THEN CASE p_partkey % 3 WHEN 0 THEN 'LITERAL_PIPE' ELSE '' END END AS repair,
  CASE WHEN NOT ok THEN CASE p_partkey % 3 WHEN 0 THEN 'too many fields: no repair fits' ELSE 'a value doesn''t fit its column' END END AS error FROM (SELECT *, p_partkey % 10 <> 0 AS ok FROM part)""",
    "sql_guard": "SELECT o_custkey AS ein, count(*) AS n FROM orders WHERE o_orderstatus <> 'DROP' GROUP BY ein ORDER BY n DESC, ein LIMIT 20",
}
