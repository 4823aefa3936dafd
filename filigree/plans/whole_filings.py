"""Whole filings of four forms made from orders: 50 columns, people, preflight and the paths of their elements, with SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators import core_data as core
from filigree.operators import people_search as search
from filigree.operators import preflight as checks
from filigree.operators import related
from filigree.plans.roles import table
from filigree.sources import layouts, xml_filing

KINDS = {0: "990", 1: "990EZ", 2: "990PF", 3: "990T"}
FORM_COLUMNS = {
    0: (*layouts.COMMON, *layouts.PUBLIC, *layouts.FORM_990),
    1: (*layouts.COMMON, *layouts.PUBLIC, *layouts.FORM_EZ),
    2: (*layouts.COMMON, *layouts.FORM_PF),
}
SCHEDULE = (*layouts.SCHEDULE_C, "total_direct_lobbying_amt", "total_grassroots_lobbying_amt", "total_lobbying_expend_grp_amt")


def value(column: str, place: int) -> str:
    """What the filing of order k says in a column, in words that Spark and DuckDB share."""
    if column == "formation_yr":
        return "1900 + k % 100"
    if column.endswith(("_amt", "amt", "_cnt", "_hours_cnt")):
        few = 9 if column in SCHEDULE else 3  # Schedule C leaves most blank, so that all its totals are met
        return f"CASE WHEN (k + {place}) % {few} = 1 THEN (k + {place}) % 4 * {place + 1} END"
    if column.endswith("ind"):
        return f"CASE (k + {place}) % 7 WHEN 0 THEN 'X' WHEN 1 THEN 'false' WHEN 2 THEN 'true' WHEN 3 THEN 'maybe' WHEN 4 THEN '0' END"
    return f"CASE WHEN (k + {place}) % 3 > 0 THEN concat('{column} ', k % 50) END"


def child_value(column: str, place: int) -> str:
    return "concat('Ada ', c)" if column == "person_nm" else f"(k + {place}) % 101" if column.endswith("_pct") else value(column, place)


VALUES = {form: {c: value(c, i) for i, c in enumerate(columns)} for form, columns in (FORM_COLUMNS | {4: SCHEDULE}).items()}


def element(tag: str, text: str) -> str:
    return f"coalesce(concat('<{tag}>', {text}, '</{tag}>'), '')"


def written(columns: dict[str, str]) -> str:
    out = []
    for column, text in columns.items():
        if scope := xml_filing.SCHEDULE_C_AMOUNTS.get(column):
            out.append(f"'<{scope[0]}>', {element(scope[1], text)}, '</{scope[0]}>'")
        else:
            out.append(element(xml_filing.tags(column)[0], text))
    return f"concat({', '.join(out)})"


#: Rows of child tables: the j-th has one in every fifth filing.
CHILD_VALUES = {name: (tag.split("|")[0], {c: child_value(c, i) for i, c in enumerate(columns)}) for name, (tag, columns) in layouts.CHILDREN.items()}
CHILD_VALUES["contractors"] = ("ContractorCompensationGrp", {"person_nm": "concat('Ada ', c)", "compensation_amt": "k % 50", "city_nm": "'Pay'", "services_desc": "'Law'"})
PLACES = {name: j for j, name in enumerate(CHILD_VALUES)}


def rows_xml(names: Sequence[str]) -> str:
    return ", ".join(f"CASE WHEN (k + {PLACES[n]}) % 5 = 0 THEN concat('<{CHILD_VALUES[n][0]}>', {written(CHILD_VALUES[n][1])}, '</{CHILD_VALUES[n][0]}>') ELSE '' END" for n in names)


CHILDREN = rows_xml([name for name in CHILD_VALUES if name not in related.GROUPS])
SCHEDULE_R = f"concat('<IRS990ScheduleR>', {rows_xml(related.GROUPS)}, '</IRS990ScheduleR>')"
BOOKS = "'<BooksInCareOfDetail><PersonNm>Ada ', c, '</PersonNm><AddressLine1Txt>1 Book St</AddressLine1Txt><CityNm>Bookton</CityNm><StateAbbreviationCd>NY</StateAbbreviationCd><ZIPCd>1</ZIPCd><PhoneNum>5</PhoneNum></BooksInCareOfDetail>'"
SIGNED = """CASE WHEN k % 7 = 3 THEN concat('<PreparerPersonNm>Ada ', c, '</PreparerPersonNm><PTIN>P1</PTIN>') ELSE '' END, CASE WHEN k % 3 = 1 THEN concat('<PersonNm>Ada ', c, '</PersonNm><PersonTitleTxt>Boss</PersonTitleTxt>') ELSE '' END"""

#: Every 13th file is cut short, every 11th has no number, every 17th no version, every 19th no main form.
FORMS = " ".join(f"WHEN {form} THEN concat('<IRS{KINDS[form]}>', {written(VALUES[form])}, g, '</IRS{KINDS[form]}>', r)" for form in FORM_COLUMNS)
GROUPS = f"""concat({BOOKS}, CASE WHEN k % 6 = 0 THEN '<GrantsToOrganizationsInd>X</GrantsToOrganizationsInd>' ELSE '' END,
  CASE WHEN k % 10 = 0 THEN '<RecipientTable><CashGrantAmt>0</CashGrantAmt></RecipientTable>' WHEN k % 5 = 0 THEN concat('<RecipientTable><RecipientEIN>', c, '</RecipientEIN></RecipientTable>') ELSE '' END,
  CASE WHEN k % 3 = 0 THEN repeat(concat('<Form990PartVIISectionAGrp><PersonNm>Ada ', c, '</PersonNm><TitleTxt>Chair</TitleTxt><ReportableCompFromOrgAmt>1,', 100 + k % 900, '</ReportableCompFromOrgAmt><OfficerInd>X</OfficerInd>',
    CASE WHEN k % 9 = 0 THEN '<KeyEmployeeInd>true</KeyEmployeeInd><HighestCompensatedEmployeeInd>1</HighestCompensatedEmployeeInd>' ELSE '' END, '</Form990PartVIISectionAGrp>'), 2) ELSE '' END, {CHILDREN})"""
XML = f"""concat('<Return xmlns="urn:x"', CASE WHEN k % 17 = 0 THEN '' ELSE concat(' returnVersion="', CASE WHEN k % 8 < 4 THEN '2017v2.3' ELSE '2024v5.0' END, '"') END, '><ReturnHeader><ReturnTypeCd>',
  CASE k % 4 {" ".join(f"WHEN {n} THEN '{kind}'" for n, kind in KINDS.items())} END, '</ReturnTypeCd><TaxYr>', y, '</TaxYr><TaxPeriodBeginDt>', y, '-01-01</TaxPeriodBeginDt><TaxPeriodEndDt>', y, '-12-31</TaxPeriodEndDt><Filer>',
  CASE WHEN k % 11 = 0 THEN '' ELSE concat('<EIN>', c, '</EIN>') END, '<BusinessName><BusinessNameLine1Txt>Org ', c, '</BusinessNameLine1Txt></BusinessName><USAddress><AddressLine1Txt>9 Main</AddressLine1Txt><CityNm>City ', c % 30, '</CityNm><StateAbbreviationCd>CA</StateAbbreviationCd><ZIPCd>9</ZIPCd></USAddress>',
  CASE WHEN k % 7 = 2 THEN concat('<InCareOfNm>Ada ', c, '</InCareOfNm>') ELSE '' END, '</Filer>', {SIGNED}, '</ReturnHeader><ReturnData>',
  CASE WHEN k % 19 = 0 THEN '' ELSE CASE k % 4 {FORMS} ELSE '' END END, CASE WHEN k % 4 < 2 THEN concat('<IRS990ScheduleC>', {written(VALUES[4])}, '</IRS990ScheduleC>') ELSE '' END, CASE WHEN k % 13 = 0 THEN '' ELSE '</ReturnData></Return>' END)"""


def files(spark: SparkSession, d: str) -> DataFrame:
    """Keys are dealt out before filings are made of them: parsing costs far more than the few bytes that a split is cut by."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.year("o_orderdate").alias("y"))
    orders = orders.repartition(spark.sparkContext.defaultParallelism, "k")
    return orders.withColumns({"g": F.expr(GROUPS), "r": F.expr(SCHEDULE_R)}).select(F.format_string("/in/%d.xml", "k").alias("path"), F.expr(XML).cast("binary").alias("content"))


def filings(spark: SparkSession, d: str, *parts: str, header: Sequence[str] | None = None) -> DataFrame:
    return xml_filing.parse_filings(files(spark, d), layouts.FILING.only(*parts, header=header) if parts else layouts.FILING)


def core_data(spark: SparkSession, d: str) -> DataFrame:
    return core.core_data(filings(spark, d, "f990", "ez", "pf", "sc", header=core.HEADER))


def part_seven_people(spark: SparkSession, d: str) -> DataFrame:
    return core.people(filings(spark, d, "part_vii", header=()))


def schedule_r_related(spark: SparkSession, d: str) -> DataFrame:
    """Of the filings that count, unrelated partnerships included."""
    return related.schedule_r(core.canonical(filings(spark, d, *related.GROUPS, header=("return_ts", "amended"))), unrelated=True)


PERSON, YEARS = "da 1_", (1993, 1996)


def people_search(spark: SparkSession, d: str) -> DataFrame:
    """Without a budget: every hit."""
    return search.people_search(filings(spark, d, *search.PARTS, header=search.HEADER), PERSON, fuzzy=True, state="ca", years=YEARS, max_rows=None)


def preflight(spark: SparkSession, d: str) -> DataFrame:
    codes = F.concat_ws("|", F.transform("caveats", lambda c: F.concat(c["severity"], F.lit(":"), c["code"]))).alias("caveats")
    checked = checks.preflight(filings(spark, d, *checks.PARTS, header=checks.HEADER))
    return checked.select(*(F.concat_ws("|", c).alias(c) if c == "recognized_forms" else c for c in checked.columns if c != "caveats"), codes)


def preflight_caveats(spark: SparkSession, d: str) -> DataFrame:
    return checks.caveat_counts(checks.preflight(filings(spark, d, *checks.PARTS, header=checks.HEADER)))


def element_paths(spark: SparkSession, d: str) -> DataFrame:
    """Of the header only, so that SQL can say it; the operator counts all paths."""
    return xml_filing.element_paths(files(spark, d)).where("path LIKE '/Return/ReturnHeader%'")


def typed(column: str, text: str) -> str:
    return f"CAST({text} AS DOUBLE)" if column.endswith(("amt", "_cnt", "_yr")) else f"CAST({text} AS VARCHAR)"


def said(form: int) -> str:
    """The values of one form's filings, with Schedule C's under `s_`; null where the form is left out."""
    main = ", ".join(f"CASE WHEN k % 19 > 0 THEN {typed(c, v)} END AS {c}" for c, v in VALUES.get(form, {}).items())
    schedule = ", ".join(f"{typed(c, v)} AS s_{c}" for c, v in VALUES[4].items())
    return f"said{form} AS (SELECT k, c, y, {main}, {schedule} FROM made WHERE k % 4 = {form})" if main else f"said{form} AS (SELECT k, c, y FROM made WHERE k % 4 = {form})"


MADE = "made AS (SELECT o_orderkey AS k, o_custkey AS c, year(o_orderdate) AS y FROM orders)"
SAID = ",\n".join(said(form) for form in KINDS)
X = {c: f"CASE WHEN {c} IN ('X', 'true') THEN 'X' WHEN {c} IN ('0', 'false') THEN '0' ELSE {c} END" for c in core.INDICATORS}
YES = "CASE WHEN {0} IN ('X', 'true') THEN 'Yes' WHEN {0} IN ('0', 'false') THEN 'No' ELSE '' END"
LOBBYING = f"coalesce(s_total_lobbying_expenditures_amt, s_total_lobbying_expend_grp_amt, nullif(coalesce(s_total_direct_lobbying_amt, 0) + coalesce(s_total_grassroots_lobbying_amt, 0), 0), nullif({' + '.join(f'coalesce(s_{a}_amt, 0)' for a in layouts.ACTIVITIES)}, 0))"
PUBLIC_STATUS = """CASE WHEN organization501c3_ind IN ('X', 'true') THEN '501(c)(3)' WHEN organization501c_ind IN ('X', 'true') AND attr_organization501c_type_txt IS NOT NULL
  THEN '501(c)(' || attr_organization501c_type_txt || ')' WHEN organization4947a1_not_pfind IN ('X', 'true') THEN '4947(a)(1)' ELSE '' END"""
PF_STATUS = """CASE WHEN organization501c3_exempt_pfind IN ('X', 'true') THEN '501(c)(3)' WHEN organization4947a1_trtd_pfind IN ('X', 'true') THEN '4947(a)(1)'
  WHEN organization501c3_exempt_pfind IN ('0', 'false') AND organization4947a1_trtd_pfind IN ('0', 'false') THEN 'other taxable private foundation' ELSE '' END"""
KIND = """CASE WHEN type_of_organization_corp_ind IN ('X', 'true') THEN 'Corporation' WHEN type_of_organization_trust_ind IN ('X', 'true') THEN 'Trust'
  WHEN type_of_organization_assoc_ind IN ('X', 'true') THEN 'Association' WHEN type_of_organization_other_ind IN ('X', 'true') THEN coalesce({0}, '') ELSE '' END"""
BALANCES = {f"total_{what}_{at}": f"total_{what}_{at}amt" for what in ("assets", "liabilities") for at in ("boy", "eoy")}
FUNDS = {f"net_assets_{at}": f"net_assets_or_fund_balances_{at}amt" for at in ("boy", "eoy")}
BOTH = X | FUNDS | {
    "tax_exempt_status": PUBLIC_STATUS, "website_address_txt": "website_address_txt", "membership_dues": "membership_dues_amt", "lobbying_expense": LOBBYING,
    "political_campaign_activity_ind": YES.format("political_campaign_acty_ind"), "lobbying_activities_ind": YES.format("lobbying_activities_ind"), "dues_assessments_ind": YES.format("s_substantially_all_dues_nonded_ind"),
}
SQL_FORMS = {
    0: BOTH | BALANCES | {
        "formation_year": "CAST(formation_yr AS BIGINT)", "legal_domicile_state_cd": "legal_domicile_state_cd", "organization_form": KIND.format("other_organization_dsc"),
        "mission_desc": "coalesce(mission_desc, activity_or_mission_desc)", "employees_count": "CAST(coalesce(total_employee_cnt, employee_cnt) AS BIGINT)", "volunteers_count": "CAST(total_volunteers_cnt AS BIGINT)",
        "contributions_and_grants": "CASE WHEN cycontributions_grants_amt <> 0 THEN cycontributions_grants_amt ELSE contributions_gifts_grants_etc_amt END",
        "program_service_revenue": "coalesce(total_program_service_revenue_amt, cyprogram_service_revenue_amt)", "investment_income": "cyinvestment_income_amt", "other_revenue": "cyother_revenue_amt",
        "total_revenue": "CASE WHEN cytotal_revenue_amt <> 0 THEN cytotal_revenue_amt ELSE total_revenue_amt END", "grants_paid": "cygrants_and_similar_paid_amt",
        "salaries_comp_emp_benefits": "cysalaries_comp_emp_bnft_paid_amt", "professional_fundraising_fees": "cytotal_prof_fndrsng_expns_amt", "total_fundraising_expenses": "cytotal_fundraising_expense_amt",
        "other_expenses": "cyother_expenses_amt", "total_expenses": "CASE WHEN cytotal_expenses_amt <> 0 THEN cytotal_expenses_amt ELSE total_functional_expenses_amt END",
        "revenue_less_expenses": "cyrevenues_less_expenses_amt", "government_grants": "government_grants_amt",
    },
    1: BOTH | {
        "organization_form": KIND.format("type_of_organization_other_desc"), "mission_desc": "primary_exempt_purpose_txt", "program_service_revenue": "program_service_revenue_amt",
        "investment_income": "investment_income_amt", "other_revenue": "other_revenue_total_amt", "total_revenue": "total_revenue_amt", "grants_paid": "grants_and_similar_amounts_paid_amt",
        "salaries_comp_emp_benefits": "salaries_other_comp_empl_bnft_amt", "other_expenses": "other_expenses_total_amt", "total_expenses": "total_expenses_amt",
        "revenue_less_expenses": "excess_or_deficit_for_year_amt", "total_assets_boy": "boyamt", "total_assets_eoy": "eoyamt", "total_liabilities_boy": "boyamt", "total_liabilities_eoy": "eoyamt",
    },
    2: X | BALANCES | {
        "tax_exempt_status": PF_STATUS, "organization_form": "''", "website_address_txt": "website_address_txt", "mission_desc": "mission_desc_txt", "contributions_and_grants": "contri_paid_rev_and_expnss_amt",
        "investment_income": "net_investment_income_amt", "other_revenue": "other_income_rev_and_expnss_amt", "total_revenue": "total_rev_and_expnss_amt", "grants_paid": "total_grant_or_contri_pd_dur_yr_amt",
        "salaries_comp_emp_benefits": "coalesce(oth_empl_slrs_wgs_rev_and_expnss_amt, 0) + coalesce(pension_empl_bnft_rev_and_expnss_amt, 0)", "other_expenses": "other_expenses_rev_and_expnss_amt",
        "total_expenses": "total_expenses_rev_and_expnss_amt", "revenue_less_expenses": "excess_revenue_over_expenses_amt", "net_assets_boy": "coalesce(total_assets_boyamt, 0) - coalesce(total_liabilities_boyamt, 0)",
        "net_assets_eoy": "coalesce(total_assets_eoyamt, 0) - coalesce(total_liabilities_eoyamt, 0)", "political_campaign_activity_ind": "''", "dues_assessments_ind": "''",
        "lobbying_activities_ind": YES.format("legislative_political_acty_ind"),
    },
    3: dict.fromkeys(("tax_exempt_status", "organization_form", "political_campaign_activity_ind", "lobbying_activities_ind", "dues_assessments_ind"), "''"),
}


def form_sql(form: int) -> str:
    known = {
        "ein": "CAST(c AS VARCHAR)", "org_name": "'Org ' || c", "tax_year": "CAST(y AS BIGINT)", "return_type": f"'{KINDS[form]}'", "period_start": "y || '-01-01'", "period_end": "y || '-12-31'",
        "us_address_line1": "'9 Main'", "city": "'City ' || c % 30", "state": "'CA'", "zip": "'9'", "filing_id": "CAST(k AS VARCHAR)",
    } | SQL_FORMS[form]
    empty = {c: "VARCHAR" if c in core.WORDS or c in core.HEADER else "BIGINT" if c in core.COUNTS else "DOUBLE" for c in core.COLUMNS}
    return f"SELECT {', '.join(f'{known.get(c, f"CAST(NULL AS {t})")} AS {c}' for c, t in empty.items())} FROM said{form} WHERE k % 11 > 0 AND k % 13 > 0"


def count(columns: list[str]) -> str:
    return " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in columns)


SHARED = ("total_revenue", "total_expenses", "net_assets_boy", "net_assets_eoy", "membership_dues", "investment_income", "grants_paid")
MAIN_COUNT = [
    "CASE WHEN total_program_service_revenue_amt <> 0 THEN total_program_service_revenue_amt ELSE cyprogram_service_revenue_amt END",
    *(f"({SQL_FORMS[0][c]})" for c in (*SHARED, "contributions_and_grants", "government_grants", "lobbying_expense", "employees_count", "volunteers_count", "mission_desc")),
]
CHECKED = f"""fields AS (SELECT k, {count(MAIN_COUNT)} AS n, coalesce(cygrants_and_similar_paid_amt > 0, false) AS paid, false AS contributed FROM said0
  UNION ALL SELECT k, {count([f"({SQL_FORMS[1][c]})" for c in (*SHARED, "program_service_revenue", "mission_desc")])}, coalesce(grants_and_similar_amounts_paid_amt > 0, false), false FROM said1
  UNION ALL SELECT k, {count(["total_rev_and_expnss_amt", "total_expenses_rev_and_expnss_amt"])}, coalesce(contri_paid_rev_and_expnss_amt > 0, false), coalesce(contri_paid_rev_and_expnss_amt > 0, false) FROM said2
  UNION ALL SELECT k, 0, false, false FROM said3),
facts AS (SELECT k, c, y, CASE k % 4 WHEN 0 THEN '990' WHEN 1 THEN '990EZ' WHEN 2 THEN '990PF' ELSE '990T' END AS kind, CASE WHEN k % 17 > 0 THEN CASE WHEN k % 8 < 4 THEN '2017v2.3' ELSE '2024v5.0' END END AS version,
  k % 19 > 0 AND k % 4 < 3 AS form, n, paid, contributed, CASE WHEN k % 13 = 0 THEN 'parse_error' WHEN k % 11 = 0 THEN 'missing_required_header' ELSE 'ok' END AS status FROM made JOIN fields USING (k)),
rows_ AS (SELECT *, CAST(form AND k % 5 = 0 AND k % 10 > 0 AS INTEGER) AS grant_rows, CAST(form AND k % 3 = 0 AS INTEGER) AS officer_rows, form AND k % 6 = 0 AS organizations FROM facts),
codes AS (SELECT *, CASE WHEN status <> 'ok' THEN ['error:' || status] ELSE list_filter([CASE WHEN version IS NULL THEN 'warning:schema_version_missing' END,
  CASE WHEN kind = '990T' THEN 'error:unsupported_return_type' END, CASE WHEN NOT form THEN 'error:no_recognized_main_form' END, CASE WHEN kind <> '990T' AND version = '2024v5.0' THEN 'warning:unknown_form_version_combo' END,
  CASE WHEN n = 0 THEN 'warning:all_core_hot_fields_blank' END, CASE WHEN grant_rows = 0 AND (organizations OR paid) THEN 'warning:grant_signal_without_detail_rows' END,
  CASE WHEN grant_rows = 0 AND kind = '990PF' AND contributed THEN 'warning:pf_contributions_paid_without_detail_rows' END], lambda x: x IS NOT NULL) END AS caveats,
  CASE WHEN status <> 'parse_error' THEN kind END AS return_type, CASE WHEN status <> 'parse_error' THEN version END AS schema_version FROM rows_)"""
CHILD_COUNTS = {
    "contractor_rows": ("contractors",), "ez_officer_rows": ("ez_officers",), "pf_officer_rows": ("pf_officers",), "schedule_l_rows": ("l_business", "l_excess_benefit", "l_grants", "l_loans"),
    "schedule_r_rows": related.GROUPS,
}


def rows_sql(names: tuple[str, ...]) -> str:
    return " + ".join(f"CAST(form AND (k + {PLACES[n]}) % 5 = 0 AS INTEGER)" for n in names)


HEADER_PATHS = {
    "": "true", "/ReturnTypeCd": "true", "/TaxYr": "true", "/TaxPeriodBeginDt": "true", "/TaxPeriodEndDt": "true", "/Filer": "true", "/Filer/EIN": "k % 11 > 0", "/Filer/BusinessName": "true",
    "/Filer/BusinessName/BusinessNameLine1Txt": "true", "/Filer/USAddress": "true", **{f"/Filer/USAddress/{tag}": "true" for tag in ("AddressLine1Txt", "CityNm", "StateAbbreviationCd", "ZIPCd")}, "/Filer/InCareOfNm": "k % 7 = 2",
    "/PreparerPersonNm": "k % 7 = 3", "/PTIN": "k % 7 = 3", "/PersonNm": "k % 3 = 1", "/PersonTitleTxt": "k % 3 = 1",
}
BRANCHES = ("", "/Filer", "/Filer/BusinessName", "/Filer/USAddress")

CHOSEN = """chosen AS (SELECT k, c, y FROM (SELECT k, c, y, row_number() OVER (PARTITION BY c, y ORDER BY coalesce(a, '0') DESC, CAST(k AS VARCHAR) DESC) AS rn FROM (
  SELECT k, c, y, CASE WHEN amended_return_ind IN ('X', 'true') THEN 'X' WHEN amended_return_ind IN ('0', 'false') THEN '0' END AS a
  FROM (SELECT k, c, y, amended_return_ind FROM said0 UNION ALL SELECT k, c, y, amended_return_ind FROM said1 UNION ALL SELECT k, c, y, amended_return_ind FROM said2) WHERE k % 11 > 0 AND k % 13 > 0)) WHERE rn = 1)"""


def related_sql(group: str) -> str:
    columns = {c: f"CAST({v} AS VARCHAR)" for c, v in CHILD_VALUES[group][1].items()}

    def of(c: str) -> str:
        return columns.get(c, "NULL::VARCHAR")

    def line(n: int) -> str:
        heads = ("related_organization_name_business_name", "business_name", "disregarded_entity_name_business_name")
        return f"trim(coalesce({', '.join(of(f'{h}_line{n}_txt') for h in heads)}, ''))"

    controlled = of("general_or_managing_partner_ind" if group == "r_unrelated" else "controlled_organization_ind")
    plain = {c: of(source) for c, (source, _) in related.OTHERS.items()} | {"controlled_org_ind": controlled}
    category, name = related.CATEGORIES[group]
    return f"""SELECT CAST(c AS VARCHAR) AS filer_ein, CAST(y AS BIGINT) AS filer_tax_year, CAST(k AS VARCHAR) AS filing_id, '{category}' AS relationship_category, {of("ein")} AS related_ein,
  {line(1)} AS one, {line(2)} AS two, CAST({of("ownership_pct")} AS DOUBLE) AS ownership_pct, CAST({of("involved_amt")} AS DOUBLE) AS involved_amt,
  {", ".join(f"{v} AS {c}" for c, v in plain.items())}, '{name}' AS table_source FROM chosen WHERE k % 19 > 0 AND (k + {PLACES[group]}) % 5 = 0"""


def hit_sql(label: str, person: str, parts: dict[str, str], where: str) -> str:
    said = " || ".join(f"' | {k}=' || coalesce(CAST({v} AS VARCHAR), '')" for k, v in parts.items())
    return f"SELECT k, c, y, '{label}' AS found_in, 'name=' || {person} || {said} AS detail FROM good WHERE {where}"


ADA, FORM = "('Ada ' || c)", "k % 19 > 0 AND k % 4 < 3"
PAY = {"title": "'Chair'", "hrs/wk": "NULL", "comp_org": "(1100 + k % 900) || '.0'", "comp_rel": "NULL", "other": "NULL"}
FORM_BOOKS = {"addr1": "'1 Book St'", "city": "'Bookton'", "state": "'NY'", "zip": "'1'", "phone": "'5'"}
ROOT_BOOKS = {"addr1": "'9 Main'", "city": "'City ' || c % 30", "state": "'CA'", "zip": "'9'", "phone": f"CASE WHEN {FORM} THEN '5' END"}
OF_CHILD = {
    "ez_officers": ("EZ Officer/Director/Trustee/Employee", {"title": "title_txt", "hrs/wk": "average_hrs_per_wk_devoted_to_pos_rt", "comp": "compensation_amt", "benefits": "employee_benefit_program_amt", "other": "expense_account_other_allwnc_amt"}),
    "schedule_j": ("Schedule J (Officer/Trustee/Key)", {"title": "title_txt", "base": "base_compensation_filing_org_amt", "bonus": "bonus_filing_organization_amount", "total_org": "total_compensation_filing_org_amt", "total_rel": "total_compensation_rltd_orgs_amt"}),
    "pf_officers": ("990-PF Officer/Director/Trustee/Key", {"title": "title_txt", "hrs/wk": "average_hrs_per_wk_devoted_to_pos_rt", "comp": "compensation_amt", "benefits": "employee_benefits_amt", "expense": "expense_account_amt"}),
    "l_business": ("Schedule L (Business Transactions)", {"relationship": "relationship_description_txt", "amount": "transaction_amt", "desc": "transaction_desc"}),
    "l_excess_benefit": ("Schedule L (Excess Benefit Transaction)", {"relationship": "rln_disqualified_person_org_txt", "corrected": "transaction_corrected_ind", "desc": "transaction_desc"}),
    "l_grants": ("Schedule L (Grant/Assist to Interested Person)", {"relationship": "relationship_with_org_txt", "cash": "cash_grant_amt", "assist_type": "type_of_assistance_txt", "purpose": "assistance_purpose_txt"}),
    "l_loans": ("Schedule L (Loans Between Org & Interested Person)", {"relationship": "relationship_with_org_txt", "orig_principal": "original_principal_amt", "balance_due": "balance_due_amt", "purpose": "loan_purpose_txt"}),
}
HITS = [
    hit_sql("Returns (In Care Of Name)", ADA, {"addr1": "'9 Main'", "city": "'City ' || c % 30", "state": "'CA'", "zip": "'9'"}, "k % 7 = 2"),
    hit_sql("Officer/Director/Trustee", ADA, PAY, f"{FORM} AND k % 3 = 0"),
    hit_sql("Highly Compensated Employee", ADA, PAY, f"{FORM} AND k % 9 = 0"),
    hit_sql("Former/Key Employee", ADA, {k: v for k, v in PAY.items() if k != "hrs/wk"}, f"{FORM} AND k % 9 = 0"),
    hit_sql("Contractor", ADA, {"services": "'Law'", "comp": "(k % 50) || '.0'", "city": "'Pay'", "region": "NULL", "country": "NULL"}, f"{FORM} AND (k + {PLACES['contractors']}) % 5 = 0"),
    hit_sql("Return Header (Signer/Officer)", ADA, {"title": "CASE WHEN k % 3 = 1 THEN 'Boss' END", "signed": "NULL"}, f"k % 3 = 1 OR ({FORM})"),
    hit_sql("Return Header (Preparer)", ADA, {"firm": "NULL", "ptin": "'P1'", "prep_dt": "NULL"}, "k % 7 = 3"),
    *(hit_sql(label, ADA, books, f"({where}) AND (k % 3 = 1 OR ({FORM}))") for label, n in (("Books In Care Of", 0), ("Books In Care Of (EZ)", 1)) for books, where in ((FORM_BOOKS, f"k % 4 = {n} AND k % 19 > 0"), (ROOT_BOOKS, f"k % 4 <> {n} OR k % 19 = 0"))),
    *(hit_sql(label, ADA, {part: CHILD_VALUES[name][1][c] for part, c in parts.items()}, f"{FORM} AND (k + {PLACES[name]}) % 5 = 0") for name, (label, parts) in OF_CHILD.items()),
]

QUERIES = {"schedule_r_related": schedule_r_related, "people_search": people_search, "core_data": core_data, "part_seven_people": part_seven_people, "preflight": preflight, "preflight_caveats": preflight_caveats, "element_paths": element_paths}
ORACLES = {
    "schedule_r_related": f"WITH {MADE},\n{SAID},\n{CHOSEN}\nSELECT * EXCLUDE (one, two), one || CASE WHEN two <> '' THEN ' ' || two ELSE '' END AS related_name FROM (" + "\nUNION ALL ".join(map(related_sql, related.GROUPS)) + ")",
    "people_search": f"WITH {MADE}, good AS (SELECT * FROM made WHERE k % 11 > 0 AND k % 13 > 0 AND y BETWEEN {YEARS[0]} AND {YEARS[1]} AND ('Ada ' || c) ILIKE '%{PERSON}%')\nSELECT DISTINCT CAST(k AS VARCHAR) AS filing_id, CAST(c AS VARCHAR) AS ein, 'Org ' || c AS org_name, CAST(y AS BIGINT) AS tax_year, found_in, detail FROM (" + "\nUNION ALL ".join(HITS) + ")",
    "core_data": f"WITH {MADE},\n{SAID}\n" + "\nUNION ALL ".join(form_sql(f) for f in KINDS),
    "part_seven_people": f"""WITH {MADE} SELECT CAST(k AS VARCHAR) AS filing_id, 'Ada ' || c AS person_name, 'Chair' AS title_txt, CAST(NULL AS DOUBLE) AS avg_hours_week, CAST(1100 + k % 900 AS DOUBLE) AS comp_from_org,
  CAST(NULL AS DOUBLE) AS comp_from_related, CAST(NULL AS DOUBLE) AS other_compensation, 'X' AS is_officer, CAST(NULL AS VARCHAR) AS is_director, CASE WHEN k % 9 = 0 THEN 'X' END AS is_key_employee,
  CAST(NULL AS VARCHAR) AS is_former, k % 9 = 0 AS highest, k % 9 = 0 AS former_or_key FROM made WHERE k % 3 = 0 AND k % 4 < 3 AND k % 19 > 0 AND k % 11 > 0 AND k % 13 > 0""",
    "preflight": f"""WITH {MADE},\n{SAID},\n{CHECKED}
SELECT CAST(k AS VARCHAR) AS filing_id, '/in/' || k || '.xml' AS source_file, status, return_type, schema_version, CASE WHEN status <> 'parse_error' THEN y || '-12-31' END AS period_end,
  CASE WHEN status <> 'parse_error' AND k % 11 > 0 THEN CAST(c AS VARCHAR) END AS ein, CASE WHEN status <> 'parse_error' THEN CAST(y AS BIGINT) END AS tax_year,
  CASE WHEN status = 'ok' AND form THEN kind ELSE '' END AS recognized_forms, CASE WHEN status = 'ok' THEN n END AS core_present_fields, CASE WHEN status = 'ok' THEN grant_rows END AS grant_rows,
  CASE WHEN status = 'ok' THEN officer_rows END AS officer_rows, {", ".join(f"CASE WHEN status = 'ok' THEN {rows_sql(names)} END AS {c}" for c, names in CHILD_COUNTS.items())}, array_to_string(caveats, '|') AS caveats FROM codes""",
    "preflight_caveats": f"""WITH {MADE},\n{SAID},\n{CHECKED}
SELECT return_type, schema_version, split_part(x, ':', 2) AS code, split_part(x, ':', 1) AS severity, count(*) AS files FROM (SELECT return_type, schema_version, unnest(caveats) AS x FROM codes) GROUP BY ALL
UNION ALL SELECT return_type, schema_version, NULL, NULL, count(*) FROM codes GROUP BY ALL""",
    "element_paths": f"""WITH {MADE}, whole AS (SELECT k, CASE WHEN k % 17 = 0 THEN '' WHEN k % 8 < 4 THEN '2017v2.3' ELSE '2024v5.0' END AS version FROM made WHERE k % 13 > 0),
sizes AS (SELECT version, count(*) AS files FROM whole GROUP BY version)
"""
    + "\nUNION ALL ".join(
        f"SELECT version, '/Return/ReturnHeader{p}' AS path, count(*) AS filings, CAST({0 if p in BRANCHES else 'count(*)'} AS BIGINT) AS filled, any_value(files) AS files FROM whole JOIN sizes USING (version) WHERE {where} GROUP BY version"
        for p, where in HEADER_PATHS.items()
    ),
}
