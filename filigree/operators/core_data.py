"""One row of 50 columns for each filing, whichever form it was made on, from filings parsed by `layouts.FILING`."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.operators.windows import canonical_filings
from filigree.sources.layouts import ACTIVITIES

#: Columns of the result, in order.
COLUMNS = (
    "ein", "org_name", "dba_name", "tax_year", "return_type", "tax_exempt_status", "period_start", "period_end", "us_address_line1", "city", "state", "zip", "website_address_txt", "formation_year",
    "legal_domicile_state_cd", "organization_form", "mission_desc", "employees_count", "volunteers_count", "contributions_and_grants", "program_service_revenue", "investment_income", "other_revenue",
    "total_revenue", "grants_paid", "salaries_comp_emp_benefits", "professional_fundraising_fees", "total_fundraising_expenses", "other_expenses", "total_expenses", "revenue_less_expenses",
    "total_assets_boy", "total_assets_eoy", "total_liabilities_boy", "total_liabilities_eoy", "net_assets_boy", "net_assets_eoy", "political_campaign_activity_ind", "lobbying_activities_ind",
    "dues_assessments_ind", "membership_dues", "government_grants", "lobbying_expense", "address_change_ind", "name_change_ind", "initial_return_ind", "final_return_ind", "amended_return_ind",
    "application_pending_ind", "filing_id",
)
HEADER = ("ein", "org_name", "dba_name", "return_type", "period_start", "period_end", "us_address_line1", "city", "state", "zip")
INDICATORS = ("address_change_ind", "name_change_ind", "initial_return_ind", "final_return_ind", "amended_return_ind", "application_pending_ind")
WORDS = {"tax_exempt_status", "website_address_txt", "legal_domicile_state_cd", "organization_form", "mission_desc", "political_campaign_activity_ind", "lobbying_activities_ind", "dues_assessments_ind", *INDICATORS}
COUNTS = {"formation_year", "employees_count", "volunteers_count"}


def number(c: Column | str) -> Column:
    """An amount written with or without thousands separators; null where it isn't one."""
    return F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double")


def mark(c: Column | str) -> Column:
    """X for yes, 0 for no, anything else as it is."""
    said = F.upper(F.trim(c))
    return F.when(said.isin("X", "1", "TRUE", "T", "YES", "Y"), "X").when(said.isin("0", "FALSE", "F", "NO", "N"), "0").otherwise(F.nullif(F.trim(c), F.lit("")))


def answer(name: str) -> Column:
    return F.when(mark(name) == "X", "Yes").when(mark(name) == "0", "No").otherwise("")


def nonzero_or(first: Column, second: Column) -> Column:
    """The first amount unless it is missing or zero."""
    return F.when(first != 0, first).otherwise(second)


def plus(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.coalesce(number(n), F.lit(0.0)) for n in names))


def lobbying_expense() -> Column:
    """The first that Schedule C gives of: its total, its group's total, direct and grassroots together, all activities together."""
    sums = (plus(["sc.total_direct_lobbying_amt", "sc.total_grassroots_lobbying_amt"]), plus([f"sc.{a}_amt" for a in ACTIVITIES]))
    return F.coalesce(number("sc.total_lobbying_expenditures_amt"), number("sc.total_lobbying_expend_grp_amt"), *(F.nullif(s, F.lit(0.0)) for s in sums))


def status(form: str) -> Column:
    kind = F.trim(f"{form}.attr_organization501c_type_txt")
    return (
        F.when(mark(f"{form}.organization501c3_ind") == "X", "501(c)(3)")
        .when((mark(f"{form}.organization501c_ind") == "X") & (F.coalesce(kind, F.lit("")) != ""), F.concat(F.lit("501(c)("), kind, F.lit(")")))
        .when(mark(f"{form}.organization4947a1_not_pfind") == "X", "4947(a)(1)")
        .otherwise("")
    )


def foundation_status() -> Column:
    exempt, treated = mark("pf.organization501c3_exempt_pfind"), mark("pf.organization4947a1_trtd_pfind")
    taxable = (exempt == "0") & (treated == "0")
    return F.when(exempt == "X", "501(c)(3)").when(treated == "X", "4947(a)(1)").when(taxable, "other taxable private foundation").otherwise("")


def organization(form: str, other: str) -> Column:
    kinds = {"corp": F.lit("Corporation"), "trust": F.lit("Trust"), "assoc": F.lit("Association"), "other": F.coalesce(F.trim(f"{form}.{other}"), F.lit(""))}
    return F.coalesce(*(F.when(mark(f"{form}.type_of_organization_{k}_ind") == "X", v) for k, v in kinds.items()), F.lit(""))


def named(form: str, names: dict[str, str]) -> dict[str, Column]:
    return {c: number(f"{form}.{n}") for c, n in names.items()}


def main_form() -> dict[str, Column]:
    first = {"total_program_service_revenue_amt": "cyprogram_service_revenue_amt", "total_employee_cnt": "employee_cnt"}
    services, employees = (F.coalesce(number(f"f990.{a}"), number(f"f990.{b}")) for a, b in first.items())
    return named("f990", {
        "investment_income": "cyinvestment_income_amt", "other_revenue": "cyother_revenue_amt", "grants_paid": "cygrants_and_similar_paid_amt", "salaries_comp_emp_benefits": "cysalaries_comp_emp_bnft_paid_amt",
        "professional_fundraising_fees": "cytotal_prof_fndrsng_expns_amt", "total_fundraising_expenses": "cytotal_fundraising_expense_amt", "other_expenses": "cyother_expenses_amt",
        "revenue_less_expenses": "cyrevenues_less_expenses_amt", "total_assets_boy": "total_assets_boyamt", "total_assets_eoy": "total_assets_eoyamt", "total_liabilities_boy": "total_liabilities_boyamt",
        "total_liabilities_eoy": "total_liabilities_eoyamt", "net_assets_boy": "net_assets_or_fund_balances_boyamt", "net_assets_eoy": "net_assets_or_fund_balances_eoyamt", "membership_dues": "membership_dues_amt",
        "government_grants": "government_grants_amt", "formation_year": "formation_yr", "volunteers_count": "total_volunteers_cnt",
    }) | {
        "program_service_revenue": services, "employees_count": employees, "tax_exempt_status": status("f990"), "organization_form": organization("f990", "other_organization_dsc"),
        "total_revenue": nonzero_or(number("f990.cytotal_revenue_amt"), number("f990.total_revenue_amt")),
        "total_expenses": nonzero_or(number("f990.cytotal_expenses_amt"), number("f990.total_functional_expenses_amt")),
        "contributions_and_grants": nonzero_or(number("f990.cycontributions_grants_amt"), number("f990.contributions_gifts_grants_etc_amt")),
        "mission_desc": F.coalesce("f990.mission_desc", "f990.activity_or_mission_desc"), "legal_domicile_state_cd": F.col("f990.legal_domicile_state_cd"), "lobbying_expense": lobbying_expense(),
        "political_campaign_activity_ind": answer("f990.political_campaign_acty_ind"), "lobbying_activities_ind": answer("f990.lobbying_activities_ind"),
        "dues_assessments_ind": answer("sc.substantially_all_dues_nonded_ind"),
    }


def short_form() -> dict[str, Column]:
    return named("ez", {
        "program_service_revenue": "program_service_revenue_amt", "investment_income": "investment_income_amt", "other_revenue": "other_revenue_total_amt", "total_revenue": "total_revenue_amt",
        "grants_paid": "grants_and_similar_amounts_paid_amt", "salaries_comp_emp_benefits": "salaries_other_comp_empl_bnft_amt", "other_expenses": "other_expenses_total_amt", "total_expenses": "total_expenses_amt",
        "revenue_less_expenses": "excess_or_deficit_for_year_amt", "total_assets_boy": "boyamt", "total_assets_eoy": "eoyamt", "total_liabilities_boy": "boyamt", "total_liabilities_eoy": "eoyamt",
        "net_assets_boy": "net_assets_or_fund_balances_boyamt", "net_assets_eoy": "net_assets_or_fund_balances_eoyamt", "membership_dues": "membership_dues_amt",
    }) | {
        "tax_exempt_status": status("ez"), "organization_form": organization("ez", "type_of_organization_other_desc"), "mission_desc": F.col("ez.primary_exempt_purpose_txt"), "lobbying_expense": lobbying_expense(),
        "political_campaign_activity_ind": answer("ez.political_campaign_acty_ind"), "lobbying_activities_ind": answer("ez.lobbying_activities_ind"),
        "dues_assessments_ind": answer("sc.substantially_all_dues_nonded_ind"),
    }


def foundation_form() -> dict[str, Column]:
    def net(at: str) -> Column:
        return plus([f"pf.total_assets_{at}amt"]) - plus([f"pf.total_liabilities_{at}amt"])

    return named("pf", {
        "contributions_and_grants": "contri_paid_rev_and_expnss_amt", "investment_income": "net_investment_income_amt", "other_revenue": "other_income_rev_and_expnss_amt",
        "total_revenue": "total_rev_and_expnss_amt", "grants_paid": "total_grant_or_contri_pd_dur_yr_amt", "other_expenses": "other_expenses_rev_and_expnss_amt",
        "total_expenses": "total_expenses_rev_and_expnss_amt", "revenue_less_expenses": "excess_revenue_over_expenses_amt", "total_assets_boy": "total_assets_boyamt", "total_assets_eoy": "total_assets_eoyamt",
        "total_liabilities_boy": "total_liabilities_boyamt", "total_liabilities_eoy": "total_liabilities_eoyamt",
    }) | {
        "tax_exempt_status": foundation_status(), "organization_form": F.lit(""), "mission_desc": F.col("pf.mission_desc_txt"),
        "salaries_comp_emp_benefits": plus(["pf.oth_empl_slrs_wgs_rev_and_expnss_amt", "pf.pension_empl_bnft_rev_and_expnss_amt"]), "net_assets_boy": net("boy"), "net_assets_eoy": net("eoy"),
        "political_campaign_activity_ind": F.lit(""), "lobbying_activities_ind": answer("pf.legislative_political_acty_ind"), "dues_assessments_ind": F.lit(""),
    }


#: What a filing of taxes alone says nothing about; in all else it is read like the main form.
NOT_IN_T = ("net_assets_boy", "net_assets_eoy", "program_service_revenue", "membership_dues", "investment_income", "grants_paid", "lobbying_expense", "employees_count", "volunteers_count", "mission_desc")


def core_data(filings: DataFrame) -> DataFrame:
    """The 50 columns of each usable filing; one projection, since forms and schedules of a filing are structs of its row.

    The form is told by the start of the return type (990EZ, 990PF, 990T, otherwise 990); a value that a form
    doesn't have is null. Amounts that aren't numbers are null. filing_id is the file's name without its ending.
    """
    main, forms = main_form(), {"990EZ": ("ez", short_form()), "990PF": ("pf", foundation_form())}
    kind = F.col("header.return_type")

    def by_form(c: str) -> Column:
        typed = "string" if c in WORDS else "bigint" if c in COUNTS else "double"
        out = F
        for start, (form, values) in forms.items():
            shared = mark(f"{form}.{c}") if c in INDICATORS else F.col(f"{form}.{c}") if c == "website_address_txt" else F.lit(None)
            out = out.when(kind.startswith(start), values.get(c, shared).cast(typed))
        if c in NOT_IN_T:
            out = out.when(kind.startswith("990T"), F.lit(None).cast(typed))
        rest = mark(f"f990.{c}") if c in INDICATORS else F.col("f990.website_address_txt") if c == "website_address_txt" else main[c]
        return out.otherwise(rest.cast(typed))

    known = {c: F.col(f"header.{c}") for c in HEADER} | {"tax_year": number("header.tax_year").cast("bigint"), "filing_id": filing_id()}
    return filings.where("error IS NULL").select(*((known[c] if c in known else by_form(c)).alias(c) for c in COLUMNS))


def filing_id(path: str = "path") -> Column:
    """A file's name without its ending."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def canonical(filings: DataFrame, types: Sequence[str] = ("990", "990EZ", "990PF")) -> DataFrame:
    """The filing that counts of each filer and tax year, whole: latest stamp, then amended, then highest id."""
    amended = F.when(mark("header.amended").isin("X", "0"), mark("header.amended"))
    keyed = {"ein": F.col("header.ein"), "tax_year": number("header.tax_year").cast("bigint"), "return_type": F.col("header.return_type"), "return_ts": F.col("header.return_ts"), "amended": amended, "filing_id": filing_id()}
    return canonical_filings(filings.where("error IS NULL").withColumns(keyed), types).drop("return_type", "return_ts", "amended")


def named_people() -> Column:
    """Part VII as an array of people with a name: pay as numbers, marks."""

    def person(row: Column) -> Column:
        marks = [mark(row[c]).alias(c) for c in ("is_officer", "is_director", "is_key_employee", "is_former")]
        amounts = [number(row[c]).alias(c) for c in ("comp_from_org", "comp_from_related", "other_compensation")]
        hours = nonzero_or(number(row["avg_hours_week"]), number(row["avg_hours_week_related"])).alias("avg_hours_week")
        return F.struct(row["person_name"].alias("person_name"), row["title_txt"].alias("title_txt"), hours, *amounts, *marks)

    return F.transform(F.filter("part_vii", lambda r: r["person_name"].isNotNull()), person)


def people(filings: DataFrame) -> DataFrame:
    """Officers of Part VII: one row for each different one of a filing, without those that have no name.

    `highest` and `former_or_key` tell who is also in the tables of the highest paid and of former and key people.
    Repeats are removed inside the filing's array, so nothing is shuffled.
    """
    paid = F.filter("part_vii", lambda r: r["person_name"].isNotNull() & (mark(r["is_highest"]) == "X"))
    highest = F.transform(paid, lambda r: F.struct(r["person_name"], r["title_txt"], number(r["comp_from_org"]).alias("comp_from_org")))
    rows = filings.where("error IS NULL").select(filing_id().alias("filing_id"), highest.alias("highest"), F.explode(F.array_distinct(named_people())).alias("row"))
    paid_most = F.array_contains("highest", F.struct("row.person_name", "row.title_txt", "row.comp_from_org"))
    special = F.coalesce((F.col("row.is_former") == "X") | (F.col("row.is_key_employee") == "X"), F.lit(False))
    return rows.select("filing_id", "row.*", paid_most.alias("highest"), special.alias("former_or_key"))
