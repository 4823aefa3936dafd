"""Where a person is named in filings parsed by `layouts.FILING`: 17 sources in order, under one budget of rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.operators.core_data import filing_id, mark, named_people, number
from filigree.sources import layouts

Read = Callable[[Column], Column]

#: Parts of a filing in which people are looked for, and columns of the header.
PARTS = ("f990", "ez", "part_vii", "contractors", "grants", "ez_officers", "schedule_j", "pf_officers", "l_business", "l_excess_benefit", "l_grants", "l_loans")
HEADER = ("ein", "org_name", "tax_year", "state", "city", "zip", "us_address_line1", "in_care_of_name", *layouts.SIGNERS, *layouts.BOOKS)


def words(c: Column) -> Column:
    """An amount as a text with a decimal point, anything else as it is."""
    whole = F.concat(c.cast("bigint").cast("string"), F.lit(".0"))
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), whole).otherwise(c.cast("string"))


def details(name: Column, parts: Sequence[tuple[str, Column]]) -> Column:
    said = [F.concat(F.lit(f"{label}="), F.coalesce(v, F.lit(""))) for label, v in parts]
    return F.concat_ws(" | ", F.concat(F.lit("name="), name), *said)


def filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def columns(*pairs: tuple[str, str]) -> Callable[[Column], list[tuple[str, Column]]]:
    return lambda r: [(label, r[c]) for label, c in pairs]


def pay(r: Column) -> list[tuple[str, Column]]:
    return [("comp_org", words(r["comp_from_org"])), ("comp_rel", words(r["comp_from_related"])), ("other", words(r["other_compensation"]))]


def officer(r: Column) -> list[tuple[str, Column]]:
    return [("title", r["title_txt"]), ("hrs/wk", words(r["avg_hours_week"])), *pay(r)]


def former(r: Column) -> list[tuple[str, Column]]:
    return [("title", r["title_txt"]), *pay(r)]


def contractor(r: Column) -> list[tuple[str, Column]]:
    state = filled(r["state_abbreviation_cd"])
    country = F.coalesce(filled(r["country_cd"]), F.when(state.isNotNull() | filled(r["address_line1_txt"]).isNotNull(), "US"))
    return [("services", r["services_desc"]), ("comp", words(number(r["compensation_amt"]))), ("city", filled(r["city_nm"])), ("region", F.coalesce(state, filled(r["province_or_state_nm"]))), ("country", country)]


def contractor_name(r: Column) -> Column:
    return F.coalesce(filled(r["business_name_line1_txt"]), filled(r["person_nm"]))


def grant(r: Column) -> list[tuple[str, Column]]:
    state = r["us_state_abbreviation_cd"]
    return [
        ("recp_ein", r["recipient_ein"]), ("cash", words(number(r["cash_grant_amt"]))), ("noncash", words(number(r["non_cash_assistance_amt"]))), ("purpose", r["purpose_of_grant_txt"]),
        ("city", F.coalesce(r["us_city_nm"], r["foreign_city_nm"])), ("state", F.coalesce(state, r["foreign_province_or_state_nm"])),
        ("country", F.when(F.coalesce(state, F.lit("")) != "", "US").otherwise(r["foreign_country_cd"])),
    ]


def grant_name(r: Column) -> Column:
    second = F.coalesce(r["business_name_line2_txt"], F.lit(""))
    return F.trim(F.concat(F.coalesce(r["business_name_line1_txt"], F.lit("")), F.when(second != "", F.concat(F.lit(" "), second)).otherwise("")))


def highest_paid() -> Column:
    """Rows of the highest paid: the same as officers', without their marks."""
    paid = F.filter("part_vii", lambda r: r["person_name"].isNotNull() & (mark(r["is_highest"]) == "X"))
    amounts = ("comp_from_org", "comp_from_related", "other_compensation")
    hours = lambda r: F.when(number(r["avg_hours_week"]) != 0, number(r["avg_hours_week"])).otherwise(number(r["avg_hours_week_related"]))
    return F.transform(paid, lambda r: F.struct(r["person_name"].alias("person_name"), r["title_txt"].alias("title_txt"), hours(r).alias("avg_hours_week"), *(number(r[c]).alias(c) for c in amounts)))


def former_or_key() -> Column:
    rows = F.filter(named_people(), lambda r: F.coalesce((r["is_former"] == "X") | (r["is_key_employee"] == "X"), F.lit(False)))
    return F.transform(rows, lambda r: F.struct(*(r[c].alias(c) for c in ("person_name", "title_txt", "comp_from_org", "comp_from_related", "other_compensation"))))


def one(*fields: tuple[str, Column]) -> Column:
    return F.array(F.struct(*(v.alias(c) for c, v in fields)))


def books(form: str) -> Column:
    """Who keeps the books: of the form, or of the whole filing where it isn't on that form."""
    return one(*((c, F.when(F.col(form).isNotNull(), F.col(f"{form}.books_{c}")).otherwise(F.col(f"header.books_{c}"))) for c in ("person", "address", "city", "state", "zip", "phone")))


BOOKS = columns(("addr1", "address"), ("city", "city"), ("state", "state"), ("zip", "zip"), ("phone", "phone"))
TITLE = ("title", "title_txt")
HOURS = ("hrs/wk", "average_hrs_per_wk_devoted_to_pos_rt")


def sources() -> list[tuple[str, Column, Read, Callable[[Column], list[tuple[str, Column]]]]]:
    """Label, array of rows, name and details of every source, in the order in which they use up the budget. Labels are fixed values."""

    def of(column: str) -> Read:
        return lambda r: r[column]

    def head(*names: str) -> Column:
        return one(*((c, F.col(f"header.{c}")) for c in names))

    person = of("person_nm")
    return [
        ("Officer/Director/Trustee", F.array_distinct(named_people()), of("person_name"), officer),
        ("Highly Compensated Employee", F.array_distinct(highest_paid()), of("person_name"), officer),
        ("Former/Key Employee", F.array_distinct(former_or_key()), of("person_name"), former),
        ("Contractor", F.col("contractors"), contractor_name, contractor),
        ("Grant Recipient", F.col("grants"), grant_name, grant),
        ("Return Header (Signer/Officer)", head("signer", "signer_title", "signed"), of("signer"), columns(("title", "signer_title"), ("signed", "signed"))),
        ("Return Header (Preparer)", head("preparer", "preparer_firm", "ptin", "prepared"), of("preparer"), columns(("firm", "preparer_firm"), ("ptin", "ptin"), ("prep_dt", "prepared"))),
        ("Books In Care Of", books("f990"), of("person"), BOOKS),
        ("Books In Care Of (EZ)", books("ez"), of("person"), BOOKS),
        ("EZ Officer/Director/Trustee/Employee", F.col("ez_officers"), person, columns(TITLE, HOURS, ("comp", "compensation_amt"), ("benefits", "employee_benefit_program_amt"), ("other", "expense_account_other_allwnc_amt"))),
        ("Schedule J (Officer/Trustee/Key)", F.col("schedule_j"), person, columns(TITLE, ("base", "base_compensation_filing_org_amt"), ("bonus", "bonus_filing_organization_amount"), ("total_org", "total_compensation_filing_org_amt"), ("total_rel", "total_compensation_rltd_orgs_amt"))),
        ("990-PF Officer/Director/Trustee/Key", F.col("pf_officers"), person, columns(TITLE, HOURS, ("comp", "compensation_amt"), ("benefits", "employee_benefits_amt"), ("expense", "expense_account_amt"))),
        ("Schedule L (Business Transactions)", F.col("l_business"), person, columns(("relationship", "relationship_description_txt"), ("amount", "transaction_amt"), ("desc", "transaction_desc"))),
        ("Schedule L (Excess Benefit Transaction)", F.col("l_excess_benefit"), person, columns(("relationship", "rln_disqualified_person_org_txt"), ("corrected", "transaction_corrected_ind"), ("desc", "transaction_desc"))),
        ("Schedule L (Grant/Assist to Interested Person)", F.col("l_grants"), person, columns(("relationship", "relationship_with_org_txt"), ("cash", "cash_grant_amt"), ("assist_type", "type_of_assistance_txt"), ("purpose", "assistance_purpose_txt"))),
        ("Schedule L (Loans Between Org & Interested Person)", F.col("l_loans"), person, columns(("relationship", "relationship_with_org_txt"), ("orig_principal", "original_principal_amt"), ("balance_due", "balance_due_amt"), ("purpose", "loan_purpose_txt"))),
    ]


def in_care_of() -> Column:
    """The path beside the curated sources: parts of the address only where they say something."""
    parts = [F.when(filled(F.col(f"header.{c}")).isNotNull(), F.concat(F.lit(f"{label}="), F.col(f"header.{c}"))) for label, c in (("addr1", "us_address_line1"), ("city", "city"), ("state", "state"), ("zip", "zip"))]
    return F.concat_ws(" | ", F.concat(F.lit("name="), F.col("header.in_care_of_name")), *parts)


def people_search(filings: DataFrame, person: str, fuzzy: bool = True, state: str | None = None, years: tuple[int | None, int | None] = (None, None), max_rows: int | None = 5000) -> DataFrame:
    """filing_id, ein, org_name, tax_year, found_in, detail: by ein, latest year first, source, detail; each row once, at most max_rows.

    Names match whole, or anywhere with `fuzzy`, whatever the case; % and _ are wildcards. A blank person finds nothing. With one year given that year
    alone counts. The sources take the budget in their order, within one by ein, latest year, id and detail. Sources of a filing become one array, so
    filings are read once; only the budget's rows are sorted. Without a budget (None) all hits are kept, by a distributed sort.
    """
    pattern = person.strip().upper().replace("\\", "\\\\")
    pattern = f"%{pattern}%" if fuzzy else pattern
    low, high = sorted(y for y in (years[0] or years[1], years[1] or years[0]) if y) or (None, None)
    year = number("header.tax_year").cast("bigint")

    def named(c: Column) -> Column:
        return F.upper(c).like(pattern) if fuzzy or "%" in pattern or "_" in pattern else F.upper(c) == pattern

    def hits(no: int, label: str, rows: Column, name: Read, parts: Callable[[Column], list[tuple[str, Column]]]) -> Column:
        return F.transform(F.filter(rows, lambda r: named(name(r))), lambda r: F.struct(F.lit(no).alias("no"), F.lit(label).alias("found_in"), details(name(r), parts(r)).alias("detail")))

    cared = F.struct(F.lit(0).alias("no"), F.lit("Returns (In Care Of Name)").alias("found_in"), in_care_of().alias("detail"))
    first = F.when(named(F.col("header.in_care_of_name")), F.array(cared)).otherwise(F.array().cast("array<struct<no:int,found_in:string,detail:string>>"))
    found = F.concat(first, *(hits(no, *s) for no, s in enumerate(sources(), 1)))
    asked = filings.where("error IS NULL").where(F.lit(bool(person.strip())))
    asked = asked.where(F.col("header.state") == state.strip().upper()) if state else asked
    asked = asked.where(year.between(low, high)) if low else asked
    rows = asked.select(filing_id().alias("filing_id"), "header.ein", "header.org_name", year.alias("tax_year"), F.explode(found).alias("hit")).select("filing_id", "ein", "org_name", "tax_year", "hit.*")
    budget = rows if max_rows is None else rows.orderBy("no", "ein", F.desc("tax_year"), "filing_id", "detail").limit(max_rows)
    return budget.drop("no").distinct().orderBy("ein", F.desc("tax_year"), "found_in", "detail", "filing_id")
