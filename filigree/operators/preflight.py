"""What a load would make of each filing, from filings parsed by `layouts.FILING`: status, counts of rows and caveats."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.operators.core_data import filing_id, main_form, mark, named_people, nonzero_or, number, short_form
from filigree.sources.layouts import CHILDREN, CONTRIBUTIONS_PAID, GRANT_AMOUNTS, GRANTS, SIGNALS, TO_INDIVIDUALS, TO_ORGANIZATIONS

# Forms that are read, and their versions that have been seen to work.
FORMS = {"990": "f990", "990EZ": "ez", "990PF": "pf"}
VERSIONS = ("2014v6.0", "2015v3.0", "2016v3.0", "2016v3.1", "2017v2.0", "2017v2.2", "2017v2.3")
#: Parts of a filing that are counted or looked at, and columns of the header.
PARTS = ("f990", "ez", "pf", "sc", "grants", "contractors", "part_vii", *(c for c in CHILDREN if c != "schedule_j"))
HEADER = ("return_type", "schema_version", "period_end", "ein", "tax_year", *SIGNALS)
ERRORS = ("parse_error", "missing_required_header", "unsupported_return_type", "no_recognized_main_form")


def core_values() -> tuple[list[Column], list[Column], list[Column]]:
    """Values of the main form, the short form and a foundation's that the summary of a filing has."""
    shared = ("total_revenue", "total_expenses", "net_assets_boy", "net_assets_eoy", "membership_dues", "investment_income", "grants_paid")
    main, short = main_form(), short_form()
    services = nonzero_or(number("f990.total_program_service_revenue_amt"), number("f990.cyprogram_service_revenue_amt"))
    others = ("contributions_and_grants", "government_grants", "lobbying_expense", "employees_count", "volunteers_count", "mission_desc")
    return (
        [services, *(main[c] for c in (*shared, *others))],
        [short[c] for c in (*shared, "program_service_revenue", "mission_desc")],
        [number(f"pf.{c}") for c in ("total_rev_and_expnss_amt", "total_expenses_rev_and_expnss_amt")],
    )


def present(values: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, (F.when(F.coalesce(v.cast("string"), F.lit("")) != "", 1).otherwise(0) for v in values))


def kept_grant(row: Column) -> Column:
    """Whether a grant's row says something: more than an amount of zero."""
    filled = [row[c].isNotNull() for c in GRANTS if c != "cash_grant_amt"]
    return reduce(lambda a, b: a | b, filled, row["cash_grant_amt"].isNotNull() & F.coalesce(number(row["cash_grant_amt"]) != 0, F.lit(True)))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in conditions))


def preflight(filings: DataFrame) -> DataFrame:
    """One row per file: identity, status (ok, parse_error, missing_required_header), forms found, rows of each kind, caveats.

    caveats: array of (code, severity) in the order of the checks. Files that can't be read have that caveat only and no
    counts. That a care-of name of the filer is lost can't occur, since the header reads it. A projection without shuffle; count codes with `caveat_counts`.
    """
    kind, version, ok = F.col("header.return_type"), F.nullif(F.col("header.schema_version"), F.lit("")), F.col("error").isNull()
    forms = F.filter(F.array(*(F.when(F.col(s).isNotNull(), F.lit(f)) for f, s in FORMS.items())), lambda f: f.isNotNull())
    supported = kind.isin(*FORMS)
    main, short, foundation = core_values()
    fields = F.when(kind.startswith("990PF"), present(foundation)).when(kind.startswith("990EZ"), present(short)).when(kind.startswith("990"), present(main)).otherwise(0)

    def size(*groups: str) -> Column:
        return reduce(lambda a, b: a + b, (F.size(g) for g in groups))

    counts = {
        "core_present_fields": fields, "grant_rows": F.size(F.filter("grants", kept_grant)), "contractor_rows": size("contractors"), "officer_rows": F.size(F.array_distinct(named_people())),
        "ez_officer_rows": size("ez_officers"), "pf_officer_rows": size("pf_officers"), "schedule_l_rows": size("l_business", "l_excess_benefit", "l_grants", "l_loans"),
        "schedule_r_rows": size("r_tax_exempt", "r_corporations", "r_partnerships", "r_disregarded", "r_transactions", "r_unrelated"),
    }
    unreadable = F.when(F.col("error").startswith("not XML"), "parse_error").otherwise("missing_required_header")
    passed = ("return_type", "schema_version", "period_end", "ein")
    counted = filings.select(
        filing_id().alias("filing_id"), F.col("path").alias("source_file"), F.when(ok, "ok").otherwise(unreadable).alias("status"), *(F.col(f"header.{c}") for c in passed),
        number("header.tax_year").cast("bigint").alias("tax_year"), F.when(ok, forms).alias("recognized_forms"), *(F.when(ok, v).alias(c) for c, v in counts.items()),
        any_of([mark(f"header.{t}") == "X" for t in TO_ORGANIZATIONS]).alias("to_organizations"), any_of([mark(f"header.{t}") == "X" for t in TO_INDIVIDUALS]).alias("to_individuals"),
        any_of([number(f"header.{t}") > 0 for t in GRANT_AMOUNTS]).alias("paid"), any_of([number(f"header.{t}") > 0 for t in CONTRIBUTIONS_PAID]).alias("contributed"),
        supported.alias("supported"), version.alias("version"),
    )
    alone = F.col("to_individuals") & ~F.col("to_organizations")
    none = F.col("grant_rows") == 0
    checks = {
        "schema_version_missing": F.col("version").isNull(),
        "unsupported_return_type": ~F.col("supported"),
        "no_recognized_main_form": F.size("recognized_forms") == 0,
        "return_type_form_mismatch": (F.size("recognized_forms") > 0) & F.col("supported") & ~F.array_contains("recognized_forms", F.col("return_type")),
        "unknown_form_version_combo": F.col("version").isNotNull() & F.col("supported") & ~F.col("version").isin(*VERSIONS),
        "all_core_hot_fields_blank": F.col("core_present_fields") == 0,
        "grant_signal_without_detail_rows": none & (F.col("to_organizations") | (F.col("paid") & ~F.col("to_individuals"))),
        "pf_contributions_paid_without_detail_rows": none & (F.col("return_type") == "990PF") & F.col("contributed") & ~alone,
    }
    found = [F.when(condition, caveat(code)) for code, condition in checks.items()]
    caveats = F.when(F.col("status") == "ok", F.filter(F.array(*found), lambda c: c.isNotNull())).otherwise(F.array(caveat(F.col("status"))))
    return counted.select(*(c for c in counted.columns if c not in ("to_organizations", "to_individuals", "paid", "contributed", "supported", "version")), caveats.alias("caveats"))


def caveat(code: str | Column) -> Column:
    code = F.lit(code) if isinstance(code, str) else code
    return F.struct(code.alias("code"), F.when(code.isin(*ERRORS), "error").otherwise("warning").alias("severity"))


def caveat_counts(checked: DataFrame) -> DataFrame:
    """Files of each return type and version with each caveat, beside all files of that type and version (code null)."""
    one = checked.select("return_type", "schema_version", F.explode(F.concat(F.array(F.lit(None).cast("struct<code:string,severity:string>")), "caveats")).alias("c"))
    return one.groupBy("return_type", "schema_version", "c.code", "c.severity").agg(F.count("*").alias("files"))
