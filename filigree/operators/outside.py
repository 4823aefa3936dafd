"""Indicators from outside a filing: federal audits, exclusions, and names to be verified; and what the audit tables cover."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.functions.text import uei
from filigree.operators.risk import audit_threshold, indicator
from filigree.operators.windows import latest_per_key

# Flags of a report and of its findings, what each is called and how grave it is.
REPORT_FLAGS = (
    ("is_going_concern_included", "going-concern disclosure", "High"),
    ("is_internal_control_material_weakness_disclosed", "internal-control material weakness", "High"),
    ("is_material_noncompliance_disclosed", "material noncompliance", "High"),
    ("is_internal_control_deficiency_disclosed", "significant internal-control deficiency", "Medium"),
)
FINDING_FLAGS = (
    ("is_modified_opinion", "modified opinion", "High"),
    ("is_material_weakness", "finding with material weakness", "High"),
    ("is_questioned_costs", "questioned costs", "Medium"),
    ("is_significant_deficiency", "finding with significant deficiency", "Medium"),
    ("is_repeat_finding", "repeat finding", "Medium"),
)
LEADS = {
    "screening": "OFAC or HHS exclusion name candidates require identity verification",
    "lobbying": "Federal lobbying client match",
    "committee": "FEC committee name candidates require verification",
}


def report_issues(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """report_id, audit_year, severity and issues of the reports that have some.

    reports: report_id (unique), audit_year, fy_end_date (text) and REPORT_FLAGS; findings: report_id and FINDING_FLAGS, any number a report.
    Only true counts, null doesn't. Issues are listed gravest first, those of the report before those of its
    findings, each once in the order of the flags. The year of the period's end stands in for a missing audit year.
    """
    found = findings.groupBy("report_id").agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c, _, _ in FINDING_FLAGS))
    both = reports.join(found, "report_id", "left")
    graded = {level: [F.when(F.col(c), label) for c, label, g in (*REPORT_FLAGS, *FINDING_FLAGS) if g == level] for level in ("High", "Medium")}
    high, medium = (F.array_compact(F.array(*labels)) for labels in graded.values())
    year = F.coalesce(F.col("audit_year").cast("long"), F.substring("fy_end_date", 1, 4).try_cast("long"))
    out = both.select("report_id", year.alias("audit_year"), F.when(F.size(high) > 0, "High").otherwise("Medium").alias("severity"), F.concat(high, medium).alias("issues"))
    return out.where(F.size("issues") > 0)


def reports_of(reports: DataFrame, additional: DataFrame) -> DataFrame:
    """(ein, report_id, ein_match): the filers that a report names, as its primary number or as a further one; once each, primary first."""
    own = reports.select(F.col("auditee_ein").alias("ein"), "report_id", F.lit(0).alias("m"))
    more = additional.select(F.col("additional_ein").alias("ein"), "report_id", F.lit(1).alias("m")).join(reports.select("report_id"), "report_id", "left_semi").select("ein", "report_id", "m")
    each = own.unionByName(more).where("ein is not null").groupBy("ein", "report_id").agg(F.min("m").alias("m"))
    return each.select("ein", "report_id", F.when(F.col("m") == 0, "primary_ein").otherwise("additional_ein").alias("ein_match"))


def audit_issues(named: DataFrame, issues: DataFrame) -> DataFrame:
    """Issues of each report at each filer that it names: named (ein, report_id), issues as report_issues() has them."""
    met = named.join(issues, "report_id").withColumn("tax_year", F.col("audit_year"))
    return indicator(met, F.lit(True), F.col("severity"), "Federal Audit", "Federal Single Audit issues reported")


def missing_audits(years: DataFrame, named: DataFrame) -> DataFrame:
    """The latest year in which the government grants of a filer without any report reach the threshold of its period.

    years: ein, tax_year, period_start (text), government_grants. A start that is no date has no threshold.
    """
    start = F.when(F.trim("period_start").rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(F.trim("period_start"), 1, 10)))
    due = years.where(F.coalesce(F.col("government_grants").cast("double"), F.lit(0.0)) >= audit_threshold(start))
    latest = due.join(named.select("ein").distinct(), "ein", "left_anti").groupBy("ein").agg(F.max("tax_year").alias("tax_year"))
    return indicator(latest, F.lit(True), "Low", "External Coverage", "No FAC match despite large Form 990 government-grant revenue")


def excluded(reports: DataFrame, exclusions: DataFrame, latest_year: DataFrame) -> DataFrame:
    """Filers with an exclusion on a UEI of their own reports: ein, tax_year, severity, category, title and n_exclusions.

    reports: auditee_ein, auditee_uei; exclusions: uei, one row each; latest_year: ein, tax_year. Exclusions are counted by UEI
    before they meet reports, so neither side multiplies the other.
    """
    own = reports.select(F.col("auditee_ein").alias("ein"), uei(F.col("auditee_uei")).alias("uei")).where("ein is not null and uei is not null").distinct()
    counts = exclusions.select(uei(F.col("uei")).alias("uei")).where("uei is not null").groupBy("uei").agg(F.count("*").alias("n"))
    met = own.join(counts, "uei").groupBy("ein").agg(F.sum("n").alias("n_exclusions")).join(latest_year, "ein", "left")
    flat = indicator(met, F.lit(True), "High", "Federal Exclusions", "Active SAM exclusion record returned for a FAC-linked UEI")
    return flat.join(met.select("ein", "n_exclusions"), "ein")


def leads(kind: str, hits: DataFrame, latest_year: DataFrame) -> DataFrame:
    """A lead at the latest year of each filer (ein) with hits by name; it carries no points, because a name proves nothing. kind is one of LEADS."""
    found = hits.where("ein is not null").select("ein").distinct().join(latest_year, "ein", "left")
    return indicator(found, F.lit(True), "Low", "External Lead", LEADS[kind])


def latest_years(filings: DataFrame) -> DataFrame:
    """(ein, tax_year) of each filer's latest year."""
    return latest_per_key(filings.select("ein", "tax_year"), ["ein"], [F.col("tax_year").desc_nulls_last()])


def coverage(reports: DataFrame, details: dict[str, DataFrame], rejected: DataFrame) -> DataFrame:
    """What audit tables hold, a row for each: part, era, first_year, last_year, n and n_orphans.

    reports by era (current and historic, also where there are none), with the range of their years; details, which have a report_id, with
    the rows whose report is unknown or null; rejected rows. Details are counted by report before they meet
    reports, so a report with very many rows is one row then.
    """
    eras = reports.sparkSession.createDataFrame([("current",), ("historic",)], "era string")
    year = F.col("audit_year").cast("long")
    counted = reports.groupBy(F.col("source_era").alias("era")).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count("*").alias("n"))
    known = reports.select("report_id").where("report_id is not null").distinct().withColumn("known", F.lit(True))
    none = F.lit(None).cast("long")

    def part(name: str, df: DataFrame) -> DataFrame:
        by_report = df.groupBy("report_id").agg(F.count("*").alias("n")).join(known, "report_id", "left")
        return by_report.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("n_orphans")).select(
            F.lit(name).alias("part"), F.lit("").alias("era"), none.alias("first_year"), none.alias("last_year"), "n", "n_orphans"
        )

    own = eras.join(counted, "era", "left").select(F.lit("reports").alias("part"), "era", "first_year", "last_year", F.coalesce("n", F.lit(0)).alias("n"), none.alias("n_orphans"))
    left_out = rejected.agg(F.count("*").alias("n")).select(F.lit("rejected").alias("part"), F.lit("").alias("era"), none.alias("first_year"), none.alias("last_year"), "n", none.alias("n_orphans"))
    return reduce(DataFrame.unionByName, [own, *(part(n, df) for n, df in details.items()), left_out])


def all_outside(*families: DataFrame) -> DataFrame:
    """One table of indicators, in the columns that all families share."""
    columns: list[str | Column] = ["ein", "tax_year", "severity", "category", "title"]
    return reduce(DataFrame.unionByName, (f.select(*columns) for f in families))
