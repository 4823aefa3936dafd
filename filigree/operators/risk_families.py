"""Risk indicators by family, each from its own child tables, in the schema of `risk.indicator`.

filings: ein, tax_year, filing_id and expenses of the canonical filing of each year; families say what
else they read. A ratio to missing or zero expenses counts as zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.operators.risk import indicator

# What counts as a yes, foundation codes, and the limits and titles below.
YES = ("X", "1", "TRUE", "T", "YES", "Y")
PRIVATE_FOUNDATIONS = ("02", "03", "04")
MATERIAL_AMOUNT, MATERIAL_SHARE = 100_000, 0.05


def yes(c: str) -> Column:
    return F.upper(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))).isin(*YES)


def zero(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def share(part: Column, whole: str = "expenses") -> Column:
    return F.coalesce(F.try_divide(part, F.nullif(F.col(whole), F.lit(0.0))), F.lit(0.0))


def both(*families: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, families)


def material(amount: Column, *, least_share: float = MATERIAL_SHARE) -> Column:
    return (amount >= MATERIAL_AMOUNT) | ((F.col("expenses") > 0) & (share(amount) >= least_share))


def subsection(status: Column, fallback: Column) -> Column:
    """The number of a 501(c) subsection: of the filing's status text, else of today's master file; else null."""
    own = F.regexp_extract(F.coalesce(status, F.lit("")), r"(?i)501\s*\(\s*c\s*\)\s*\(\s*0*(\d+)\s*\)", 1)
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(F.ltrim(F.trim(fallback.cast("string")), F.lit("0")), F.lit("")))


def private_foundation(return_type: Column, code: Column) -> Column:
    """By the form: 990PF is one, 990 and 990EZ aren't; any other by the master file's foundation code."""
    form = F.regexp_replace(F.upper(F.coalesce(return_type, F.lit(""))), "[^A-Z0-9]", "")
    padded = F.lpad(F.trim(F.coalesce(code.cast("string"), F.lit(""))), 2, "0")
    return F.when(form.contains("990PF"), True).when(form.isin("990", "990EZ"), False).otherwise(padded.isin(*PRIVATE_FOUNDATIONS))


def period_days(start: Column, end: Column) -> Column:
    """Days of a filing period, both ends included; null if that isn't a period."""
    days = F.datediff(F.try_to_date(F.substring(end, 1, 10)), F.try_to_date(F.substring(start, 1, 10))) + 1
    return F.when(days > 0, days)


def compensation_totals(officers: DataFrame, filings: DataFrame) -> DataFrame:
    """Per ein and year: total_comp, max_comp, related_comp and rows_count over different people and amounts."""
    amounts = ["comp_from_org", "comp_from_related", "other_compensation"]
    people = officers.join(filings.select("filing_id", "ein", "tax_year"), "filing_id").select("ein", "tax_year", "person_name", "title_txt", *(zero(c).alias(c) for c in amounts)).distinct()
    total = F.col("comp_from_org") + F.col("comp_from_related") + F.col("other_compensation")
    return people.groupBy("ein", "tax_year").agg(
        F.sum(total).alias("total_comp"), F.max(total).alias("max_comp"), F.sum(F.greatest("comp_from_related", F.lit(0.0))).alias("related_comp"), F.count("*").alias("rows_count")
    )


def compensation(officers: DataFrame, filings: DataFrame) -> DataFrame:
    t = compensation_totals(officers, filings).join(filings.select("ein", "tax_year", "expenses"), ["ein", "tax_year"])
    return both(
        indicator(t, share(F.col("total_comp")) >= 0.25, "Medium", "Compensation", "Compensation concentration"),
        indicator(t, share(F.col("max_comp")) >= 0.20, "Medium", "Compensation", "Single person compensation concentration"),
        indicator(t, F.col("related_comp") > 0, "Low", "Compensation", "Compensation from related organizations"),
    )


def contractor_totals(payments: DataFrame, filings: DataFrame) -> DataFrame:
    """Per ein and year: total_contractors, largest_contractor and contractor_rows of payments (filing_id, compensation_amt)."""
    rows = payments.join(filings.select("filing_id", "ein", "tax_year"), "filing_id")
    return rows.groupBy("ein", "tax_year").agg(F.sum(zero("compensation_amt")).alias("total_contractors"), F.max(zero("compensation_amt")).alias("largest_contractor"), F.count("*").alias("contractor_rows"))


def contractors(payments: DataFrame, filings: DataFrame) -> DataFrame:
    t = contractor_totals(payments, filings).join(filings.select("ein", "tax_year", "expenses"), ["ein", "tax_year"])
    return both(
        indicator(t, share(F.col("total_contractors")) >= 0.30, "Medium", "Contractors", "Contractor payments are a large share of expenses"),
        indicator(t, (share(F.col("largest_contractor")) >= 0.20) & (F.col("contractor_rows") > 1), "Low", "Contractors", "Single contractor concentration"),
    )


def related_totals(related: DataFrame) -> DataFrame:
    """Per filing: entity, transaction and unrelated rows, controlled ones and the amount involved."""
    kind = F.col("relationship_category")
    transaction, unrelated = kind == "Transactions with Related Org", kind == "Unrelated Taxable Partnership"
    return related.groupBy("filing_id").agg(
        F.count_if(~transaction & ~unrelated).alias("entity_rows"), F.count_if(transaction).alias("transaction_rows"), F.count_if(unrelated).alias("unrelated_rows"),
        F.count_if(~unrelated & yes("controlled_organization_ind")).alias("controlled_count"), F.sum(F.when(transaction, zero("involved_amt")).otherwise(0.0)).alias("involved_amount"),
    )


def related_organizations(related: DataFrame, filings: DataFrame) -> DataFrame:
    t = related_totals(related).join(filings.select("filing_id", "ein", "tax_year", "expenses"), "filing_id")
    t = t.groupBy("ein", "tax_year").agg(F.sum("entity_rows").alias("entity_rows"), F.sum("involved_amount").alias("involved_amount"), F.max("expenses").alias("expenses"))
    return both(
        indicator(t, F.col("entity_rows") > 0, "Low", "Disclosure Context", "Schedule R related organizations reported"),
        indicator(t, share(F.col("involved_amount")) >= 0.20, "Medium", "Related Organizations", "Material related-organization transaction amount"),
    )


def trusted_identity(ein: str, confidence: str, status: str, source: str | None = None) -> Column:
    """Identities safe enough to drive network signals: a number, enough confidence, no conflict, not unverified."""
    safe = ~F.coalesce(F.col(status), F.lit("")).isin("unresolved", "conflicting_ein_match")
    if source is not None:
        origin = F.coalesce(F.col(source), F.lit(""))
        safe = (origin != "reported_ein_from_filing_unverified") & ((origin != "deterministic") | safe)
    return (F.trim(F.coalesce(F.col(ein).cast("string"), F.lit(""))) != "") & (zero(confidence) >= 0.85) & safe


def identity_counters(resolved: DataFrame) -> DataFrame:
    """Per grantor and year, of grants above zero: amounts and counts that say how well recipients are known.

    resolved: grantor_ein, tax_year, total_amount, reported_ein, resolved_ein, match_status, warning_flags, confidence.
    """
    known, reported = F.trim(F.coalesce("resolved_ein", F.lit(""))), F.coalesce("reported_ein", F.lit(""))
    conflict = F.coalesce(F.col("match_status") == "conflicting_ein_match", F.lit(False)) | F.coalesce(F.col("warning_flags"), F.lit("")).contains("conflict")
    return resolved.where(zero("total_amount") > 0).groupBy(F.col("grantor_ein").alias("ein"), "tax_year").agg(
        F.count("*").alias("row_count"), F.sum("total_amount").alias("total_amount"), F.sum(F.when(known == "", F.col("total_amount")).otherwise(0.0)).alias("unresolved_amount"),
        F.count_if(conflict).alias("conflict_rows"), F.count_if((reported != "") & (F.coalesce("resolved_ein", F.lit("")) != "") & (F.col("reported_ein") != F.col("resolved_ein"))).alias("corrected_ein_rows"),
        F.count_if(F.coalesce(F.col("confidence") < 0.70, F.lit(False))).alias("low_confidence_rows"),
    )


def grant_identity(resolved: DataFrame) -> DataFrame:
    t = identity_counters(resolved)
    return both(
        indicator(t, share(F.col("unresolved_amount"), "total_amount") >= 0.50, "Medium", "Data Quality", "Most grant dollars remain unresolved to a recipient EIN"),
        indicator(t, F.col("conflict_rows") > 0, "Medium", "Data Quality", "Grant recipient EIN conflicts"),
        indicator(t, (F.col("corrected_ein_rows") > 0) | (F.col("low_confidence_rows") > 0), "Low", "Data Quality", "Grant identity matching requires review"),
    )


def grant_detail(rows: DataFrame, filings: DataFrame) -> DataFrame:
    """rows: filing_id, recipient_ein, recipient_name, cash_amount, noncash_amount; filings also grants_paid."""
    each = rows.join(filings.select("filing_id", "ein", "tax_year"), "filing_id").withColumn("amount", zero("cash_amount") + zero("noncash_amount"))
    recipients = each.groupBy("ein", "tax_year", "recipient_ein", "recipient_name").agg(F.sum("amount").alias("one"), F.count("*").alias("n"))
    missing = F.trim(F.coalesce(F.col("recipient_ein").cast("string"), F.lit(""))) == ""
    t = recipients.groupBy("ein", "tax_year").agg(F.sum("n").alias("n"), F.sum("one").alias("total"), F.sum(F.when(missing, F.col("one")).otherwise(0.0)).alias("missing"), F.max("one").alias("largest"))
    bare = filings.where("grants_paid > 0").join(t.select("ein", "tax_year"), ["ein", "tax_year"], "left_anti")
    return both(
        indicator(t, share(F.col("missing"), "total") >= 0.50, "Medium", "Data Quality", "Most grant dollars lack recipient EINs"),
        indicator(t, (share(F.col("largest"), "total") >= 0.60) & (F.col("n") > 1), "Low", "Grants", "Grant concentration in one recipient"),
        indicator(bare, F.lit(True), "Low", "Data Quality", "Grants paid total has no grant-detail rows"),
    )


def schedule_c(rows: DataFrame, filings: DataFrame) -> DataFrame:
    """rows: one per filing with political and lobbying amounts; filings also subsection, null if unknown."""
    t = rows.join(filings.select("filing_id", "ein", "tax_year", "expenses", "subsection"), "filing_id")
    political = zero("political_expenditures_amt") + zero("expended527_activities_amt")
    granted, charity = zero("grants_other_organizations_amt"), F.coalesce(F.col("subsection") == "3", F.lit(False))
    spent = t.where((zero("political_expenditures_amt") != 0) | (zero("expended527_activities_amt") != 0))
    scored, context = "Lobbying / Political", "Disclosure Context"
    title, lobby = "Schedule C political or section 527 expenditures", "Grants used for lobbying activities"
    return both(
        indicator(spent, charity, "High", scored, title), indicator(spent, ~charity & material(political), "Medium", scored, title), indicator(spent, ~charity & ~material(political), "Low", context, title),
        indicator(t, (zero("lobbying_excess_amt") != 0) | (zero("lobbying_grassroots_excess_amt") != 0), "High", scored, "Schedule C lobbying-limit excess"),
        indicator(t, (granted > 0) & material(granted), "Medium", scored, lobby), indicator(t, (granted > 0) & ~material(granted), "Low", context, lobby),
        indicator(t, zero("non_deductible_lbbyng_pltcl_cy_amt") > 0, "Low", context, "Nondeductible lobbying or political amount"),
        indicator(t, yes("form1120_pol_filed_ind"), "Low", context, "Form 1120-POL filing reported"),
    )


def interested_totals(rows: DataFrame, amount: str) -> DataFrame:
    """Per filing: row_count, total_amount and max_amount of a Schedule L part."""
    return rows.groupBy("filing_id").agg(F.count("*").alias("row_count"), F.sum(zero(amount)).alias("total_amount"), F.max(zero(amount)).alias("max_amount"))


def schedule_l(excess: DataFrame, business: DataFrame, assistance: DataFrame, loans: DataFrame, filings: DataFrame) -> DataFrame:
    about = filings.select("filing_id", "ein", "tax_year", "expenses")
    corrected = excess.groupBy("filing_id").agg(F.count("*").alias("n"), F.count_if(yes("transaction_corrected_ind")).alias("done")).join(about, "filing_id")
    found = [indicator(corrected, F.lit(True), F.when(F.col("done") == F.col("n"), "Medium").otherwise("High"), "Interested Persons", "Schedule L excess-benefit transaction")]
    for rows, amount, title in (
        (business, "transaction_amt", "Business transactions with interested persons"),
        (assistance, "cash_grant_amt", "Grants or assistance to interested persons"),
        (loans, "balance_due_amt", "Loans involving interested persons"),
    ):
        t = interested_totals(rows, amount).join(about, "filing_id")
        found.append(indicator(t, F.lit(True), F.when(material(F.col("total_amount"), least_share=0.10), "Medium").otherwise("Low"), "Interested Persons", title))
    return both(*found)


def filing_status(filings: DataFrame) -> DataFrame:
    return both(
        indicator(filings, yes("final_return_ind"), "Medium", "Filing Status", "Final return indicated"),
        indicator(filings, yes("application_pending_ind"), "Medium", "IRS Status", "Exemption application pending"),
        indicator(filings, yes("amended_return_ind"), "Low", "Filing Status", "Amended return selected as canonical"),
    )


def master_file_status(filings: DataFrame, master: DataFrame) -> DataFrame:
    """An organisation whose master file status isn't 01, at its latest year. master: ein, status."""
    latest = filings.groupBy("ein").agg(F.max("tax_year").alias("tax_year")).join(master.select("ein", "status"), "ein")
    return indicator(latest, (F.col("status") != "") & (F.col("status") != "01"), "Medium", "IRS Status", "EO BMF status requires review")


def campaign_flags(filings: DataFrame) -> DataFrame:
    """filings also subsection, lobbying, lobbying_ind, political_campaign_activity_ind and dues_assessments_ind."""
    severity = F.when(F.col("subsection") == "3", "High").when(F.col("subsection").isNotNull(), "Low").otherwise("Medium")
    return both(
        indicator(filings, yes("lobbying_ind") & (share(zero("lobbying")) < 0.05), "Low", "Disclosure Context", "Lobbying activity flag"),
        indicator(filings, yes("political_campaign_activity_ind"), severity, "Lobbying / Political", "Political campaign activity flag"),
        indicator(filings, yes("dues_assessments_ind"), "Low", "Disclosure Context", "Membership dues or proxy-tax flag"),
    )


def trends(filings: DataFrame) -> DataFrame:
    """Large changes from one filed year to the next; none where a period is shorter than 300 days, which is reported.

    filings also period_start, period_end, revenue and grants_paid.
    """
    w = Window.partitionBy("ein").orderBy("tax_year")
    t = filings.withColumn("days", period_days(F.col("period_start"), F.col("period_end")))
    t = t.withColumns({"previous": F.lag("tax_year").over(w), "days_before": F.lag("days").over(w), **{f"{c}_before": F.lag(c).over(w) for c in ("revenue", "expenses", "grants_paid")}}).where("previous is not null")
    short = F.coalesce(F.col("days_before") < 300, F.lit(False)) | F.coalesce(F.col("days") < 300, F.lit(False))
    found = [indicator(t, short, "Low", "Data Quality", "Short tax period excluded from annual trend scoring")]
    for c, label in (("revenue", "revenue"), ("expenses", "expenses"), ("grants_paid", "grants paid")):
        factor = F.try_divide(F.col(c), F.col(f"{c}_before"))
        changed = (zero(c) >= 1) & (zero(f"{c}_before") >= 1) & ((factor >= 2) | (factor <= 0.5))
        found.append(indicator(t, ~short & changed, "Medium", "Trend", f"Large year-over-year {label} change"))
    return both(*found)


def governance(records: DataFrame, filings: DataFrame) -> DataFrame:
    """records: ein, tax_year and yes/no answers as booleans, null if not given; filings also assets and revenue."""
    t, g = records, "Governance"

    def no(*columns: str) -> Column:
        return reduce(lambda a, b: a | b, (F.coalesce(~F.col(c), F.lit(False)) for c in columns))

    def given(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(False))

    large = t.join(filings.select("ein", "tax_year", "assets", "revenue"), ["ein", "tax_year"]).where(F.greatest(zero("assets"), zero("revenue")) >= 5_000_000)
    board = t.where((F.col("voting_members") > 0) & F.col("independent_members").isNotNull())
    return both(
        indicator(t, given("material_diversion"), "High", g, "Material diversion or misuse reported"),
        indicator(t, given("federal_grant_audit_required") & no("federal_grant_audit_performed"), "High", "External Compliance", "Required federal grant audit reported as not performed"),
        indicator(board, F.col("independent_members") == 0, "Medium", g, "No independent voting members reported"),
        indicator(board, (F.col("independent_members") > 0) & (F.col("independent_members") * 2 < F.col("voting_members")), "Medium", g, "Independent members are a minority"),
        indicator(t, given("family_business_relationships"), "Medium", g, "Family or business relationships among leaders"),
        indicator(t, no("minutes_governing_body", "minutes_committees"), "Medium", g, "Contemporaneous minutes not maintained"),
        indicator(t, no("conflict_policy", "whistleblower_policy", "document_retention_policy"), "Low", g, "Governance policies reported absent"),
        indicator(t, no("form990_provided_to_board"), "Low", g, "Form 990 not provided to governing body"),
        indicator(large, no("financial_statements_audited"), "Low", g, "Large organization reports no audited financial statements"),
    )
