"""Labor unions: organisations from filings, payees and their transactions, totals by counterparty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.functions.search import education_scope
from filigree.functions.text import clean_text
from filigree.operators.windows import latest_per_key

# What a payee row is, and the codes of money spent.
PAYEE_TYPE = 1002
CATEGORIES = {
    501: "REPRESENTATIONAL", 502: "POLITICAL", 503: "CONTRIBUTIONS, GIFTS AND GRANTS", 504: "GENERAL OVERHEAD", 505: "UNION ADMINISTRATION", 506: "GENERAL DISBURSEMENTS",
}
INCLUDE, EXCLUDE = ("include", "manual_include"), ("exclude", "manual_exclude")


def organizations(filings: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """One row per f_num from its latest filing, with first and last period, filing count, and education scope.

    overrides (f_num, action, note) set the scope by hand; other actions are ignored.
    """
    blank = F.lit("")
    order = [F.desc(F.coalesce("pd_covered_to", blank)), F.desc(F.coalesce("receive_date", blank)), F.desc("rpt_id")]
    latest = latest_per_key(filings, ["f_num"], order)
    sums = filings.groupBy("f_num").agg(
        F.min("pd_covered_to").alias("first_period_end"), F.max("pd_covered_to").alias("latest_period_end"), F.max("receive_date").alias("latest_report_received"), F.count("*").alias("filing_count")
    )
    ended = F.upper(F.coalesce("terminate", blank)).isin("T", "Y", "TRUE", "1") | F.col("term_date").isNotNull()
    unit = clean_text(F.col("unit_name"))
    out = latest.join(sums, "f_num").withColumn("__s", education_scope(F.col("aff_abbr"), F.col("union_name"), F.col("unit_name")))
    out = out.select(
        "f_num", F.when(unit != "", unit).otherwise(clean_text(F.col("union_name"))).alias("display_name"), F.col("aff_abbr").alias("affiliation"), "first_period_end", "latest_period_end",
        "latest_report_received", ended.cast("int").alias("terminated"), F.col("rpt_id").alias("latest_rpt_id"), "filing_count", F.col("__s.scope").alias("education_scope"), F.col("__s.reason").alias("education_scope_reason"),
    )
    if overrides is None:
        return out.withColumn("scope_manual_override", F.lit(0))
    action = F.lower(F.trim("action"))
    manual = overrides.withColumn("__to", F.when(action.isin(*INCLUDE), "manual_include").when(action.isin(*EXCLUDE), "manual_exclude")).where("__to is not null")
    note = clean_text(F.col("note"))
    manual = manual.select("f_num", "__to", F.when(note != "", note).otherwise(F.concat(F.lit("Manual "), action)).alias("__why"))
    both = out.join(manual, "f_num", "left")
    return both.withColumns({
        "education_scope": F.coalesce("__to", "education_scope"), "education_scope_reason": F.when(F.col("__to").isNotNull(), F.col("__why")).otherwise(F.col("education_scope_reason")),
        "scope_manual_override": F.col("__to").isNotNull().cast("int"),
    }).drop("__to", "__why")


def category(code: Column, described: Column) -> Column:
    """A disbursement's category: the code list's description, else the known one of its code."""
    known = F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv))
    return F.coalesce(described, F.try_element_at(known, code.cast("int")))


def payment_payees(payees: DataFrame, periods: DataFrame, filings: DataFrame, orgs: DataFrame, assigned: DataFrame, counterparties: DataFrame, codes: DataFrame) -> DataFrame:
    """Payee rows of the latest report of each period, with union, period, category and counterparty.

    Inner joins to period, filing and organisation; assignment, counterparty and code list may lack.
    """
    rows = payees.where(F.col("payer_payee_type") == PAYEE_TYPE)
    known = codes.where("code_type = 'DISBURSEMENT_CODE'").select(F.col("code").alias("rcpt_disb_type"), F.coalesce("code_description", "code_name").alias("__d"))
    out = rows.join(periods.select(F.col("latest_rpt_id").alias("rpt_id"), "period_start", "period_end"), "rpt_id").join(filings.select("rpt_id", "f_num"), "rpt_id")
    out = out.join(orgs.select("f_num", F.col("display_name").alias("union_name")), "f_num").join(assigned.select(F.col("payer_payee_row_id").alias("row_id"), "counterparty_id"), "row_id", "left")
    out = out.join(counterparties.select("counterparty_id", "matched_ein"), "counterparty_id", "left").join(known, "rcpt_disb_type", "left")
    return out.select(
        F.col("row_id").alias("payer_payee_row_id"), "f_num", "union_name", "period_start", "period_end", "rpt_id", "payer_payee_id", F.col("rcpt_disb_type").alias("disbursement_code"),
        category(F.col("rcpt_disb_type"), F.col("__d")).alias("disbursement_category"), "counterparty_id", "matched_ein", F.col("name").alias("payee_name"), F.col("total").alias("total_amount"),
    )


def payment_transactions(payees: DataFrame, disbursements: DataFrame) -> DataFrame:
    """A payee's single disbursements. A payee's total repeats on each, so totals aren't summed here."""
    d = disbursements.select("rpt_id", "payer_payee_id", F.col("oid").alias("transaction_oid"), F.col("amount").alias("transaction_amount"))
    return payees.join(d, ["rpt_id", "payer_payee_id"])


def totals_by_counterparty(payees: DataFrame) -> DataFrame:
    """Per counterparty: total, unions, first and last period, and sums by kind of disbursement."""

    def of(*codes: int) -> Column:
        return F.sum(F.when(F.col("disbursement_code").isin(*codes), F.coalesce("total_amount", F.lit(0.0))).otherwise(0.0))

    return payees.where("counterparty_id is not null").groupBy("counterparty_id").agg(
        F.coalesce(F.sum("total_amount"), F.lit(0.0)).alias("total_amount"), F.countDistinct("f_num").alias("n_unions"), F.min("period_end").alias("first_period"), F.max("period_end").alias("last_period"),
        of(503).alias("grants"), of(502).alias("political"), of(501).alias("representational"), of(504, 505, 506).alias("other"),
    )


def counterparty_search(counterparties: DataFrame, payees: DataFrame, wanted: Column, name: str, *, most: int = 100) -> DataFrame:
    """Counterparties that are wanted, with their sums: an equal name first, then by amount, then by name."""
    sums = payees.groupBy("counterparty_id").agg(F.sum("total_amount").alias("__t"), F.countDistinct("f_num").alias("n_unions"), F.min("period_end").alias("first_period"), F.max("period_end").alias("last_period"))
    out = counterparties.where(wanted).join(sums, "counterparty_id", "left")
    order = [F.when(F.upper("canonical_name") == name.upper(), 0).otherwise(1), F.desc_nulls_last("__t"), F.col("canonical_name"), F.col("counterparty_id")]
    return out.orderBy(*order).limit(most).select("counterparty_id", "canonical_name", F.coalesce("__t", F.lit(0.0)).alias("total_amount"), F.coalesce("n_unions", F.lit(0)).alias("n_unions"), "first_period", "last_period")


def status_order(status: str) -> Column:
    """Missing filings first, then late ones."""
    return F.when(F.col(status) == "POTENTIAL_MISSING_FILING", 0).when(F.col(status) == "FILED_LATE", 1).otherwise(2)
