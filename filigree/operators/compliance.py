"""Filing periods, timeliness and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: days after the period's end within which a report is on time.
DUE_DAYS = 90


def filing_periods(filings: DataFrame) -> DataFrame:
    """One row per filer and period end, with its original and latest report, days late and status.

    filings: f_num, period_end, rpt_id, amendment (0/1), receive_date, hardship (0/1).
    """
    period = Window.partitionBy("f_num", "period_end")
    original = F.row_number().over(period.orderBy("amendment", F.col("receive_date").asc_nulls_last(), "rpt_id"))
    latest = F.row_number().over(period.orderBy(F.desc("receive_date"), F.desc("amendment"), F.desc("rpt_id")))
    ranked = filings.withColumn("o", original).withColumn("l", latest)

    def of(rank: str, column: str, only: str = "true") -> Column:
        return F.max(F.when((F.col(rank) == 1) & F.expr(only), F.col(column)))

    first = "amendment = 0"
    pivoted = ranked.groupBy("f_num", "period_end").agg(
        of("o", "rpt_id", first).alias("original_rpt_id"), of("o", "receive_date", first).alias("original_received"),
        of("l", "rpt_id").alias("latest_rpt_id"), F.max("hardship").alias("hardship"), F.count("*").alias("n_reports"),
    )
    due = F.date_add("period_end", DUE_DAYS)
    late = F.datediff("original_received", due)
    status = (
        F.when(F.col("original_rpt_id").isNull() | F.col("period_end").isNull() | F.col("original_received").isNull(), "ORIGINAL_NOT_OBSERVED")
        .when((late > 0) & (F.col("hardship") == 1), "HARDSHIP_REVIEW")
        .when(late > 0, "FILED_LATE")
        .otherwise("FILED_ON_TIME")
    )
    return pivoted.withColumn("due_date", due).withColumn("days_late", F.greatest(F.lit(0), F.coalesce(late, F.lit(0)))).withColumn("status", status)


def expectations(periods: DataFrame, organizations: DataFrame, as_of: Column) -> DataFrame:
    """What a filer's history lets expect: terminated, too short, historical gaps, changed year end, or a missing current report.

    periods: f_num, period_end. organizations: f_num, terminated (0/1).
    """
    ends = periods.select("f_num", "period_end").where("period_end is not null").distinct()
    w = Window.partitionBy("f_num").orderBy("period_end")
    chained = ends.withColumn("next_end", F.lead("period_end").over(w))
    counted = ends.groupBy("f_num").agg(F.count("*").alias("n"), F.max("period_end").alias("last_end"))
    state = counted.join(organizations, "f_num")
    judged = state.where((F.col("terminated") == 0) & (F.col("n") >= 2)).select("f_num", "last_end")

    def same_day(a: str, b: str) -> Column:
        return F.date_format(a, "MM-dd") == F.date_format(b, "MM-dd")

    def anniversary(c: str, years: Column) -> Column:
        return F.add_months(F.col(c), (12 * years).cast("int"))

    gap_years = F.year("next_end") - F.year("period_end")
    gaps = chained.join(judged.select("f_num"), "f_num").where(same_day("period_end", "next_end") & (gap_years > 1))
    missing = gaps.select("f_num", F.explode(F.transform(F.sequence(F.lit(1), gap_years - 1), lambda i: anniversary("period_end", i))).alias("expected_end"))
    historical = missing.where(F.date_add("expected_end", DUE_DAYS) <= as_of).select("f_num", "expected_end", F.lit("HISTORICAL_GAP").alias("result"))
    before = chained.where("next_end is not null").join(judged, "f_num").where(F.col("next_end") == F.col("last_end"))
    regular = same_day("period_end", "next_end") & (gap_years == 1)
    changed = before.where(~regular).select("f_num", F.lit(None).cast("date").alias("expected_end"), F.lit("FYE_CHANGED_REVIEW").alias("result"))
    following = anniversary("last_end", F.lit(1))
    current = before.where(regular & (F.date_add(following, DUE_DAYS) <= as_of)).select("f_num", following.alias("expected_end"), F.lit("CURRENT_EXPECTATION").alias("result"))
    ended = state.where("terminated = 1").select("f_num", F.lit(None).cast("date").alias("expected_end"), F.lit("TERMINATED").alias("result"))
    short = state.where("terminated = 0 and n < 2").select("f_num", F.lit(None).cast("date").alias("expected_end"), F.lit("INSUFFICIENT_HISTORY").alias("result"))
    return historical.unionByName(changed).unionByName(current).unionByName(ended).unionByName(short)
