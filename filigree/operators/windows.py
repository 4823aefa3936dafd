"""Ranking operators. Every order ends in a unique key, so results don't depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def latest_per_key(df: DataFrame, keys: Keys, order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return top_k_per_group(df, keys, order, 1)


def top_k_per_group(df: DataFrame, keys: Keys, order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each key; with `rank`, their number. Spark limits groups before the shuffle."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def canonical_filings(returns: DataFrame, types: Sequence[str]) -> DataFrame:
    """One filing per filer and tax year: latest stamp, then amended, then highest id."""
    order = [F.col("return_ts").isNotNull().desc(), F.desc("return_ts"), F.coalesce("amended", F.lit("0")).desc(), F.desc("filing_id")]
    return latest_per_key(returns.where(F.col("return_type").isin(*types)), ["ein", "tax_year"], order)


def rank_gap(df: DataFrame, keys: Keys, score: str, ties: Sequence[Column]) -> DataFrame:
    """Adds rank, next_score, score_gap (the whole score when alone) and candidate_count."""
    w = Window.partitionBy(*keys)
    order = w.orderBy(F.desc(score), *ties)
    return (
        df.withColumn("rank", F.row_number().over(order))
        .withColumn("next_score", F.lead(score).over(order))
        .withColumn("candidate_count", F.count("*").over(w))
        .withColumn("score_gap", F.col(score) - F.coalesce("next_score", F.lit(0.0)))
    )


def share_of_total(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds each row's percentage of the column's sum. For aggregated rows: the window has one partition."""
    return df.withColumn(out, 100.0 * F.col(value) / F.sum(value).over(Window.partitionBy()))


def year_over_year(df: DataFrame, key: str, year: str, value: str, *, factor: float = 2.0) -> DataFrame:
    """Adds the earlier year's value and whether it changed by `factor` or more, both being at least 1."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(year))
    change = F.try_divide(F.col(value), F.col("previous"))
    both = (F.col(value) >= 1) & (F.col("previous") >= 1)
    return df.withColumn("previous", before).withColumn("large_change", F.coalesce(both & ((change >= factor) | (change <= 1 / factor)), F.lit(False)))


def missing_years(df: DataFrame, key: str, year: str) -> DataFrame:
    """(key, year) of the years between two consecutive ones of a key that it lacks."""
    following = F.lead(year).over(Window.partitionBy(key).orderBy(year))
    gaps = df.select(key, year).distinct().withColumn("next", following).where(F.col("next") > F.col(year) + 1)
    return gaps.select(key, F.explode(F.sequence(F.col(year) + 1, F.col("next") - 1)).alias(year))
