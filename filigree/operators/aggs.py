"""Aggregations: buckets, histograms, long-form statistics, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.operators.sets import dealt


def bucket(value: Column, bounds: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the first bound that the value is below; the last label if none is. Null stays null."""
    out = F.when(value.isNull(), None)
    for limit, label in zip(bounds, labels, strict=False):
        out = out.when(value < limit, label)
    return out.otherwise(labels[-1])


def long_stats(df: DataFrame, stats: dict[str, Column]) -> DataFrame:
    """(stat, value): one pass over df for all statistics, then one row for each."""
    wide = df.agg(*(c.cast("double").alias(n) for n, c in stats.items()))
    pairs = F.array(*(F.struct(F.lit(n).alias("stat"), F.col(n).alias("value")) for n in stats))
    return wide.select(F.explode(pairs).alias("p")).select("p.*")


def reconcile(detail: DataFrame, core: DataFrame, on: Sequence[str], *, floor: float = 10_000.0, share: float = 0.2, inflated: float = 1.25) -> DataFrame:
    """Detail sums against a total: material if they differ by max(floor, share of it) or more, inflated if far above."""
    both = core.join(detail.groupBy(*on).agg(F.sum("amount").alias("detail")), list(on), "left")
    gap = F.abs(F.coalesce("detail", F.lit(0.0)) - F.col("core"))
    return both.select(
        *on, "core", F.coalesce("detail", F.lit(0.0)).alias("detail"),
        (gap >= F.greatest(F.lit(floor), share * F.col("core"))).alias("material"),
        (F.coalesce("detail", F.lit(0.0)) > inflated * F.col("core")).alias("inflated"),
    )


def concentration(df: DataFrame, keys: Sequence[str], part: str, value: str, *, places: int | None = None) -> DataFrame:
    """Total of each key, largest part's sum and its share. Rows are dealt by key once, for parts as for totals; with places, sums of parts are rounded."""
    s = F.sum(value) if places is None else F.round(F.sum(value), places)
    parts = dealt(df.select(*keys, part, value), *keys).groupBy(*keys, part).agg(s.alias("s"))
    return parts.groupBy(*keys).agg(F.sum("s").alias("total"), F.max("s").alias("largest"), F.count("*").alias("n_parts")).withColumn(
        "largest_share", F.when(F.col("total") == 0, 0.0).otherwise(F.col("largest") / F.col("total"))
    )


def signature_rollup(df: DataFrame, key: str) -> DataFrame:
    """Count, sum, confidence range, first and last id, and the first row's sample by id."""
    return df.groupBy(key).agg(
        F.count("*").alias("grant_count"), F.sum("amount").alias("total_amount"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"),
        F.avg("confidence").alias("avg_confidence"), F.min("grant_id").alias("first_grant_id"), F.max("grant_id").alias("last_grant_id"), F.min_by("sample", "grant_id").alias("sample"),
    )


def histogram(df: DataFrame, key: str, value: str) -> DataFrame:
    """Counts by key and value in long form."""
    return df.groupBy(key, value).agg(F.count("*").alias("n"))


def joined_text(df: DataFrame, key: str, text: str, order: str, *, separator: str = " || ", most: int = 2000) -> DataFrame:
    """Texts of each key in order, joined and cut."""
    rows = F.array_sort(F.collect_list(F.struct(order, text)))
    return df.where(F.col(text).isNotNull()).groupBy(key).agg(F.substring(F.array_join(F.transform(rows, lambda r: r[text]), separator), 1, most).alias("joined"))


def first_longest(name: str, order: str) -> Column:
    """The longest name; among equals the one that comes first. Everything is a fixed-size aggregate."""
    return F.max_by(name, F.struct(F.length(name), -F.col(order)))


def any_at_least(columns: Sequence[str], threshold: float) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(F.col(c) >= threshold, F.lit(False)) for c in columns))
