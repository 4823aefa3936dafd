"""Unions with padding, keep-first, duplicate audits, multiset differences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_padded(*branches: tuple[str, DataFrame]) -> DataFrame:
    """All branches with a column naming theirs; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("branch", F.lit(name)) for name, df in branches))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def search_in_order(sources: Sequence[tuple[int, DataFrame]], order: Sequence[str], budget: int) -> DataFrame:
    """Hits of several sources, first source first, until the budget of rows is used up."""
    found = reduce(lambda a, b: a.unionByName(b), (df.withColumn("source_no", F.lit(n)) for n, df in sources))
    return found.orderBy("source_no", *order).limit(budget)


def duplicate_audit(df: DataFrame, keys: Sequence[str], row_hash: Column) -> DataFrame:
    """For each key that repeats: rows, distinct contents, and whether one row stays or all go."""
    counted = df.withColumn("__h", row_hash).groupBy(*keys).agg(F.count("*").alias("n_rows"), F.countDistinct("__h").alias("n_contents"))
    verdict = F.when(F.col("n_contents") == 1, "identical_keep_one").otherwise("conflict_remove_all")
    return counted.where("n_rows > 1").withColumn("action", verdict)


def without_duplicates(df: DataFrame, keys: Sequence[str], row_hash: Column) -> DataFrame:
    """One row of each key whose rows are all the same, and rows that don't repeat; conflicting keys go."""
    hashed = df.withColumn("__h", row_hash)
    fine = hashed.groupBy(*keys).agg(F.min("__h").alias("__a"), F.max("__h").alias("__b")).where(F.col("__a") == F.col("__b")).select(*keys)
    return hashed.join(fine, list(keys), "left_semi").drop("__h").dropDuplicates(list(keys))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows with their surplus in a (positive) or in b (negative), by one aggregation of both."""
    columns = a.columns
    both = a.withColumn("__n", F.lit(1)).unionByName(b.select(*columns).withColumn("__n", F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("__n").alias("surplus")).where("surplus != 0")


def multiset_digest(df: DataFrame) -> DataFrame:
    """Row count and two order-independent sums of halves of each row's SHA-256, fields told apart by their lengths.

    A half is 120 bits, summed in two limbs of 60, which decimals hold without overflow. No row gives null sums.
    """
    fields = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("n:")) for c in df.columns]
    h = F.sha2(F.concat(*fields), 256)

    def limb(i: int) -> Column:
        return F.sum(F.conv(F.substring("h", 15 * i + 1, 15), 16, 10).cast("decimal(38,0)"))

    limbs = [limb(i).alias(f"l{i}") for i in range(4)]
    sums = df.select(h.alias("h")).agg(F.count("*").alias("n_rows"), *limbs)
    return sums.select("n_rows", F.concat_ws("-", F.col("l0").cast("string"), F.col("l1").cast("string")).alias("sum_1"), F.concat_ws("-", F.col("l2").cast("string"), F.col("l3").cast("string")).alias("sum_2"))


def replay_factor(source: DataFrame, copy: DataFrame, keys: Sequence[str]) -> DataFrame:
    """By key, how many times the copy holds the source's whole set; null where it isn't a whole number of times."""
    columns = [c for c in source.columns if c not in keys]
    rows = [*keys, *columns]
    s, c = (df.groupBy(*rows).agg(F.count("*").alias(n)) for df, n in ((source, "n_source"), (copy, "n_copy")))
    both = s.join(c, rows, "full").withColumn("__f", F.try_divide(F.coalesce("n_copy", F.lit(0)), F.coalesce("n_source", F.lit(0))))
    out = both.groupBy(*keys).agg(F.min("__f").alias("low"), F.max("__f").alias("high"), F.count_if(F.col("__f").isNull()).alias("odd"))
    return out.select(*keys, F.when((F.col("low") == F.col("high")) & (F.col("odd") == 0) & (F.col("low") == F.floor("low")), F.col("low").cast("long")).alias("factor"))


def settled(df: DataFrame) -> DataFrame:
    """df as it is, its columns worked out once: without this barrier later uses of a column repeat its expression, which doubles with every step."""
    return df.select(F.explode(F.array(F.struct("*"))).alias("__r")).select("__r.*")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys before it is grouped by them: where few rows share a key, combining them where they are made only fills the memory of those tasks."""
    return df.repartition(*keys)


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage where the session names a folder for checkpoints, which all executors share; else df, worked out again by each use."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df
