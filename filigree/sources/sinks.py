"""Writing: upserts, replacing a filing's children, atomic publishing, batched export."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigree.operators.sets import keep_first


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of each key in new its first row in order, and old rows of other keys: one row for each key."""
    return old.join(new, list(keys), "left_anti").unionByName(keep_first(new, keys, order))


def first_wins(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Old rows, and of each new key the first row in order."""
    return old.unionByName(keep_first(new.join(old, list(keys), "left_anti"), keys, order))


def replaced_children(children: DataFrame, new: DataFrame, filing: str) -> DataFrame:
    """All children of the filings in `new` are replaced by those given."""
    return children.join(new.select(filing).distinct(), filing, "left_anti").unionByName(new)


def publish(df: DataFrame, path: str, validate: Callable[[DataFrame], None]) -> None:
    """Write beside the target, validate what was written, and only then take the target's place."""
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    validate(spark.read.parquet(staged))
    _rename(spark, staged, path)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    jvm = spark._jvm
    a, b = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    old = jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}.old-{uuid.uuid4().hex}")
    had = fs.exists(b)
    if had and not fs.rename(b, old):
        raise OSError(f"couldn't move {target} aside")
    if not fs.rename(a, b):
        if had and not fs.rename(old, b):
            raise OSError(f"couldn't publish {target}; what it held is in {old}")
        raise OSError(f"couldn't publish {target}")
    if had:
        fs.delete(old, True)


def export_batches(df: DataFrame, path: str, order: Sequence[str], size: int) -> None:
    """JSON lines in folders of `size` rows each, in order. Rows are ranked within ranges, then offset."""
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    start = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    numbered = ranged.withColumn("__rank", rank).join(F.broadcast(start), "__part")  # one row per partition
    batch = F.floor((F.col("__start") + F.col("__rank")) / size).alias("batch")
    numbered.select(*df.columns, batch).write.mode("overwrite").partitionBy("batch").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
