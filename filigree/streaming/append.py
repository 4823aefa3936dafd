"""Appending new filings as files arrive: an extension, batch runs need none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def append_new(batch: DataFrame, target: str, key: str) -> None:
    """Append the rows of a batch whose key the target lacks; a batch that comes again adds nothing."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates([key])
    try:
        known = spark.read.schema(batch.schema).parquet(target).select(key)
    except Exception as e:  # the target is created by the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        fresh = fresh.join(known, key, "left_anti")
    fresh.write.mode("append").parquet(target)


def follow(spark: SparkSession, source: str, schema: StructType, target: str, key: str, checkpoint: str) -> StreamingQuery:
    """Read what is in `source` and what arrives until now, append it, stop."""
    stream = spark.readStream.schema(schema).parquet(source)
    write = stream.writeStream.foreachBatch(lambda df, _: append_new(df, target, key)).option("checkpointLocation", checkpoint)
    return write.trigger(availableNow=True).start()
