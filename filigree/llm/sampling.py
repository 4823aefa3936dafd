"""A bounded sample of labelled documents, for the operators that learn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.llm.common import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, per_class: int, max_chars: int) -> DataFrame:
    """At most `per_class` documents of either label, as (doc_id, y, text).

    Taken are the labelled ids that aren't held out, in the order of a hash, so that the
    sample is the same at each run; texts longer than max_chars aren't learnt from. If an id
    has several labels, 1 wins; if it has several rows of documents, one of them is used.
    """
    ids = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    taken = ids.where("y = 0").orderBy(*by_hash).limit(per_class).unionByName(ids.where("y = 1").orderBy(*by_hash).limit(per_class))
    # taken has 2 * per_class rows at most, however large the tables are
    texts = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= max_chars)
    return texts.join(F.broadcast(taken), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
