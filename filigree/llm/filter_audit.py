"""What filters do in every order, from one count of masks.

Each document fails some of the filters, which is a mask of bits. Counting masks within a part of the
corpus is the only pass over documents; a subset-zeta transform turns a part's counts, one per mask, into
survivors for every subset of filters. A step of an order is then the difference of two neighbouring
subsets, and so are the labels lost in it.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm.common import bound, table, words, written

FILTERS = "ABCDE"
#: A filter's bit, and the mask of all.
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
ALL = (1 << len(FILTERS)) - 1
#: What is counted for each mask: documents, those labelled good, those labelled toxic.
COUNTS = ("docs", "good", "toxic")


def own_mask(text: Column) -> Column:
    """Bits of the filters that look at one text: A to D."""

    def bits(w: Column) -> Column:
        few = F.when(F.size(w) < 100, BIT["A"]).otherwise(0)
        return few + F.when(100 * F.size(F.array_distinct(w)) < 80 * F.size(w), BIT["B"]).otherwise(0)

    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    shouts = F.when(100 * capitals.cast("long") > 10 * F.length(text).cast("long"), BIT["C"]).otherwise(0)
    symbols = F.when(text.rlike(r"[#$%&*|]"), BIT["D"]).otherwise(0)
    return bound(words(text), bits) + shouts + symbols


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and the number of documents, good and toxic ones, one row for each mask that occurs.

    A copy (filter E) is a document whose text a smaller doc_id has. The smallest doc_id of each text is
    found with partial aggregation and joined by text and doc_id together, so that a group of copies is
    never brought together, however large.
    """
    text = F.coalesce("text", F.lit(""))
    each = docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), own_mask(text).alias("mask"),
    )
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    each = each.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    each = written(each.groupBy("digest", "doc_id", "part", "mask", "good", "toxic").agg(F.count("*").alias("n")))
    lowest = each.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    firsts = each.join(lowest, ["digest", "doc_id"], "left_semi").unionByName(each.where("doc_id is null"))
    # every row as a copy, and for those that are none, the row moved from the copies' mask
    copies = each.withColumn("mask", F.col("mask") + BIT["E"])
    moved = firsts.unionByName(firsts.withColumn("mask", F.col("mask") + BIT["E"]).withColumn("n", -F.col("n")))
    return copies.unionByName(moved).groupBy("part", "mask").agg(
        F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def zeta(counts: Column) -> Column:
    """Sums over subsets of an array by mask: place s becomes the sum of all places within s."""

    def added(c: Column, bit: int) -> Column:
        return F.transform(c, lambda x, i: F.when(i.bitwiseAND(F.lit(bit)) != 0, x + F.get(c, i - bit)).otherwise(x))

    return reduce(lambda c, bit: bound(c, lambda whole: added(whole, bit)), BIT.values(), counts)


def survivors(counted: DataFrame) -> DataFrame:
    """part and, for docs, good and toxic, an array of the documents that no filter of subset s fails, at place s."""

    def by_mask(name: str) -> Column:
        return F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(name))), F.lit(0)).cast("long") for m in range(ALL + 1)))

    arrays = counted.groupBy("part").agg(*(by_mask(c).alias(c) for c in COUNTS))
    # documents that survive subset s are those whose mask lies within the complement of s
    return arrays.select("part", *(F.reverse(zeta(F.col(c))).alias(c) for c in COUNTS))


def steps(spark: SparkSession) -> DataFrame:
    """All orders of the filters, step by step: the subsets before and after each."""
    rows = [
        ("".join(p), i + 1, p[i], sum(BIT[f] for f in p[:i]), BIT[p[i]]) for p in permutations(FILTERS) for i in range(len(p))
    ]
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, before int, bit int")


def order_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null and empty texts are the same text without words; a null lang and an empty one are the same part. Rows that
    repeat (same doc_id and text) are no copies of each other and count each. A row without doc_id has no smaller
    doc_id, so it is no copy, and makes none. Of several labels of a doc_id, any that says good (toxic) counts; null
    labels say nothing. An empty table gives no rows. Other columns are neither read nor returned.
    """
    arrays = survivors(masked(docs, labels))

    def at(name: str, subset: Column) -> Column:
        return F.get(F.col(name), subset)

    before, bit = F.col("before"), F.col("bit")
    after, others = before + bit, F.lit(ALL) - bit

    def lost(name: str, subset: Column) -> Column:
        return at(name, subset) - at(name, subset + bit)

    def weighted(subset: int) -> Column:
        """The removals after a subset, times the orders in which just that subset comes first."""
        size = subset.bit_count()
        times = factorial(size) * factorial(len(FILTERS) - 1 - size)
        return F.when(F.lit(subset).bitwiseAND(bit) == 0, times * lost("docs", F.lit(subset))).otherwise(0)

    # the steps are 600 rows whatever the data
    rows = arrays.crossJoin(F.broadcast(steps(docs.sparkSession)))
    return rows.select(
        "part", "filter_order", "step", "filter", at("docs", after).alias("kept"), lost("docs", before).alias("removed"),
        (lost("docs", F.lit(0)) - lost("docs", before)).alias("redundant"), lost("docs", others).alias("unique_fails"),
        lost("good", before).alias("good_lost"), lost("toxic", before).alias("toxic_lost"),
        reduce(lambda a, b: a + b, (weighted(s) for s in range(ALL))).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), FALSE) AS copy
  FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN copy THEN 'E' ELSE '' END AS f
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
counted AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
steps AS (SELECT o, s, substr(o, s, 1) AS x, substr(o, 1, s - 1) AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS s)),
-- a mask's first filter in an order removes its documents
met AS (
  SELECT part, o, s, x, n, good, toxic, f = x AS alone, contains(f, x) AS fails,
         length(translate(earlier, f, '')) < length(earlier) AS gone
  FROM counted, steps),
stepped AS (
  SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, x AS filter,
         CAST(sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN alone THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM met GROUP BY part, o, s, x)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM stepped
"""

QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLES = {"op12_filter_audit": ORACLE}
