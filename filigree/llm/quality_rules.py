"""Quality rules and cross-document line frequency, with DataFrame functions only.

A line is normalised (lower case, runs of white space as one space) and hashed. For each
host, here the document's source, the documents that hold a line are counted; lines in more
than MAX_DOCS of them are removed, and a document that loses DEPLETED percent or more of the
characters of its lines is rejected. Rules on a document's own words come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm.common import SPACES, bound, table, words

#: A line in more documents of a host is boilerplate.
MAX_DOCS = 30
#: Percent of the characters of a document's lines; from here on it is depleted.
DEPLETED = 50
SYMBOLS = "#*$%&|<>"
#: Bits of a window's place when it is sorted together with its hash.
PLACE_BITS = 20


def window_hashes(tokens: Column) -> Column:
    """A hash of each three consecutive words."""

    def triples(h: Column) -> Column:
        n = F.greatest(F.size(h) - 2, F.lit(0))
        two = F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda a, b: F.xxhash64(a, b))
        return F.zip_with(two, F.slice(h, 3, n), lambda ab, c: F.xxhash64(ab, c))

    return bound(F.transform(tokens, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) < 3, F.array().cast("array<bigint>")).otherwise(triples(h)))


def repeated_words(hashes: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more: n log n in the text's length."""

    def covered(starts: Column) -> Column:
        return F.aggregate(F.transform(starts, lambda p, i: F.least(F.coalesce(F.get(starts, i + 1) - p, F.lit(3)), F.lit(3)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)

    def by_place(h: Column) -> Column:
        # hash in the high bits, place in the low: neighbours after sorting are equal windows, which is then confirmed
        low = F.lit(2**PLACE_BITS - 1).cast("long")
        keyed = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(F.shiftright(x, PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long"))))

        def same(k: Column, i: Column, j: Column) -> Column:
            other = F.get(k, j)
            return F.coalesce(F.get(h, F.get(k, i).bitwiseAND(low).cast("int")) == F.get(h, other.bitwiseAND(low).cast("int")), F.lit(False))

        starts = bound(keyed, lambda k: F.sort_array(F.transform(F.filter(k, lambda x, i: same(k, i, i - 1) | same(k, i, i + 1)), lambda x: x.bitwiseAND(low).cast("int"))))
        return bound(starts, covered)

    def by_struct(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = bound(pairs, lambda p: F.sort_array(F.transform(F.filter(p, lambda x, i: F.coalesce(x["h"] == F.get(p, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(p, i + 1)["h"], F.lit(False))), lambda x: x["i"])))
        return bound(starts, covered)

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).when(F.size(hashes) < 2**PLACE_BITS, bound(hashes, by_place)).otherwise(bound(hashes, by_struct))


def base_rules(docs: DataFrame) -> DataFrame:
    """Counts on each document's own words, and base_failed: too few words or too many repeated ones."""
    text = F.coalesce("text", F.lit(""))
    tokens = docs.select("doc_id", text.alias("text"), words(F.col("text")).alias("w"))
    hashed = tokens.select(
        "doc_id", "text", F.size("w").cast("long").alias("n_words"), window_hashes(F.col("w")).alias("h"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    counted = hashed.select(
        "doc_id", "n_words", F.length(F.regexp_replace("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("h")).alias("n_repeat_words"),
    )
    return counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def hashed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, host, hash and characters of each line that isn't blank; a null host is the empty one."""
    line = docs.where("doc_id is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("host"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    normal = line.select("doc_id", "host", F.lower(F.trim(F.regexp_replace("line", SPACES, " "))).alias("line")).where("line != ''")
    return normal.select("doc_id", "host", F.xxhash64("line").alias("h"), F.length("line").alias("chars"))


def frequent_lines(lines: DataFrame, *, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, h) of the lines in more than max_docs documents of the host."""
    return lines.groupBy("host", "h").agg(F.countDistinct("doc_id").alias("n_docs")).where(F.col("n_docs") > max_docs)


def quality_rules(docs: DataFrame, *, max_docs: int = MAX_DOCS, depleted: int = DEPLETED) -> DataFrame:
    """The base counts, base_failed, removed_chars, line_chars and kept, one row per row of docs.

    A null, empty or blank text has no words, so it fails the base rules. Rows of equal doc_id count
    as one document of their host. Rows without doc_id belong to no document of a host: the base rules alone judge them.
    """
    lines = hashed_lines(docs)
    often = frequent_lines(lines, max_docs=max_docs).select("host", "h", F.lit(True).alias("often"))
    lost = lines.join(often, ["host", "h"], "left").groupBy("doc_id").agg(F.sum(F.when(F.col("often"), F.col("chars")).otherwise(0)).alias("removed_chars"), F.sum("chars").alias("line_chars"))
    out = base_rules(docs).join(lost, "doc_id", "left")
    empty = F.coalesce(F.col("removed_chars") * 100 >= depleted * F.col("line_chars"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~empty)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n
        FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
              FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1)
        GROUP BY doc_id),
base AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
              - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
lines AS (
  SELECT doc_id, host, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS l
  FROM (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS l FROM d)),
often AS (SELECT host, l FROM lines WHERE l <> '' GROUP BY host, l HAVING count(DISTINCT doc_id) > {MAX_DOCS}),
lost AS (
  SELECT doc_id, sum(CASE WHEN often.l IS NULL THEN 0 ELSE length(lines.l) END) AS removed, sum(length(lines.l)) AS chars
  FROM lines LEFT JOIN often ON often.host = lines.host AND often.l = lines.l WHERE lines.l <> '' GROUP BY doc_id)
SELECT base.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(100 * removed >= {DEPLETED} * chars, FALSE) AS kept
FROM base LEFT JOIN lost ON lost.doc_id = base.doc_id
"""

QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES = {"op10_quality_rules": ORACLE}
