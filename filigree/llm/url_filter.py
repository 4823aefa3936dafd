"""URL filtering by association rules, with DataFrame functions only.

A list of rules on host and path decides first. Other urls are decided by rules that FP-growth
mines from labelled urls: combinations of url tokens that imply a bad label with enough support,
confidence and lift over the share of bad urls. Tokens are matched through an inverted index from
token to rule. Tokens that occur in the same labelled urls are mined as one, because n of them would
give 2**n combinations that say the same; a rule then asks for all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm.common import table

#: Verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Bad urls that a mined rule must hold in, the share of its urls that is bad, and how often that is the share of all.
MIN_COUNT, MIN_CONFIDENCE, MIN_LIFT = 20, 0.8, 1.2
BAD = "label:bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(urls: DataFrame) -> DataFrame:
    """Adds host and path; both are empty for a null url or one without `://`."""
    rest = F.when(F.col("url").contains("://"), F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return urls.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def listed(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))

    def branch(out: Column | None, rule: tuple[str, str, str]) -> Column:
        verdict, on, start = rule
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(start)
        value = F.struct(F.lit(on + start).alias("rule"), F.lit(verdict).alias("verdict"))
        return F.when(fits, value) if out is None else out.when(fits, value)

    return reduce(branch, ordered, None) if ordered else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: parts of the host between dots and hyphens, path segments with digits masked, names of query parameters."""
    def tagged(kind: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))

    segments = F.split(F.regexp_replace(path, r"[0-9]+", "0"), "/")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"^[^=]*", 0))
    return F.array_distinct(F.concat(tagged("host:", F.split(F.regexp_replace(host, r"[0-9]+", "0"), r"[.-]")), tagged("path:", segments), tagged("query:", names)))


def merged_tokens(labelled: DataFrame) -> DataFrame:
    """(token, head): tokens that occur in exactly the same labelled urls (id, tokens) have one head."""
    each = labelled.select("id", F.explode("tokens").alias("token"))
    where = [F.bit_xor(F.xxhash64(F.lit(k), "id")).alias(f"w{k}") for k in range(2)]
    marked = each.groupBy("token").agg(F.count("*").alias("n"), *where)
    heads = marked.groupBy("n", "w0", "w1").agg(F.min("token").alias("head"))
    return marked.join(heads, ["n", "w0", "w1"]).select("token", "head")


def mined_rules(labelled: DataFrame, *, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """(rule_id, rule, confidence, n_tokens, token): token combinations that imply a bad label, a row for each token.

    labelled has (id, tokens, bad), ids being different. A rule holds in min_count bad urls or more.
    """
    spark = labelled.sparkSession
    n = labelled.count()
    if n < min_count:
        return spark.createDataFrame([], "rule_id long, rule string, confidence double, n_tokens int, token string")
    heads = merged_tokens(labelled)
    once = labelled.select("id", "bad", F.explode("tokens").alias("token")).join(heads, "token").groupBy("id", "bad").agg(F.collect_set("head").alias("tokens"))
    items = once.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=(min_count - 0.5) / n, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where((F.col("consequent") == F.array(F.lit(BAD))) & (F.col("lift") >= min_lift))
    parts = rules.select(F.xxhash64(F.array_sort("antecedent")).alias("rule_id"), "confidence", F.explode("antecedent").alias("head")).join(heads, "head")
    named = parts.groupBy("rule_id", "confidence").agg(F.array_sort(F.collect_set("token")).alias("all"))
    return named.select("rule_id", F.array_join("all", " ").alias("rule"), "confidence", F.size("all").alias("n_tokens"), F.explode("all").alias("token"))


def fired(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined_rule) of the distinct urls, from (url, tokens), that hold all tokens of some rule: the surest one."""
    index = urls.select("url", F.explode("tokens").alias("token")).distinct()
    hits = index.join(rules, "token").groupBy("url", "rule_id", "rule", "confidence", "n_tokens").agg(F.count("*").alias("n"))
    return hits.where("n = n_tokens").groupBy("url").agg(F.max_by("rule", F.struct("confidence", "n_tokens", "rule")).alias("mined_rule"))


def filter_urls(pages: DataFrame, labels: DataFrame, *, rules: tuple[tuple[str, str, str], ...] = RULES, **mining: float) -> DataFrame:
    """page_id, host, path, rule, verdict and mined_rule, one row per row of pages.

    labels has doc_id, quality and toxic; the page of that id is bad if it is toxic or of low
    quality, and of a page's several labels a bad one wins. rule is the listed rule that decides;
    where none fits, a url is blocked if a mined rule fires, which mined_rule names. A null url has no
    host, path or label and is allowed. Rows that repeat get the same verdict; of a labelled page's
    several urls each is learnt from. Without labels nothing is mined, and what no listed rule fits is allowed.
    """
    parts = with_parts(pages.select("page_id", "url"))
    parts = parts.withColumn("listed", listed(F.col("host"), F.col("path"), rules))
    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    tokened = parts.where("url is not null").withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    labelled = tokened.join(marks, F.col("page_id") == F.col("doc_id")).groupBy(F.struct("page_id", "url").alias("id"), "tokens").agg(F.max("bad").alias("bad"))
    found = fired(tokened.where("listed is null").select("url", "tokens"), mined_rules(labelled, **mining)).withColumnRenamed("url", "__url")
    out = parts.join(found, parts["url"] == found["__url"], "left")
    verdict = F.coalesce(F.col("listed.verdict"), F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), verdict.alias("verdict"), "mined_rule")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


QUERIES = {"op7_url_filter": op7_url_filter}
ORACLES: dict[str, str] = {}
