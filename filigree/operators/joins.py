"""Joins: semi and anti forms, tiered lookups, token overlap, either-key joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.operators.windows import top_k_per_group


def exists(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other, list(on), "left_semi")


def missing(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other, list(on), "left_anti")


def applied_or_resolved(applied: DataFrame, resolved: DataFrame, on: Sequence[str]) -> DataFrame:
    """Applied rows, and resolved rows without an applied one."""
    return applied.unionByName(missing(resolved, applied, on), allowMissingColumns=True)


def final_identity(resolved: DataFrame, applied: DataFrame, decisions: DataFrame, on: Sequence[str], label: Column) -> DataFrame:
    """Resolved rows with the applied selection where there is one, then the decision's, then their own."""
    both = resolved.join(applied, list(on), "left").join(decisions, list(on), "left")
    chosen = F.coalesce("applied_ein", "decision_ein", "resolved_ein")
    confidence = F.coalesce("applied_confidence", "decision_confidence", "confidence")
    return both.select(*on, chosen.alias("final_ein"), confidence.alias("final_confidence"), label.alias("final_source"))


def source_label(module: bool) -> Column:
    """Where the final identity comes from; the query modules split rule sources further than the view does."""
    rule = F.when(F.col("model") == "rule:deterministic", "deterministic_rule").when(F.col("model").startswith("rule:"), "reported_ein_rule") if module else F.when(F.col("model").startswith("rule:"), "reported_ein_rule")
    return F.when(F.col("applied_ein").isNull(), "resolver").otherwise(rule.otherwise("ai_adjudicated" if module else "ai_assisted"))


def either_key(reports: DataFrame, extra: DataFrame, report: str, key: str) -> DataFrame:
    """Reports by their own key or an additional one; the own key wins where both hold."""
    own = reports.select(report, key, F.lit(1).alias("is_primary"))
    more = extra.select(report, key, F.lit(0).alias("is_primary"))
    return own.unionByName(more).groupBy(report, key).agg(F.max("is_primary").alias("is_primary"))


def unique_at_key(index: DataFrame, keys: Sequence[str], entity: str) -> DataFrame:
    """Keys at which the index knows exactly one entity, with it. Aggregated before any join, so hot keys collapse."""
    counted = index.groupBy(*keys).agg(F.countDistinct(entity).alias("__n"), F.min(entity).alias(entity))
    return counted.where("__n = 1").drop("__n")


def tiered_lookup(rows: DataFrame, index: DataFrame, tiers: Sequence[tuple[str, Sequence[str], float]], entity: str) -> DataFrame:
    """Adds the match of the first tier whose key names one entity: match, method and confidence."""
    out, matches = rows, []
    for name, keys, _ in tiers:
        found = unique_at_key(index.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))), keys, entity)
        out = out.join(found.withColumnRenamed(entity, f"__{name}"), list(keys), "left")
        matches.append(f"__{name}")
    first = F.coalesce(*matches)
    method = reduce(lambda acc, t: acc.when(F.col(f"__{t[0]}").isNotNull(), t[0]), tiers[1:], F.when(F.col(matches[0]).isNotNull(), tiers[0][0]))
    confidence = reduce(lambda acc, t: acc.when(F.col(f"__{t[0]}").isNotNull(), F.lit(t[2])), tiers[1:], F.when(F.col(matches[0]).isNotNull(), F.lit(tiers[0][2])))
    return out.withColumn("match", first).withColumn("method", F.coalesce(method, F.lit("unresolved"))).withColumn("confidence", F.coalesce(confidence, F.lit(0.0))).drop(*matches)


def token_overlap(queries: DataFrame, index: DataFrame, query: str, entry: str, tokens: str, k: int) -> DataFrame:
    """The k entries that share most distinct tokens with each query, by an inverted index."""
    left = queries.select(query, F.explode(F.array_distinct(tokens)).alias("token"))
    right = index.select(entry, F.explode(F.array_distinct(tokens)).alias("token"))
    hits = left.join(right, "token").groupBy(query, entry).agg(F.count("*").alias("hits"))
    return top_k_per_group(hits, [query], [F.desc("hits"), F.col(entry)], k, rank="rank")


def contains_all(df: DataFrame, key: str, tokens: str, terms: Sequence[str]) -> DataFrame:
    """Rows whose tokens include every term."""
    return df.where(reduce(lambda a, b: a & b, (F.array_contains(tokens, t) for t in terms))).select(key)


def unique_match(pairs: DataFrame, key: str, entity: str) -> DataFrame:
    """Keys with exactly one distinct entity among their pairs."""
    return pairs.groupBy(key).agg(F.countDistinct(entity).alias("n"), F.min(entity).alias(entity)).where("n = 1").drop("n")


def shared_targets(edges: DataFrame, source: str, target: str, *, hub_over: int) -> DataFrame:
    """Pairs of sources that share a target which isn't a hub (strictly more sources than hub_over)."""
    sources = edges.select(source, target).distinct()
    degree = sources.groupBy(target).agg(F.count("*").alias("degree")).where(F.col("degree") <= hub_over)
    kept = sources.join(degree.select(target), target)
    other = kept.select(target, F.col(source).alias("other"))
    return kept.join(other, target).where(F.col(source) < F.col("other")).groupBy(source, "other").agg(F.count("*").alias("shared"))


def two_hops(edges: DataFrame, source: str, target: str, year: str, *, within: int = 2) -> DataFrame:
    """Paths of two edges whose second year is 0 to `within` later; the middle is never the end."""
    first = edges.select(F.col(source).alias("a"), F.col(target).alias("b"), F.col(year).alias("y1"))
    second = edges.select(F.col(source).alias("b"), F.col(target).alias("c"), F.col(year).alias("y2"))
    return first.join(second, "b").where((F.col("y2") - F.col("y1")).between(0, within) & (F.col("b") != F.col("c")) & (F.col("a") != F.col("b")))


def reciprocal(edges: DataFrame, source: str, target: str, year: str, *, within: int = 2) -> DataFrame:
    """Edges in both directions at most `within` years apart, once per pair."""
    there = edges.select(F.col(source).alias("a"), F.col(target).alias("b"), F.col(year).alias("y1"), F.col("amount").alias("amount_there"))
    back = edges.select(F.col(target).alias("a"), F.col(source).alias("b"), F.col(year).alias("y2"), F.col("amount").alias("amount_back"))
    return there.join(back, ["a", "b"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("y1") - F.col("y2")) <= within))


def suffix_match(conflicts: DataFrame, loaded: DataFrame, on: str) -> DataFrame:
    """Conflicting paths of which exactly one ends with the loaded path."""
    pairs = conflicts.join(loaded, on).where(F.col("path").endswith(F.col("loaded_path")))
    return pairs.withColumn("n", F.count("*").over(Window.partitionBy(on))).where("n = 1").drop("n")
