"""Projections of child tables, targeted queues, and bounded lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.operators.windows import top_k_per_group

# Statuses of the first pass whose grants go to the queue.
QUEUED_STATUSES = ("unresolved", "conflicting_ein_match", "reported_ein_not_found_name_matched", "address_unique", "address_narrowed_name_match", "fuzzy_probable")


def filled(*columns: str) -> Column:
    """The first of some texts that isn't blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def recipients(grants: DataFrame) -> DataFrame:
    """Grant recipients in one shape, whether in the country or abroad."""
    second = F.col("business_name_line2_txt")
    name = F.concat(F.coalesce("business_name_line1_txt", F.lit("")), F.when(second.isNotNull() & (second != ""), F.concat(F.lit(" "), second)).otherwise(""))
    home = F.col("us_state_abbreviation_cd")
    return grants.select(
        "filing_id", "recipient_ein", F.trim(name).alias("recipient_name"), F.coalesce("us_city_nm", "foreign_city_nm").alias("city"), F.coalesce(home, "foreign_province_or_state_nm").alias("state"),
        F.when(home.isNotNull() & (home != ""), "US").otherwise(F.col("foreign_country_cd")).alias("country"), F.col("cash_grant_amt").alias("cash_amount"),
        F.col("non_cash_assistance_amt").alias("noncash_amount"), F.col("purpose_of_grant_txt").alias("purpose"),
    )


def contractors(rows: DataFrame) -> DataFrame:
    """Contractors in one shape: names and addresses from the first filled field, and whether the address is in the country."""
    state, line = F.nullif(F.trim("state_abbreviation_cd"), F.lit("")), F.nullif(F.trim("usaddress_address_line1_txt"), F.lit(""))
    here = state.isNotNull() | line.isNotNull()
    return rows.select(
        "id", "filing_id", filled("business_name_line1_txt", "person_nm").alias("contractor_name"), "services_desc", "compensation_amt", filled("usaddress_address_line1_txt", "address_line1_txt").alias("address1"),
        filled("usaddress_city_nm", "city_nm").alias("city"), filled("state_abbreviation_cd", "province_or_state_nm").alias("region"), filled("zipcd", "foreign_postal_cd").alias("postal_code"),
        F.coalesce(filled("country_cd"), F.when(here, "US")).alias("country"), here.cast("int").alias("is_us_address"),
    )


def queued(*, low: float, statuses: Sequence[str] = QUEUED_STATUSES, least_amount: float | None = None, state: str | None = None, ids: tuple[int | None, int | None] = (None, None)) -> Column:
    """Whether a grant needs another look: by status, low confidence or a warning, within further limits."""
    doubt = F.coalesce(F.col("confidence") <= low, F.lit(False)) | (F.trim(F.coalesce("warning_flags", F.lit(""))) != "")
    parts = [doubt | F.coalesce(F.col("match_status").isin(*statuses), F.lit(False)) if statuses else doubt]
    if least_amount is not None:
        parts.append(F.coalesce("total_amount", F.lit(0.0)) >= least_amount)
    if state:
        parts.append(F.upper(F.coalesce("recipient_state", F.lit(""))) == state.upper())
    parts += [F.col("grant_id") >= ids[0]] if ids[0] is not None else []
    parts += [F.col("grant_id") <= ids[1]] if ids[1] is not None else []
    return reduce(lambda a, b: a & b, parts)


def within_budget(branches: Sequence[tuple[DataFrame, Sequence[Column]]], budget: int) -> DataFrame:
    """Rows of several branches, the first branch first, each in its own order, until the budget is used up; equal rows once.

    The budget bounds the result, which is a page for people. Each branch is cut before the union.
    """
    cut = [df.orderBy(*order).limit(budget).withColumn("__n", F.row_number().over(_in(order))).withColumn("__b", F.lit(i)) for i, (df, order) in enumerate(branches)]
    taken = reduce(DataFrame.unionByName, cut).orderBy("__b", "__n").limit(budget)
    columns = branches[0][0].columns
    return taken.groupBy(*columns).agg(F.min(F.struct("__b", "__n")).alias("__at")).orderBy("__at").select(*columns)


def _in(order: Sequence[Column]):
    from pyspark.sql import Window

    return Window.orderBy(*order)  # of a page of rows, cut before


def page_after(df: DataFrame, key: str, last: str | None, size: int) -> DataFrame:
    """The next page in order of a key, after the last one seen."""
    return (df if last is None else df.where(F.col(key) > last)).orderBy(key).limit(size)


def focal_edges(edges: DataFrame, source: str, focus: Sequence[int], most: int) -> DataFrame:
    """For each organisation in focus its edge per target, the latest and surest, of the `most` latest targets."""
    own = edges.where(F.col(source).isin(*focus))
    best = top_k_per_group(own, [source, "target"], [F.desc("tax_year"), F.desc("confidence"), F.col("edge_id")], 1)
    return top_k_per_group(best, [source], [F.desc("tax_year"), F.col("target")], most)


def grant_paths(flows: DataFrame, source: str, target: str, focus: Sequence[int], *, partners: int = 60, first_hops: int = 8, second_hops: int = 4, most: int = 20) -> DataFrame:
    """Two-step paths of each organisation in focus: from its largest partners on to theirs, the largest first."""
    sums = flows.groupBy(source, target).agg(F.round(F.sum("amount"), 2).alias("amount"))
    one = top_k_per_group(sums.where(F.col(source).isin(*focus)), [source], [F.desc("amount"), F.col(target)], min(partners, first_hops))
    middle = sums.join(one.select(F.col(target).alias(source)).distinct(), source, "left_semi")
    two = top_k_per_group(middle, [source], [F.desc("amount"), F.col(target)], second_hops)
    paths = one.select(F.col(source).alias("focus"), F.col(target).alias("via"), F.col("amount").alias("amount1")).join(two.select(F.col(source).alias("via"), F.col(target).alias("end"), F.col("amount").alias("amount2")), "via")
    return top_k_per_group(paths, ["focus"], [F.desc(F.least("amount1", "amount2")), F.col("via"), F.col("end")], most)


def conflict_groups(files: DataFrame) -> DataFrame:
    """Objects with several files: how many contents, sizes, whether they mean the same, and where the files are."""
    g = files.groupBy("object_id").agg(
        F.count("*").alias("file_count"), F.countDistinct("sha256").alias("byte_hash_count"), F.countDistinct("canonical_sha256").alias("canonical_hash_count"), F.min("size_bytes").alias("min_size_bytes"),
        F.max("size_bytes").alias("max_size_bytes"), F.min("canonical_sha256").alias("__low"), F.array_join(F.array_sort(F.collect_list("relative_path")), "\n").alias("source_files"),
    )
    same = (F.col("canonical_hash_count") == 1) & ~F.col("__low").startswith("ERROR:")
    return g.where("file_count > 1").withColumn("conflict_kind", F.when(same, "canonical_equivalent").otherwise("canonical_different")).drop("__low")
