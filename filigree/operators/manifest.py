"""Exactly one file for each object of a load, chosen from a scan's manifest and what is loaded; whatever isn't clear is a problem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a scan says of a file among those of its object.
UNIQUE, PRIMARY, COPY, CONFLICT = "unique", "primary_duplicate_group", "exact_duplicate", "object_id_conflict"


def said(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def object_of(filing_id: Column) -> Column:
    """A filing's object: its id without _public or _private at the end."""
    return F.regexp_replace(filing_id, r"(?i)_(public|private)$", "")


def portable(path: Column) -> Column:
    """A relative path with slashes and without empty or dot steps; '' where it is absolute, has a drive or leaves its folder."""
    steps = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: ~s.isin("", "."))
    bad = F.replace(path, F.lit("\\"), F.lit("/")).startswith("/") | F.coalesce(F.try_element_at(steps, F.lit(1)), F.lit("")).endswith(":") | F.array_contains(steps, "..")
    return F.when(bad, "").otherwise(F.array_join(steps, "/"))


def compared(path: Column, without_old: bool) -> Column:
    """A path as conflicts compare it: slashes, any case, none at the ends; `_old/` as `/` where asked."""
    key = F.regexp_replace(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "^/+|/+$", "")
    return F.replace(key, F.lit("_old/"), F.lit("/")) if without_old else key


def lies_at(loaded: Column, path: Column, without_old: bool) -> Column:
    whole, part = compared(loaded, without_old), compared(path, without_old)
    return (whole != "") & (part != "") & ((whole == part) | whole.endswith(F.concat(F.lit("/"), part)))


def choose(sources: DataFrame, loaded: DataFrame) -> DataFrame:
    """One row per object: object_id, relative_path, strategy, problem; the first two say nothing where there is a problem.

    sources: object_id, filing_id, relative_path, source_file, sha256, duplicate_status, keep_source_file, quarantine_status.
    loaded: object_id, filing_id, source_file; other columns of either are ignored. Objects are compared as trimmed text, null is ''.
    A single file must be `unique`; copies must have the same hash and keep the one primary; of a conflict the file is chosen that
    was loaded, by its path's end, or by that with `_old/` taken as `/`. The first problem counts. Both sides are combined to
    one row an object by partial aggregation; a conflict's paths are compared row by row before, so no object's files are gathered.
    """
    kept = loaded.select(said("object_id").alias("object_id"), said("filing_id").alias("f"), said("source_file").alias("p"))
    kept = kept.groupBy("object_id").agg(F.count("*").alias("n_loaded"), F.min("f").alias("loaded_filing"), F.min("p").alias("loaded_path"))
    columns = ("object_id", "filing_id", "relative_path", "source_file", "sha256", "duplicate_status", "keep_source_file", "quarantine_status")
    rows = sources.select(*(said(c).alias(c) for c in columns)).withColumns({"path": portable(F.col("relative_path")), "keep": portable(F.col("keep_source_file"))})
    status = F.col("duplicate_status")

    def ever(condition: Column, name: str) -> Column:
        return F.max(condition).alias(name)

    both = rows.join(kept, "object_id", "full_outer").withColumn("there", F.col("path").isNotNull())
    exact, old = (lies_at(F.col("loaded_path"), F.col("relative_path"), o) for o in (False, True))
    both = both.withColumns({"exact": exact, "old": old})

    def where(condition: Column, name: str) -> list[Column]:
        """How many rows fit, with path, id and quarantine of the only one that counts."""
        return [
            F.count(F.when(condition, 1)).alias(f"{name}_n"),
            F.min(F.when(condition, F.struct("path", "filing_id", "quarantine_status"))).alias(name),
        ]

    one = both.groupBy("object_id").agg(
        F.count(F.when(F.col("there"), 1)).alias("n"), F.coalesce(F.max("n_loaded"), F.lit(0)).alias("n_loaded"), F.max("loaded_filing").alias("loaded_filing"), F.max("loaded_path").alias("loaded_path"),
        ever(~status.isin(UNIQUE, PRIMARY, COPY, CONFLICT), "unknown"), ever((F.col("filing_id") == "") | (object_of(F.col("filing_id")) != F.col("object_id")), "foreign"), ever(status == CONFLICT, "conflict"),
        ever(status != UNIQUE, "not_unique"), ever(~status.isin(PRIMARY, COPY), "not_copies"), F.min("sha256").alias("least"), F.max("sha256").alias("most"), ever(F.col("keep_source_file") == "", "no_keep"),
        F.min("keep").alias("least_keep"), F.max("keep").alias("most_keep"), ever(F.col("path") == "", "no_path"), ever(F.col("path") != portable(F.col("source_file")), "other_path"),
        *where(status == PRIMARY, "primary"), *where(F.col("exact"), "at_path"), *where(F.col("old"), "at_old"), *where(F.col("there"), "any"),
    )
    by_path = F.col("at_path_n") > 0
    found = F.when(by_path, F.col("at_path")).otherwise(F.col("at_old"))
    chosen = F.when(F.col("conflict"), found).when(F.col("n") == 1, F.col("any")).otherwise(F.col("primary"))
    strategy = F.when(F.col("conflict"), F.when(by_path, "loaded_path").otherwise("loaded_path_normalized_old")).when(F.col("n") == 1, "unique").otherwise("exact_duplicate_primary")
    copies, conflict = ~F.col("conflict") & (F.col("n") > 1), F.col("conflict")
    problems = {
        "blank_object_id": F.col("object_id") == "",
        "no_source": F.col("n") == 0,
        "not_loaded": F.col("n_loaded") == 0,
        "loaded_more_than_once": F.col("n_loaded") > 1,
        "path_not_relative": F.col("no_path"),
        "inconsistent_source_path": F.col("other_path"),
        "unresolved_duplicate_status": F.col("unknown"),
        "inconsistent_filing_id": F.col("foreign"),
        "conflict_without_loaded_path": conflict & (F.col("loaded_path") == ""),
        "conflict_ambiguous": conflict & (F.when(by_path, F.col("at_path_n")).otherwise(F.col("at_old_n")) != 1),
        "conflict_other_filing": conflict & (found["filing_id"] != F.col("loaded_filing")),
        "stale_single_classification": ~conflict & (F.col("n") == 1) & F.col("not_unique"),
        "ambiguous_classification": copies & F.col("not_copies"),
        "different_or_unhashed_bytes": copies & ((F.col("least") == "") | (F.col("least") != F.col("most"))),
        "not_one_primary": copies & (F.col("primary_n") != 1),
        "incomplete_keep_path": copies & F.col("no_keep"),
        "inconsistent_keep_path": copies & ((F.col("least_keep") != F.col("most_keep")) | (F.col("least_keep") != F.col("primary.path"))),
        "not_xml": ~F.lower(chosen["path"]).endswith(".xml"),
        "quarantined": chosen["quarantine_status"] != "",
    }
    problem = F.coalesce(*(F.when(condition, name) for name, condition in problems.items()))
    verdict = one.select("object_id", chosen["path"].alias("path"), strategy.alias("strategy"), problem.alias("problem"))
    fine = F.col("problem").isNull()
    return verdict.select("object_id", F.when(fine, F.col("path")).alias("relative_path"), F.when(fine, F.col("strategy")).alias("strategy"), "problem")
