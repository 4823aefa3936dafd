"""Source files: identity by content, primaries of duplicates, selection for a load."""

from __future__ import annotations

import hashlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def canonical_xml_sha256(content: pd.Series) -> pd.Series:
    """Hash of an XML document without white space between tags and without attribute order; null if it isn't XML."""

    def one(data: bytes | None) -> str | None:
        try:
            text = ElementTree.canonicalize(bytes(data or b"").decode("utf-8", "replace"), strip_text=True)
        except (ElementTree.ParseError, ValueError):
            return None
        return hashlib.sha256(text.encode()).hexdigest()

    return content.map(one)


def with_primaries(files: DataFrame) -> DataFrame:
    """files (path, object_id, sha256, canonical_sha256) with duplicate_status and whether to keep each.

    Of files of one object that are the same, the shallowest path, then the first by name, is primary.
    Objects whose files differ even canonically are conflicts, of which none is chosen.
    """
    group = Window.partitionBy("object_id")
    depth = F.size(F.split("path", "/"))
    first = F.row_number().over(group.orderBy(depth, "path")) == 1
    same, alike = (F.min(c).over(group) == F.max(c).over(group) for c in ("sha256", F.coalesce("canonical_sha256", "sha256")))
    status = F.when(F.count("*").over(group) == 1, "unique").when(same, "identical").when(alike, "equivalent").otherwise("object_id_conflict")
    return files.withColumn("duplicate_status", status).withColumn("keep", first & (F.col("duplicate_status") != "object_id_conflict"))


def to_load(files: DataFrame, loaded: DataFrame) -> DataFrame:
    """Files to append: of each object one file, and none that is loaded already."""
    fresh = files.join(loaded.select("object_id").distinct(), "object_id", "left_anti")
    n = F.row_number().over(Window.partitionBy("object_id").orderBy(F.size(F.split("path", "/")), "path"))
    return fresh.withColumn("__n", n).where("__n = 1").drop("__n")


def source_audit(files: DataFrame, loaded: DataFrame) -> DataFrame:
    """Each file with the filing loaded from exactly it, and the one loaded for its object."""
    exact = loaded.select(F.col("source_file").alias("path"), F.col("filing_id").alias("loaded_exact"))
    by_object = loaded.groupBy("object_id").agg(F.min("filing_id").alias("loaded_object"))
    return files.join(exact, "path", "left").join(by_object, "object_id", "left")
