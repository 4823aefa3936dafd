"""The master file of exempt organisations: four regions, each with or without a header."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The files, and the columns of one without a header, in order.
FILES = ("eo1.csv", "eo2.csv", "eo3.csv", "eo4.csv")
COLUMNS = (
    "ein", "name", "ico", "street", "city", "state", "zip", "group", "subsection", "affiliation", "classification", "ruling", "deductibility", "foundation", "activity", "organization", "status", "tax_period",
    "asset_cd", "income_cd", "filing_req_cd", "pf_filing_req_cd", "acct_pd", "asset_amt", "income_amt", "revenue_amt", "ntee_cd", "sort_name",
)


def column_key(name: str) -> str:
    """A header's cell as a column: lower case, other marks as single underscores, none at the ends."""
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def _region(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.option("quote", '"').option("escape", '"').option("multiLine", "true")
    first = reader.csv(path).head(1)
    keys = [column_key((v or "").lstrip("\ufeff")) for v in first[0]] if first else []
    titled = "ein" in keys and ("name" in keys or "street" in keys)
    given = keys if titled else COLUMNS
    # positions are read and named afterwards, so a header may repeat a name or leave one out
    rows = reader.schema(", ".join(f"c{i} string" for i in range(len(given)))).option("header", str(titled).lower()).option("enforceSchema", "true").csv(path)

    def cell(c: str) -> Column:
        at = max((i for i, k in enumerate(given) if k == c), default=None)
        return F.lit("") if at is None else F.coalesce(f"c{at}", F.lit(""))

    return rows.select(*(F.ltrim(cell(c), F.lit("\ufeff")).alias(c) if c == "ein" else cell(c).alias(c) for c in COLUMNS), F.lit(path.rsplit("/", 1)[-1]).alias("source_file"))


def read_master(spark: SparkSession, folder: str, *, require: bool = True) -> DataFrame:
    """COLUMNS and source_file of all regions in a folder; a column that a file or a short row lacks is an empty text.

    A file whose first row names `ein` and `name` or `street` has a header, whose columns may be in any order; any other has COLUMNS
    in theirs. Cells beyond them are left out. Missing regions are an error unless `require` is false; without any there are no rows.
    """
    jvm, root = spark._jvm, folder.rstrip("/")
    there = [f for f in FILES if (p := jvm.org.apache.hadoop.fs.Path(f"{root}/{f}")).getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)]
    if require and (missing := [f for f in FILES if f not in there]):
        raise FileNotFoundError(f"{', '.join(missing)} not in {folder}")
    if not there:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in (*COLUMNS, "source_file")))
    return reduce(DataFrame.unionByName, (_region(spark, f"{root}/{f}") for f in there))
