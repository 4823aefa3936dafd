"""Tables whose columns are described by a metadata file beside them, in one folder for each year.

A metadata file <table>_meta.txt has a line for each column: its name, NULL or NOT NULL, and its type. Its records are
in <table>_data_<year>.txt. What describes columns is small and read as a table of its own; records are read by pipe_records.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.sources.pipe_records import Field, read_files

COLUMN_LINE = r"^\s*([A-Za-z][A-Za-z0-9_]*)\s+(NOT NULL|NULL)\s+([A-Za-z0-9_]+)\s*$"
# Types by kind, and words in the name of a text column that may hold pipes.
KINDS = {"int": ("INTEGER", "BIGINT", "SMALLINT", "NUMBER", "NUMERIC"), "date": ("DATE",), "timestamp": ("TIMESTAMP",)}
TEXT_TYPES = ("VARCHAR", "CHAR", "TEXT")
FREE_TEXT_WORDS = ("name", "purpose", "description", "address", "street", "city", "unit", "class", "category", "title", "security", "terms", "paid_to", "voice")


def described(lines: DataFrame) -> DataFrame:
    """(year, table, position, name, type, nullable) of lines (year, table, line_no, line); what describes no column is left out."""
    parts = [F.regexp_extract("line", COLUMN_LINE, i) for i in (1, 2, 3)]
    named = lines.select("year", "table", "line_no", parts[0].alias("name"), F.upper(parts[2]).alias("type"), (parts[1] == "NULL").alias("nullable")).where("name <> ''")
    # a table has some hundred columns, and they are numbered within it
    each = F.sort_array(F.collect_list(F.struct("line_no", "name", "type", "nullable")))
    out = named.groupBy("year", "table").agg(each.alias("c")).select("year", "table", F.posexplode("c").alias("position", "c"))
    return out.select("year", "table", "position", "c.name", "c.type", "c.nullable")


def schema_hash(columns: DataFrame) -> DataFrame:
    """(year, table, n_columns, schema_hash): SHA-256 of a JSON list of [name, type, nullable, position], without blanks."""
    one = F.format_string('["%s","%s",%s,%d]', "name", "type", F.col("nullable").cast("string"), "position")
    ordered = F.sort_array(F.collect_list(F.struct("position", one.alias("s"))))
    text = F.concat(F.lit("["), F.array_join(ordered["s"], ","), F.lit("]"))
    return columns.groupBy("year", "table").agg(F.count("*").alias("n_columns"), F.sha2(text, 256).alias("schema_hash"))


def kind() -> Column:
    """The kind of a column for pipe_records, by its type and, of texts, its name."""
    may_hold_pipes = reduce(lambda a, b: a | b, (F.lower("name").contains(w) for w in FREE_TEXT_WORDS))
    out = F.when(F.col("type").isin(*TEXT_TYPES) & may_hold_pipes, "text")
    for k, types in KINDS.items():
        out = out.when(F.col("type").isin(*types), k)
    return out.otherwise("code")


def columns_of(spark: SparkSession, root: str, years: Sequence[int] = ()) -> DataFrame:
    """described() columns of all metadata files in the year folders of root, with their kind; of `years`, if any are named.

    A folder that isn't a number is no year. It is an error if a year that is asked for has no metadata, and if
    a file describes no column.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*_meta.txt").format("binaryFile").load(root).select("path", "content")
    place = r"/(\d+)/([^/]+)_meta\.txt$"
    named = files.select(F.regexp_extract("path", place, 1).alias("y"), F.lower(F.regexp_extract("path", place, 2)).alias("table"), F.decode("content", "UTF-8").alias("text")).where("y <> ''")
    named = named.withColumn("year", F.col("y").cast("int"))
    wanted = named.where(F.col("year").isin(*years)) if years else named
    lines = wanted.select("year", "table", F.posexplode(F.split(F.regexp_replace("text", "^\ufeff", ""), "\r?\n")).alias("line_no", "line"))
    columns = described(lines).withColumn("kind", kind())
    found, empty = {r.year for r in wanted.select("year").distinct().collect()}, wanted.select("year", "table").distinct().join(columns, ["year", "table"], "left_anti").orderBy("year", "table").first()
    if missing := sorted(set(years) - found):
        raise FileNotFoundError(f"no metadata below {root} for {', '.join(map(str, missing))}")
    if not found:
        raise FileNotFoundError(f"no year folder with metadata below {root}")
    if empty is not None:
        raise ValueError(f"{empty.year}/{empty.table}_meta.txt describes no column")
    return columns


def fields_by_year(columns: DataFrame, table: str) -> dict[int, list[Field]]:
    """The fields of one table in each year; a table's columns are few."""
    out: dict[int, list[Field]] = {}
    for r in columns.where(F.col("table") == table).orderBy("year", "position").collect():
        out.setdefault(r.year, []).append(Field(r.name.lower(), r.kind, r.nullable))
    return out


def read_table(spark: SparkSession, root: str, columns: DataFrame, table: str) -> DataFrame:
    """Records of one table of all years, each by the columns of its own year, with year, file, raw, repair and error.

    A column that a year doesn't have is null there. A year's data file that isn't there is an error, as Spark has it.
    """
    by_year = fields_by_year(columns, table)
    if not by_year:
        raise KeyError(table)
    parts = [read_files(spark, f"{root.rstrip('/')}/{year}/{table}_data_{year}.txt", fields).withColumn("year", F.lit(year)) for year, fields in by_year.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def table_name(logical: str) -> str:
    """A name that SQL takes: lower case, other marks as underscores, no digit first."""
    plain = re.sub(r"[^a-z0-9_]+", "_", logical.lower()).strip("_")
    return plain if plain and not plain[0].isdigit() else f"t_{plain}"
