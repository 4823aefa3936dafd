"""Delimited files whose headers vary: columns are found by alias, with or without a header."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def mapped_columns(df: DataFrame, columns: dict[str, Sequence[str]], *, required: Sequence[str] = (), parse: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Columns under their own names, each taken from the first alias that df has, else null.

    Header case, blanks and underscores don't matter. A missing required column is an error.
    """
    def plain(name: str) -> str:
        return "".join(ch for ch in name.lower() if ch.isalnum())

    have = {plain(c): c for c in df.columns}
    source = {name: next((have[plain(a)] for a in (name, *aliases) if plain(a) in have), None) for name, aliases in columns.items()}
    if missing := [c for c in required if source.get(c) is None]:
        raise ValueError(f"required columns not found: {', '.join(missing)}")
    parse = parse or {}

    def value(name: str) -> Column:
        raw = F.lit(None).cast("string") if source[name] is None else F.nullif(F.trim(F.col(f"`{source[name]}`").cast("string")), F.lit(""))
        return parse.get(name, lambda c: c)(raw).alias(name)

    return df.select(*(value(n) for n in columns))


def read_delimited(spark: SparkSession, path: str, columns: dict[str, Sequence[str]], *, sep: str = ",", header: bool = True, **how: object) -> DataFrame:
    """A delimited file with its columns mapped; without a header they come in the given order."""
    reader = spark.read.option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", sep == ",")
    df = reader.csv(path, header=True) if header else reader.schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    return mapped_columns(df, columns, **how)


def with_rejects(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that are valid, and those that aren't or can't be judged."""
    return df.where(valid), df.where(~F.coalesce(valid, F.lit(False)))
