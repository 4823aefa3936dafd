"""Pipe-delimited records with schema-guided repair of literal pipes and line breaks in text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import date, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A column: kind is int, number, date, timestamp, code or text. Only text can hold pipes."""

    name: str
    kind: str
    nullable: bool = True


def _is_date(v: str) -> bool:
    try:
        date.fromisoformat(v)
    except ValueError:
        return False
    return len(v) == 10


def _is_timestamp(v: str) -> bool:
    try:
        datetime.fromisoformat(v)
    except ValueError:
        return False
    return True


FITS: dict[str, Callable[[str], bool]] = {
    "int": lambda v: re.fullmatch(r"[-+]?\d+", v) is not None,
    "number": lambda v: re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)", v) is not None,
    "date": _is_date,
    "timestamp": _is_timestamp,
    "code": lambda v: True,
    "text": lambda v: True,
}


def fits(value: str, field: Field) -> bool:
    return field.nullable if value.strip() == "" else FITS[field.kind](value.strip())


def split_record(line: str, fields: Sequence[Field]) -> tuple[list[str] | None, str]:
    """The record's values and what was done: '', 'LITERAL_PIPE', or an error with no values.

    Over-long records are repaired where exactly one way of merging neighbours into text columns
    merges least: best[k] is the fewest merged columns, and the number of ways, to fit the first
    columns into the first k segments.
    """
    parts = line.replace("\r", "").replace("\n", " ").split("|")
    if len(parts) < len(fields):
        return None, f"too few fields: {len(parts)} of {len(fields)}"
    if len(parts) == len(fields):
        ok = all(map(fits, parts, fields))
        return (parts, "") if ok else (None, "a value doesn't fit its column")
    spare = len(parts) - len(fields)
    best: dict[int, tuple[int, int, list[str]]] = {0: (0, 1, [])}
    for field in fields:
        after: dict[int, tuple[int, int, list[str]]] = {}
        for at, (merged, ways, values) in best.items():
            for take in range(1, (spare if field.kind == "text" else 0) + 2):
                value = "|".join(parts[at : at + take])
                if at + take > len(parts) or not fits(value, field):
                    continue
                cost, old = merged + (take > 1), after.get(at + take)
                if old is None or cost < old[0]:
                    after[at + take] = (cost, ways, [*values, value])
                elif cost == old[0]:
                    after[at + take] = (cost, old[1] + ways, old[2])
        best = after
    found = best.get(len(parts))
    if found is None:
        return None, "too many fields: no repair fits"
    return (found[2], "LITERAL_PIPE") if found[1] == 1 else (None, f"too many fields: {found[1]} repairs fit alike")


def records(lines: list[str], fields: Sequence[Field], most_joined: int = 20) -> Iterator[tuple[str, list[str] | None, str]]:
    """Records of one file. A line that doesn't parse takes further lines until it does, most_joined at most."""
    at = 0
    while at < len(lines):
        values, note = split_record(lines[at], fields)
        used = 1
        while values is None and note.startswith("too few") and used <= most_joined and at + used < len(lines):
            used += 1
            values, note = split_record("\n".join(lines[at : at + used]), fields)
        if values is None:
            _, note = split_record(lines[at], fields)
            used = 1
        yield "\n".join(lines[at : at + used]), values, "LINE_BREAK" if values is not None and used > 1 and not note else note
        at += used


def parsed(raw: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Columns of each record in a `value` column, with repair and error; one row per row."""
    schema = ", ".join(f"`{f.name}` string" for f in fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [split_record(v or "", fields) for v in pdf["value"]]
            rows = [[*(v or [None] * len(fields)), n if v else None, None if v else n] for v, n in out]
            yield pd.DataFrame(rows, columns=[*(f.name for f in fields), "repair", "error"])

    kinds = {"int": "bigint", "number": "double", "date": "date", "timestamp": "string", "code": "string", "text": "string"}
    text = raw.select("value").mapInPandas(run, f"{schema}, repair string, error string")
    return text.select(*(F.nullif(F.trim(f.name), F.lit("")).try_cast(kinds[f.kind]).alias(f.name) for f in fields), "repair", "error")


def read_files(spark: SparkSession, path: str, fields: Sequence[Field]) -> DataFrame:
    """Logical records of whole files, a task for each file: line breaks inside text make a file sequential."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, text in zip(pdf["file"], pdf["value"], strict=True):
                rows = [(name, raw, *(v or [None] * len(fields)), n if v else None, None if v else n) for raw, v, n in records(text.split("\n")[1:], fields) if raw]
                yield pd.DataFrame(rows, columns=["file", "raw", *(f.name for f in fields), "repair", "error"])

    schema = ", ".join(f"`{f.name}` string" for f in fields)
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return whole.mapInPandas(run, f"file string, raw string, {schema}, repair string, error string")
