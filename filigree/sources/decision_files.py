"""Decisions made elsewhere, from JSON lines, JSON lists or delimited files, as rows that can be validated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.functions.text import clean_text
from filigree.operators.sets import settled

RECORD = "map<string, string>"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = F.trim(F.ltrim(F.col("value"), F.lit("\ufeff")))
    return spark.read.text(path).select(text.alias("raw")).where("raw <> ''").select("raw", F.when(F.col("raw").startswith("{"), F.from_json("raw", RECORD)).alias("record"))


def _lists(spark: SparkSession, path: str) -> DataFrame:
    """Items of a list, or of `records` of an object; each item must be an object. A file is one text, so one task reads it."""
    text = F.trim(F.ltrim(F.col("value"), F.lit("\ufeff")))
    whole = spark.read.text(path, wholetext=True).select(text.alias("text"))
    inner = F.when(F.col("text").startswith("{"), F.get_json_object("text", "$.records")).otherwise(F.col("text"))
    items = F.when(F.coalesce(inner, F.lit("")).startswith("["), F.from_json(inner, "array<string>"))
    each = whole.select("text", items.alias("items")).select(F.explode_outer(F.coalesce("items", F.array(F.lit(None).cast("string")))).alias("item"), F.substring("text", 1, 200).alias("head"))
    raw = F.coalesce("item", "head")
    return each.select(raw.alias("raw"), F.when(F.col("item").startswith("{"), F.from_json("item", RECORD)).alias("record"))


def _cells(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", "true").option("quote", '"').option("escape", '"').option("multiLine", "true").csv(path)
    pairs = [x for c in df.columns for x in (F.lit(c.lstrip("\ufeff")), F.coalesce(F.col(f"`{c}`"), F.lit("")))]
    record = F.create_map(*pairs)
    return df.select(F.to_json(record).alias("raw"), record.alias("record"))


def read_decisions(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """`rows` with raw and record (name to value, nested values as JSON), and `rejects` with raw of what is no object.

    The ending of the path says how it is written: .jsonl and .ndjson have a record on each line, .json a list or an
    object whose `records` is one, all else is delimited with a header. Blank lines are no records; a byte order mark is left out.
    """
    ending = path.lower().rsplit(".", 1)[-1]
    made = {"jsonl": _lines, "ndjson": _lines, "json": _lists}.get(ending, _cells)(spark, path)
    return {"rows": made.where("record is not null"), "rejects": made.where("record is null").select("raw")}


def _first(record: str, *names: str) -> Column:
    """The first of some names that a record has a text for, else an empty one."""
    return F.coalesce(*(F.nullif(clean_text(F.try_element_at(record, F.lit(n))), F.lit("")) for n in names), F.lit(""))


def flag(c: Column, default: int) -> Column:
    v = F.lower(F.trim(c))
    return F.when(v.isin("1", "true", "t", "yes", "y", "on"), 1).when(v.isin("0", "false", "f", "no", "n", "off", ""), 0).otherwise(default)


def codes(c: Column) -> Column:
    """Reason codes from a JSON list, or parted by semicolons, pipes or commas; blank ones are left out."""
    listed = F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>"))
    return F.filter(F.transform(F.coalesce(listed, F.split(F.coalesce(c, F.lit("")), "[;|,]+")), clean_text), lambda x: x != "")


def decisions(rows: DataFrame) -> DataFrame:
    """signature, decision, candidate_id, confidence, confidence_label, reason_codes, explanation and needs_human_review of records.

    A record is flat, or wraps its answer in an object, or the JSON text of one, under output, decision_json or model_output; then
    only the answer counts, but for the signature. A confidence that is no number is null; review is needed unless a record says no.
    """
    wraps = F.coalesce(*(F.nullif(F.trim(F.try_element_at("record", F.lit(n))), F.lit("")) for n in ("output", "decision_json", "model_output")))
    answer = F.when(wraps.startswith("{"), F.from_json(wraps, RECORD))
    own = F.nullif(_first("record", "signature_hash", "id", "signature"), F.lit(""))
    both = settled(rows.select(own.alias("own"), F.col("record"), answer.alias("wrapped")))
    flat = both.select("own", F.coalesce("wrapped", "record").alias("r"))
    listed = F.coalesce(F.nullif(F.try_element_at("r", F.lit("reason_codes")), F.lit("")), F.try_element_at("r", F.lit("reason_codes_json")))
    return flat.select(
        F.coalesce("own", _first("r", "signature_hash")).alias("signature"), _first("r", "decision").alias("decision"), _first("r", "candidate_id", "selected_candidate_id").alias("candidate_id"),
        F.try_element_at("r", F.lit("confidence")).try_cast("double").alias("confidence"), _first("r", "confidence_label").alias("confidence_label"), codes(listed).alias("reason_codes"), _first("r", "explanation").alias("explanation"),
        flag(F.try_element_at("r", F.lit("needs_human_review")), 1).alias("needs_human_review"),
    )


def imported(made: DataFrame, signatures: DataFrame, candidates: DataFrame, decided: DataFrame, *, regenerate: bool = False) -> DataFrame:
    """decisions() with import_status and the selected_ein of their candidate, for resolve.validated().

    signatures: signature; candidates: signature, candidate_id, ein; decided: signature of decisions that stand, which stay unless
    they are to be made anew. Status is missing_signature_hash, signature_not_found, skipped_existing or new. Records without a signature
    take no part in the joins.
    """
    known = signatures.select("signature", F.lit(True).alias("__known")).distinct()
    stands = decided.select("signature", F.lit(not regenerate).alias("__stands")).distinct()
    chosen = candidates.groupBy("signature", "candidate_id").agg(F.min("ein").alias("selected_ein"))
    named = made.where("signature <> ''").join(known, "signature", "left").join(stands, "signature", "left").join(chosen, ["signature", "candidate_id"], "left")
    status = F.when(F.col("__known").isNull(), "signature_not_found").when(F.col("__stands"), "skipped_existing").otherwise("new")
    nameless = made.where("signature = ''").select("*", F.lit(None).cast(candidates.schema["ein"].dataType).alias("selected_ein"), F.lit("missing_signature_hash").alias("import_status"))
    return named.withColumn("import_status", status).drop("__known", "__stands").unionByName(nameless)
