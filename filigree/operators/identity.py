"""One table of the names and addresses by which organisations are known, from filings and the master file, and its words.

Sources are ranked; the same identity of one source is kept once. The words of names are made in the same pass and dealt by
word, as the lookup by words asks for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.functions.text import MATCHER_STREET_WORDS, clean_text, digits9, matcher_name, name_tokens, stable_hash, street, zip5
from filigree.operators.sets import settled

# Sources with their ranks, best first, and the master file's columns that are carried along.
RANKS = {"returns_org_name": 10, "returns_dba_name": 12, "bmf_name": 20, "bmf_sort_name": 22, "bmf_ico": 35}
MASTER_TEXT = ("subsection", "foundation", "deductibility", "ntee_cd", "status", "tax_period")
MASTER_NUMBERS = ("asset_amt", "income_amt", "revenue_amt")
MASTER_EXTRA = ("activity", "affiliation", "classification", "filing_req_cd", "group", "organization", "pf_filing_req_cd", "ruling", "source_file")
COLUMNS = (
    "identity_key", "ein", "source", "source_detail", "source_rank", "legal_name", "alias_name", "display_name", "name_norm", "street", "street_norm", "city", "state", "zip5", "filing_id", "tax_year", "bmf_region",
    *MASTER_TEXT, *MASTER_NUMBERS, "extra_json",
)


def plain_number(c: Column) -> Column:
    """A number with commas left out; null if it is none."""
    return F.regexp_replace(clean_text(c), ",", "").try_cast("double")


def _named(rows: DataFrame, sources: list[tuple[str, str | None]]) -> DataFrame:
    """Identities of rows under each source's name: (source, column of the alias or None); an alias that says the same as the legal name is none."""
    alias = F.array_compact(F.array(*(_one(source, column) for source, column in sources)))
    each = settled(rows.withColumn("norm", matcher_name(F.col("legal_name")))).select("*", F.inline(alias)).drop("norm")
    name = F.when(F.col("alias_name") != "", F.col("alias_name")).otherwise(F.col("legal_name"))
    each = settled(each.withColumns({"display_name": name, "name_norm": matcher_name(name)})).where("ein <> '' and display_name <> '' and name_norm <> ''")
    key = stable_hash(*(F.col(c) for c in ("ein", "source", "name_norm", "street_norm", "city", "state", "zip5", "filing_id")), F.coalesce(F.nullif(F.col("tax_year"), F.lit(0)).cast("string"), F.lit("")), prefix="ID_")
    return each.withColumn("identity_key", key).select(*COLUMNS)


def _one(source: str, column: str | None) -> Column:
    text = F.lit("") if column is None else clean_text(F.col(column))
    one = F.struct(F.lit(source).alias("source"), F.lit(RANKS[source]).alias("source_rank"), text.alias("alias_name"))
    return one if column is None else F.when((text != "") & (matcher_name(text) != F.col("norm")), one)


def _placed(address: str, city: str, state: str, postal: str) -> dict[str, Column]:
    line = clean_text(F.col(address))
    return {"street": line, "street_norm": street(line, MATCHER_STREET_WORDS), "city": F.upper(clean_text(F.col(city))), "state": F.upper(clean_text(F.col(state))), "zip5": zip5(F.col(postal))}


def returns_identities(returns: DataFrame, canonical: DataFrame) -> DataFrame:
    """COLUMNS of filings (filing_id, ein, org_name, dba_name, us_address_line1, city, state, zip, tax_year); canonical (filing_id, tax_year) says the year where it knows it."""
    known = canonical.select("filing_id", F.col("tax_year").alias("__year")).dropDuplicates(["filing_id"])
    rows = returns.where("trim(coalesce(ein, '')) <> '' and trim(coalesce(org_name, '')) <> ''").join(known, "filing_id", "left")
    none = {c: F.lit("") for c in MASTER_TEXT} | {c: F.lit(None).cast("double") for c in MASTER_NUMBERS} | {"extra_json": F.lit("{}"), "bmf_region": F.lit(None).cast("int")}
    made = rows.select(
        digits9(F.col("ein")).alias("ein"), clean_text(F.col("org_name")).alias("legal_name"), clean_text(F.col("dba_name")).alias("dba_name"), clean_text(F.col("filing_id")).alias("filing_id"),
        F.coalesce("__year", "tax_year").cast("int").alias("tax_year"), *(c.alias(n) for n, c in _placed("us_address_line1", "city", "state", "zip").items()), *(c.alias(n) for n, c in none.items()),
    )
    out = _named(made.withColumn("source_detail", F.lit("")), [("returns_org_name", None), ("returns_dba_name", "dba_name")])
    return out.withColumn("source_detail", F.when(F.col("source") == "returns_org_name", "returns.org_name").otherwise("returns.dba_name"))


def master_identities(master: DataFrame, *, in_care_of: bool = False) -> DataFrame:
    """COLUMNS of the master file, whose columns are in lower case, with source_file (eo1.csv to eo4.csv, which says the region).

    The person in care of whom mail goes is a name only if asked for.
    """
    rows = master.withColumn("__name", clean_text(F.col("name"))).where(F.col("__name") != "")
    extra = F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f'"{c}": "'), F.regexp_replace(clean_text(F.col(c)), r'(["\\])', r"\\$1"), F.lit('"')) for c in MASTER_EXTRA)), F.lit("}"))
    region = F.nullif(F.regexp_extract("source_file", r"(?i)eo([1-4])\.csv$", 1), F.lit("")).cast("int")
    made = rows.select(
        digits9(F.col("ein")).alias("ein"), F.col("__name").alias("legal_name"), "sort_name", "ico", F.lit("").alias("filing_id"), F.lit(None).cast("int").alias("tax_year"), F.col("source_file").alias("source_detail"),
        *(c.alias(n) for n, c in _placed("street", "city", "state", "zip").items()), *(clean_text(F.col(c)).alias(c) for c in MASTER_TEXT), *(plain_number(F.col(c)).alias(c) for c in MASTER_NUMBERS), extra.alias("extra_json"),
        region.alias("bmf_region"),
    )
    return _named(made, [("bmf_name", None), ("bmf_sort_name", "sort_name"), *([("bmf_ico", "ico")] if in_care_of else [])])


def layer(*sources: DataFrame) -> DataFrame:
    """All identities, each key once. Rows of a key that differ elsewhere are put in one order, and the first is kept."""
    both = sources[0]
    for more in sources[1:]:
        both = both.unionByName(more)
    rest = [c for c in COLUMNS if c != "identity_key"]
    return both.groupBy("identity_key").agg(F.min(F.struct(*rest)).alias("r")).select("identity_key", "r.*")


def words(identities: DataFrame) -> DataFrame:
    """(identity_key, token, state, zip5): the distinct words of each name, with the places by which they are looked up."""
    return identities.select("identity_key", F.explode(name_tokens(F.col("name_norm"))).alias("token"), "state", "zip5")


def written(identities: DataFrame, path: str, table: str, *, buckets: int = 64) -> None:
    """Writes the layer to a folder and its words as a table bucketed by token, so that lookups join without moving it."""
    identities.write.mode("overwrite").parquet(path)
    stored = identities.sparkSession.read.parquet(path)
    words(stored).write.mode("overwrite").bucketBy(buckets, "token").sortBy("token").saveAsTable(table)
