"""Screening lists and audit files: delimited text of any encoding, alone or in archives, to entities, aliases, addresses and rejects.

A file is one task: its bytes are hashed, its encoding follows from them, and an archive's members are read one after the
other. What the files hold is then plain DataFrame work.
"""

from __future__ import annotations

import codecs
import csv
import hashlib
import io
import re
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.functions.text import digits9, screening_name, year_hint

MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
Fields = dict[str, Sequence[str]]


def encoding_of(content: bytes) -> str:
    """By mark; else UTF-16 where every other byte is zero; else UTF-8 if it is valid; else cp1252."""
    for mark, name in MARKS:
        if content.startswith(mark):
            return name
    head = content[:4096]
    for odd, name in ((1, "utf-16-le"), (0, "utf-16-be")):
        if len(head) > 3 and head[odd::2].count(0) > 0.8 * len(head[odd::2]):
            return name
    try:
        content.decode("utf-8")
    except UnicodeDecodeError:
        return "cp1252"
    return "utf-8"


def members(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """(member, bytes): of an archive each file in it, of anything else itself."""
    if not zipfile.is_zipfile(io.BytesIO(content)):
        yield "", content
        return
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for m in sorted(z.namelist()):
            if not m.endswith("/"):
                yield m, z.read(m)


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def places(header: list[str], fields: Fields) -> dict[str, int]:
    """Where each field stands in a header, by its name or an alias; case and marks don't matter."""
    have = {_plain(h): i for i, h in reversed(list(enumerate(header)))}
    found = ((f, next((have[_plain(a)] for a in (f, *aliases) if _plain(a) in have), None)) for f, aliases in fields.items())
    return {f: i for f, i in found if i is not None}


def cell(text: str) -> str:
    """Without blanks, byte-order and end-of-file marks; a lone -0- stands for nothing."""
    text = text.strip().strip("﻿").strip("\x1a").strip()
    return "" if text == "-0-" else text


def read_rows(spark: SparkSession, path: str, fields: Fields, *, sep: str = ",", header: str = "always", least: int = 0, required: Sequence[str] = ()) -> DataFrame:
    """file, member, sha256, encoding, row_no, error and the fields as text, a row for each row that isn't blank.

    header: "always"; "never", then fields come in their order; "unless number", where a first cell of nine digits means that
    there is none. A row of fewer than `least` cells, a member without a required column, and one that is empty or can't be read
    are rows with an error. Undecodable bytes become question marks.
    """
    names = list(fields)

    def parsed(content: bytes, encoding: str) -> Iterator[tuple[int, str | None, list[str | None]]]:
        none: list[str | None] = [None] * len(names)
        rows = ([cell(c) for c in r] for r in csv.reader(io.StringIO(content.decode(encoding, errors="replace"), newline=""), delimiter=sep))
        rows = (r for r in rows if any(r))
        at = {f: i for i, f in enumerate(names)}
        number, first = 0, next(rows, None)
        if first is None:
            yield 0, "empty file", none
            return
        if header == "always" or (header == "unless number" and not re.fullmatch(r"\d{9}", re.sub(r"\D", "", first[0]))):
            at, first = places(first, fields), None
            if missing := [f for f in required if f not in at]:
                yield 0, f"missing columns: {', '.join(missing)}", none
                return
        while first is not None or (first := next(rows, None)) is not None:
            number += 1
            if len(first) < least:
                yield number, f"too few fields: {len(first)} of {least}", none
            else:
                yield number, None, [first[at[f]] if f in at and at[f] < len(first) else "" for f in names]
            first = None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                digest, out = hashlib.sha256(content).hexdigest(), []
                for member, data in members(file, content):
                    encoding = encoding_of(data)
                    try:
                        for number, error, values in parsed(data, encoding):
                            out.append((file, member, digest, encoding, number, error, *values))
                            if len(out) == 10_000:
                                yield pd.DataFrame(out, columns=columns)
                                out = []
                    except csv.Error as e:
                        out.append((file, member, digest, encoding, -1, f"unreadable: {e}", *[None] * len(names)))
                yield pd.DataFrame(out, columns=columns)

    columns = ["file", "member", "sha256", "encoding", "row_no", "error", *names]
    schema = "file string, member string, sha256 string, encoding string, row_no int, error string, " + ", ".join(f"`{n}` string" for n in names)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(run, schema)


def record_hash(*values: Column) -> Column:
    """SHA-256 of the values, each after its length in eight bytes."""
    parts = []
    for v in values:
        data = F.encode(F.coalesce(v, F.lit("")), "UTF-8")
        parts += [F.unhex(F.lpad(F.hex(F.octet_length(data).cast("long")), 16, "0")), data]
    return F.sha2(F.concat(*parts), 256)


def day(c: Column) -> Column:
    """A date as ISO text from four written forms; null for none."""
    forms = ((r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{8}$", "yyyyMMdd"), (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"))
    return F.coalesce(*(F.when(c.rlike(shape), F.try_to_date(c, form)) for shape, form in forms)).cast("string")


# The columns of each list with the names that they go by; lists without a header have them in this order.
PUB78: Fields = {"ein": ("TIN", "Taxpayer Identification Number"), "name": ("Organization Name",), "city": (), "region": ("STATE",), "country": ("Foreign Country",), "deductibility": ("DEDUCTIBILITY_CODE", "Deductibility Code")}
REVOKED: Fields = {
    "ein": ("TIN", "Taxpayer Identification Number"), "name": ("Organization Name",), "sort_name": ("NAME2",), "address": (), "city": (), "region": ("STATE",), "postal": ("ZIP", "ZIP CODE"), "country": (),
    "subsection": ("EXEMPTION_TYPE", "SUB_SECTION_CODE"), "revocation": ("REVOCATION_DATE",), "posting": ("REVOCATION_POSTING_DATE",), "reinstatement": ("EXEMPTION_REINSTATEMENT_DATE",),
}
LEIE: Fields = {c: () for c in ("lastname", "firstname", "midname", "busname", "general", "specialty", "upin", "npi", "dob", "address", "city", "state", "zip", "excltype", "excldate", "reindate", "waiverdate", "wvrstate")}
OFAC_PRIMARY: Fields = {c: () for c in ("number", "name", "type", "program", "title", "call_sign", "vessel_type", "tonnage", "grt", "flag", "owner", "remarks")}
OFAC_ALIAS: Fields = {c: () for c in ("number", "alias_number", "type", "name", "remarks")}
OFAC_ADDRESS: Fields = {c: () for c in ("number", "address_number", "address", "city", "country", "remarks")}
OFAC_COMMENT: Fields = {c: () for c in ("number", "more")}

ENTITY = ("dataset", "record_id", "entity_type", "primary_name", "name_norm", "ein", "status", "status_date", "reinstatement_date", "list_name", "program", "code", "birth_date", "npi", "upin", "address", "city", "region", "postal", "country", "remarks")
DATES = ("status_date", "reinstatement_date", "birth_date")


def _entities(rows: DataFrame, dataset: str, **columns: Column) -> DataFrame:
    made = {"dataset": F.lit(dataset), "name_norm": screening_name(columns["primary_name"])} | columns
    return rows.select(*(made.get(c, F.lit(None).cast("string") if c in DATES else F.lit("")).alias(c) for c in ENTITY))


def _judged(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a fault, and all others with their reason."""
    told = rows.withColumn("reason", F.coalesce("error", reason))
    return told.where("reason is null"), told.where("reason is not null").select("file", "member", "row_no", "reason")


def _aliases(rows: DataFrame, dataset: str, alias_id: Column, name: Column, kind: Column) -> DataFrame:
    return rows.select(F.lit(dataset).alias("dataset"), "record_id", alias_id.alias("alias_id"), name.alias("alias_name"), screening_name(name).alias("name_norm"), kind.alias("alias_type"))


def pub78(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Organizations to which gifts are deductible: entities, rejects."""
    good, bad = _judged(read_rows(spark, path, PUB78, sep="|", header="unless number", required=("ein", "name")), F.when(digits9(F.col("ein")) == "", "no nine-digit number").when(F.col("name") == "", "no name"))
    c = {n: F.col(n) for n in PUB78} | {"ein": digits9(F.col("ein"))}
    record = record_hash(c["ein"], c["name"], c["city"], c["region"], c["country"], c["deductibility"])
    out = _entities(good, "irs_pub78", record_id=record, entity_type=F.lit("organization"), primary_name=c["name"], ein=c["ein"], status=F.lit("eligible_for_deductible_contributions"), code=c["deductibility"], city=c["city"], region=c["region"], country=c["country"])
    return {"entities": out, "rejects": bad}


def revocations(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Organizations that lost their exemption: entities, aliases where the sort name says another name, rejects."""
    good, bad = _judged(read_rows(spark, path, REVOKED, sep="|", header="unless number", required=("ein", "name")), F.when(digits9(F.col("ein")) == "", "no nine-digit number").when(F.col("name") == "", "no name"))
    good = good.withColumns({"ein": digits9(F.col("ein")), "revoked": day(F.col("revocation")), "posted": day(F.col("posting")), "back": day(F.col("reinstatement"))})
    good = good.withColumn("record_id", record_hash(F.col("ein"), F.col("name"), F.col("revoked"), F.col("posted"), F.col("back")))
    status = F.when(F.col("back").isNotNull(), "reinstated_after_auto_revocation").otherwise("automatically_revoked")
    out = _entities(
        good, "irs_auto_revocation", record_id=F.col("record_id"), entity_type=F.lit("organization"), primary_name=F.col("name"), ein=F.col("ein"), status=status, status_date=F.col("revoked"), reinstatement_date=F.col("back"), code=F.col("subsection"),
        address=F.col("address"), city=F.col("city"), region=F.col("region"), postal=F.col("postal"), country=F.col("country"), remarks=F.coalesce(F.concat(F.lit("IRS posting date: "), F.col("posted")), F.lit("")),
    )
    named = good.where(F.col("sort_name") != "").where(screening_name(F.col("sort_name")) != screening_name(F.col("name")))
    return {"entities": out, "aliases": _aliases(named, "irs_auto_revocation", F.lit("irs_sort_name"), F.col("sort_name"), F.lit("sort_name")), "rejects": bad}


def exclusions(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """People and firms that health programs exclude: entities, aliases in the source's order of names, identifiers, rejects."""
    parts = F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in ("firstname", "midname", "lastname")))
    rows = read_rows(spark, path, LEIE, required=tuple(LEIE))
    good, bad = _judged(rows.withColumn("who", F.when(F.col("busname") != "", F.col("busname")).otherwise(parts)), F.when(F.col("who") == "", "no name"))
    good = good.withColumns({"npi": F.when(F.col("npi").rlike("^0*$"), "").otherwise(F.col("npi")), "born": day(F.col("dob")), "out": day(F.col("excldate"))})
    good = good.withColumn("record_id", record_hash(*(F.col(c) for c in ("who", "general", "specialty", "npi", "upin", "born", "address", "city", "state", "zip", "excltype", "out"))))
    firm = F.col("busname") != ""
    out = _entities(
        good, "hhs_leie", record_id=F.col("record_id"), entity_type=F.when(firm, "organization").otherwise("individual"), primary_name=F.col("who"), status=F.lit("active_exclusion"), status_date=F.col("out"), reinstatement_date=day(F.col("reindate")),
        list_name=F.lit("LEIE"), program=F.col("general"), code=F.col("excltype"), birth_date=F.col("born"), npi=F.col("npi"), upin=F.col("upin"), address=F.col("address"), city=F.col("city"), region=F.col("state"), postal=F.col("zip"), country=F.lit("US"),
    )
    person = good.where(~firm & (F.col("lastname") != "") & (F.col("firstname") != ""))
    order = F.concat(F.col("lastname"), F.lit(", "), F.concat_ws(" ", "firstname", F.nullif(F.col("midname"), F.lit(""))))
    ids = F.array_compact(F.array(*(F.when(F.col(c) != "", F.struct(F.lit(k).alias("kind"), F.col(c).alias("value"))) for k, c in (("NPI", "npi"), ("UPIN", "upin")))))
    return {"entities": out, "aliases": _aliases(person, "hhs_leie", F.lit("derived_source_order"), order, F.lit("source_field_order")), "identifiers": good.select(F.lit("hhs_leie").alias("dataset"), "record_id", F.inline(ids)), "rejects": bad}


def sanctions(spark: SparkSession, primary: str, aliases: str, addresses: str, comments: str, *, dataset: str, list_name: str) -> dict[str, DataFrame]:
    """Sanctioned parties from four files without headers: entities, aliases, addresses, rejects.

    Overlong remarks run on in the comments file, in the middle of a word if need be, so the two are joined without a separator. Aliases and
    addresses of a party that the first file doesn't have are rejects.
    """
    who, bad = _judged(read_rows(spark, primary, OFAC_PRIMARY, header="never", least=12), F.when(F.col("number") == "", "no number").when(F.col("name") == "", "no name"))
    more = read_rows(spark, comments, OFAC_COMMENT, header="never", least=2).where("error is null").groupBy("number").agg(F.max_by("more", "row_no").alias("more"))
    both = who.join(more, "number", "left")
    kind = F.lower("type")
    out = _entities(
        both, dataset, record_id=F.col("number"), entity_type=F.when(kind != "", kind).otherwise("unknown"), primary_name=F.col("name"), status=F.lit("sanctions_listed"), list_name=F.lit(list_name), program=F.col("program"),
        remarks=F.concat(F.col("remarks"), F.coalesce("more", F.lit(""))),
    )
    known = who.select("number", F.lit(True).alias("known")).distinct()

    def held(path: str, fields: Fields, fault: Column) -> tuple[DataFrame, DataFrame]:
        rows = read_rows(spark, path, fields, header="never", least=len(fields)).join(known, "number", "left")
        return _judged(rows, F.when(F.col("known").isNull(), "of no listed party").otherwise(fault))

    named, bad_names = held(aliases, OFAC_ALIAS, F.when(F.col("name") == "", "no name"))
    kind = F.when(F.col("type") != "", F.col("type")).otherwise("alias")
    number = F.when(F.col("alias_number") != "", F.col("alias_number")).otherwise(record_hash(kind, F.col("name")))
    normal = screening_name(F.concat_ws(" ", "address", "city", "country"))
    placed, bad_places = held(addresses, OFAC_ADDRESS, F.when(F.concat("address", "city", "country") == "", "no address"))
    place = F.when(F.col("address_number") != "", F.col("address_number")).otherwise(record_hash(F.col("address"), F.col("city"), F.col("country"), F.col("remarks")))
    where = placed.select(F.lit(dataset).alias("dataset"), F.col("number").alias("record_id"), place.alias("address_id"), "address", "city", "country", normal.alias("address_norm"), "remarks")
    return {"entities": out, "aliases": _aliases(named.withColumn("record_id", F.col("number")), dataset, number, F.col("name"), kind), "addresses": where, "rejects": bad.unionByName(bad_names).unionByName(bad_places)}


def audit_files(spark: SparkSession, path: str, fields: Fields, required: Sequence[str]) -> dict[str, DataFrame]:
    """Rows of audit files, alone or in archives, with the year that a file's or member's name says, and rejects."""
    rows = read_rows(spark, path, fields, required=required).withColumn("file_year", F.coalesce(year_hint(F.col("member")), year_hint(F.element_at(F.split("file", "/"), -1))))
    fault = F.lit(None).cast("string")
    for f in reversed(list(required)):
        fault = F.when(F.col(f) == "", F.lit(f"no {f}")).otherwise(fault)
    good, bad = _judged(rows, fault)
    return {"rows": good.drop("error", "reason"), "rejects": bad}
