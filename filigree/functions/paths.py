"""Paths of source files in one form, values as a loosely typed database would hold them, strength of client names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filigree.functions.similarity import ratio
from filigree.functions.text import once, text

#: Words that don't count when client names are compared.
CLIENT_SUFFIXES = ("CO", "COMPANY", "CORP", "CORPORATION", "INC", "INCORPORATED", "LLC", "LTD", "THE")


def _slashed(c: Column) -> Column:
    return F.replace(F.trim(text(c)), F.lit("\\"), F.lit("/"))


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))


def portable_path(c: Column) -> Column:
    """A relative path with single slashes; null if it is empty, absolute, on a drive, or goes upward."""

    def valid(p: Column) -> Column:
        first = F.coalesce(F.get(p["parts"], F.lit(0)), F.lit(""))
        bad = p["path"].startswith("/") | first.endswith(":") | F.array_contains(p["parts"], "..") | (F.size(p["parts"]) == 0)
        return F.when(~bad, F.array_join(p["parts"], "/"))

    return once(once(_slashed(c), lambda s: F.struct(s.alias("path"), _parts(s).alias("parts"))), valid)


def path_hint(c: Column) -> Column:
    """An old absolute path without its root or drive, for comparison; null if nothing is left or it goes upward."""

    def rest(parts: Column) -> Column:
        drive = F.coalesce(F.get(parts, F.lit(0)), F.lit("")).endswith(":")
        kept = F.when(drive, F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))).otherwise(parts)
        return F.when((F.size(kept) > 0) & ~F.array_contains(kept, ".."), F.array_join(kept, "/"))

    return once(_parts(_slashed(c)), rest)


def loaded_path_key(c: Column) -> Column:
    """The key under which a loaded file's path is compared: folders of old copies count as the new ones."""
    return F.trim(F.replace(F.lower(F.replace(text(c), F.lit("\\"), F.lit("/"))), F.lit("_old/"), F.lit("/")), F.lit("/"))


def numeric_affinity(c: Column) -> Column:
    """struct(kind, whole, real, text) of a text: null, integer, real or text, with the value in the field of its kind.

    A number without fraction that fits 64 bits is an integer, however it is written; any other number is real.
    """
    t = F.trim(c)
    number = t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    exact = F.when(number, t).try_cast("decimal(38,18)")
    whole = F.when(exact == F.floor(exact), exact.try_cast("long"))
    kind = F.when(c.isNull(), "null").when(whole.isNotNull(), "integer").when(number, "real").otherwise("text")
    return F.struct(kind.alias("kind"), whole.alias("whole"), F.when(number & whole.isNull(), t.try_cast("double")).alias("real"), F.when(~number, c).alias("text"))


def client_strength(query: Column, candidate: Column, state: Column, candidate_state: Column) -> Column:
    """exact, strong or empty: how well a client's name agrees with an organisation's, if their states don't differ."""

    def tokens(c: Column) -> Column:
        return F.filter(F.regexp_extract_all(F.upper(text(c)), F.lit("[A-Z0-9]+"), F.lit(0)), lambda x: ~x.isin(*CLIENT_SUFFIXES))

    q, k = tokens(query), tokens(candidate)
    sets = [F.size(F.array_distinct(x)) for x in (q, k)]
    overlap = F.size(F.array_intersect(q, k)) / F.greatest(*sets, F.lit(1))
    apart = (text(state) != "") & (text(candidate_state) != "") & (F.upper(text(candidate_state)) != text(state))
    alike = ((overlap >= 0.75) & (F.least(*sets) >= 2)) | (ratio(F.array_join(q, " "), F.array_join(k, " ")) >= 0.92)
    return F.when((F.size(q) == 0) | (F.size(k) == 0) | apart, "").when(q == k, "exact").when(alike, "strong").otherwise("")
