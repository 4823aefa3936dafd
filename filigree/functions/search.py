"""What searches need: parsed parameters, name forms and their equality, relevance, scopes, details."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from filigree.functions.text import clean_text, name_tokens, once, resolver_name, union_name

# Words and lists on which matching rests.
FORM_WORDS = {"INCORPORATED": "INC", "CORPORATION": "CORP", "LIMITED": "LTD", "COMPANY": "CO"}
FORM_SUFFIXES = ("INC", "CORP", "CO", "LTD", "LLC")
GENERIC_NAMES = (
    "CASH", "DONATION", "DONATIONS", "GRANT", "GRANTS", "SCHOLARSHIP", "SCHOLARSHIPS", "TUITION", "GENERAL", "MEDICAL", "MISSION", "MINISTRY",
    "OTHER", "MISC", "MISCELLANEOUS", "VARIOUS", "UNKNOWN", "NONE", "N A", "MIT", "MSI", "FARE",
)
EDUCATION_SCOPES = ("likely_education", "education_or_mixed", "manual_include")
HEALTH_WORDS = ("NURSE", "HEALTH", "HOSPITAL", "PHYSICIAN", "MEDICAL")
MIXED_WORDS = ("TEACHER", "SCHOOL", "EDUCATION", "FACULTY", "PROFESSOR")
EDUCATION_WORDS = ("TEACHER", "EDUCATION", "SCHOOL", "EDUCATOR", "FACULTY", "PROFESSOR", "INSTRUCTOR", "ACADEMIC", "CLASSROOM")


def id_list(text: str) -> list[str]:
    """Nine-digit numbers of a text, in order, each once; marks inside a number are left out."""
    digits = (re.sub(r"\D", "", part) for part in re.split(r"[,\s;]+", text or ""))
    return list(dict.fromkeys(d for d in digits if len(d) == 9))


def id_lists(text: Column) -> Column:
    """id_list for each row."""
    digits = F.transform(F.split(F.coalesce(text, F.lit("")), r"[,\s;]+"), lambda p: F.regexp_replace(p, r"\D", ""))
    return F.array_distinct(F.filter(digits, lambda d: F.length(d) == 9))


def nine_digits(c: Column) -> Column:
    """Whether an identity is nine digits; null isn't."""
    return F.coalesce(c.rlike("^[0-9]{9}$"), F.lit(False))


def bounds(low: int | None, high: int | None) -> tuple[int, int] | None:
    """A range of years: one bound stands for both, reversed bounds are swapped."""
    given = [y for y in (low, high) if y is not None]
    return (min(given), max(given)) if given else None


def in_years(year: Column, low: int | None, high: int | None) -> Column:
    """Whether a year is within bounds; without bounds every row is."""
    found = bounds(low, high)
    return F.lit(True) if found is None else year.between(*found)


def year_of(text: Column) -> Column:
    """The year of a date given as text, null if it isn't one."""
    return F.year(F.try_to_date(text))


def name_forms(name: Column) -> Column:
    """The different canonical forms of a name: as it is, without THE in front, without legal suffixes behind, without both."""
    upper = F.concat(F.lit(" "), F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), "&", " AND "), F.lit(" "))
    unified = reduce(lambda c, kv: F.replace(c, F.lit(f" {kv[0]} "), F.lit(f" {kv[1]} ")), FORM_WORDS.items(), upper)
    core = F.trim(F.regexp_replace(F.regexp_replace(unified, r"[.,'\"()/\\-]+", " "), r"\s+", " "))

    def without_the(c: Column) -> Column:
        return F.regexp_replace(c, r"^THE(?: |$)", "")

    def without_suffixes(c: Column) -> Column:
        return F.trim(F.regexp_replace(c, rf"(?:(?:^| )(?:{'|'.join(FORM_SUFFIXES)}))+$", ""))

    def variants(p: Column) -> Column:
        return F.array(p["core"], p["bare"], without_suffixes(p["core"]), without_suffixes(p["bare"]))

    forms = once(once(core, lambda c: F.struct(c.alias("core"), without_the(c).alias("bare"))), variants)
    return once(forms, lambda f: F.array_distinct(F.filter(f, lambda x: x != "")))


def form_score(a: Column, b: Column) -> Column:
    """1, 0.99, 0.98 or 0.97 by the first forms of two names that agree, else 0.

    Forms are compared by their places among the different ones, so a name without THE has its
    suffixless form in second place; search results rest on this.
    """

    def at(forms: Column, i: int) -> Column:
        return F.coalesce(F.get(forms, F.lit(i)), F.lit(""))

    x, y = ([at(f, i) for i in range(4)] for f in (a, b))

    def same(p: Column, q: Column) -> Column:
        return (p != "") & (p == q)

    return (
        F.when(same(x[0], y[0]), 1.0)
        .when(same(x[1], y[0]) | same(x[1], y[1]) | same(y[1], x[0]), 0.99)
        .when(same(x[2], y[0]) | same(x[2], y[2]) | same(y[2], x[0]), 0.98)
        .when(((x[3] != "") & F.array_contains(b, x[3])) | ((y[3] != "") & F.array_contains(a, y[3])), 0.97)
        .otherwise(0.0)
    )


def relevance(name: Column, phrase: str) -> Column:
    """How a name holds a phrase: 100 equal, 90 begins with it, 85 after THE, 75 anywhere, 50 otherwise, 0 if either is empty."""
    n, p = F.lower(F.trim(F.coalesce(name, F.lit("")))), phrase.strip().lower()
    if not p:
        return F.lit(0)
    return F.when(n == "", 0).when(n == p, 100).when(n.startswith(p), 90).when(n.startswith(f"the {p}"), 85).when(n.contains(p), 75).otherwise(50)


def distinctive_name(name: Column, state: Column, states: Sequence[str], *, min_tokens: int = 3, min_length: int = 18, need_state: bool = True) -> Column:
    """Whether an exact name alone, without geography, is evidence: long, of several telling words, with a known state."""
    norm = resolver_name(clean_text(name))
    tokens = F.size(name_tokens(norm))
    short = tokens <= 2
    branch = F.arrays_overlap(F.split(norm, " "), F.array(*map(F.lit, ("CHURCH", "SCHOOL", "COLLEGE", "HOSPITAL"))))
    told = F.upper(clean_text(state)).isin(*states) if need_state else F.lit(True)
    return told & (norm != "") & ~norm.isin(*GENERIC_NAMES) & ~((F.length(norm) <= 5) & (tokens <= 1)) & (tokens >= min_tokens) & (F.length(norm) >= min_length) & ~(short & branch)


def education_scope(affiliation: Column, *names: Column) -> Column:
    """struct(scope, reason) of a union from its affiliation and names."""
    joined = F.concat_ws(" ", *(F.nullif(union_name(n), F.lit("")) for n in names))

    def value(scope: str, reason: str) -> Column:
        return F.struct(F.lit(scope).alias("scope"), F.lit(reason).alias("reason"))

    def decided(u: Column) -> Column:
        aff, text = u["aff"], u["text"]

        def any_of(words: Sequence[str]) -> Column:
            return reduce(lambda a, b: a | b, (text.contains(w) for w in words))

        aft = (aff == "AFT") | text.contains("AMERICAN FEDERATION OF TEACHERS")
        return (
            F.when((aff == "NEA") | text.contains("NATIONAL EDUCATION ASSOCIATION"), value("likely_education", "NEA affiliation or name"))
            .when(aft & any_of(HEALTH_WORDS) & ~any_of(MIXED_WORDS), value("uncertain", "AFT affiliate with health-care terms"))
            .when(aft, value("education_or_mixed", "AFT affiliation or name"))
            .when(any_of(EDUCATION_WORDS), value("likely_education", "Education-related organization-name terms"))
            .otherwise(value("uncertain", "No deterministic education indicator"))
        )

    return once(F.struct(union_name(affiliation).alias("aff"), joined.alias("text")), decided)


def in_scope(scope: str, affiliation: str = "affiliation", education: str = "education_scope") -> Column:
    """The filter behind a chosen scope: all, nea_aft, or education."""
    chosen = (scope or "education").strip().lower()
    if chosen == "all":
        return F.lit(True)
    if chosen == "nea_aft":
        return F.upper(F.coalesce(F.col(affiliation), F.lit(""))).isin("NEA", "AFT")
    return F.col(education).isin(*EDUCATION_SCOPES)


def detail(hit: Column, parts: Sequence[tuple[str, Column]]) -> Column:
    """`name=x | k=v | k=v`: a missing value is empty, a missing hit leaves its bar out."""
    text = [F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit(""))) for k, v in parts]
    return F.concat(F.lit("name="), F.coalesce(hit, F.lit("")), F.when(hit.isNotNull(), " | ").otherwise(""), F.concat_ws(" | ", *text))
