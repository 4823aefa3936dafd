"""Normalisers, identifiers and parsers as Column expressions.

The five name normalisers differ on purpose and must not be merged: each belongs to one
matching step and its output is part of that step's keys.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The domain's own word lists. Matching results depend on each entry.
LEGAL_SUFFIXES = ("INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LIMITED", "LLC", "PLC", "PLLC", "PC")
STREET_WORDS = {
    "STREET": "ST", "AVENUE": "AVE", "ROAD": "RD", "BOULEVARD": "BLVD", "DRIVE": "DR", "LANE": "LN",
    "COURT": "CT", "PLACE": "PL", "PARKWAY": "PKWY", "HIGHWAY": "HWY", "SUITE": "STE", "FLOOR": "FL",
}
MATCHER_STREET_WORDS = STREET_WORDS | {
    "APARTMENT": "APT", "BUILDING": "BLDG", "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W",
    "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW",
}
NAME_ABBREVIATIONS = {
    "UNIV": "UNIVERSITY", "UNIVERS": "UNIVERSITY", "SCH": "SCHOOL", "SCHL": "SCHOOL", "CTR": "CENTER", "CNTR": "CENTER",
    "ASSN": "ASSOCIATION", "ASSOC": "ASSOCIATION", "FDN": "FOUNDATION", "FDTN": "FOUNDATION", "FDNTN": "FOUNDATION",
    "ORG": "ORGANIZATION", "INST": "INSTITUTE", "DEPT": "DEPARTMENT", "ST": "SAINT", "MT": "MOUNT",
    "INTL": "INTERNATIONAL", "NATL": "NATIONAL",
}
NAME_STOPWORDS = (
    "THE", "A", "AN", "OF", "AND", "FOR", "TO", "IN", "AT", "ON", "BY", "WITH", "FROM", "FOUNDATION", "FUND", "INC", "CORP", "LLC", "CO", "LTD",
)
COMMON_NAME_WORDS = (
    "SCHOOL", "SCHOOLS", "CENTER", "CENTRE", "UNIVERSITY", "COLLEGE", "ACADEMY", "ASSOCIATION", "SOCIETY", "CHURCH",
    "MINISTRY", "MINISTRIES", "HEALTH", "MEDICAL", "HOSPITAL", "CLINIC", "COMMUNITY", "SERVICE", "SERVICES", "PROGRAM",
    "PROGRAMS", "PUBLIC", "AMERICAN", "NATIONAL", "INTERNATIONAL", "LOCAL", "COUNTY", "CITY", "FRIENDS", "FAMILY",
    "FAMILIES", "YOUTH", "CHILD", "CHILDREN", "EDUCATION", "EDUCATIONAL", "ART", "ARTS", "MUSEUM", "CLUB", "TRUST",
    "CHARITABLE", "NONPROFIT", "NON", "PROFIT", "RELIEF", "SUPPORT", "DEVELOPMENT", "COUNCIL",
)
PLACEHOLDER_IDS = ("123456789", "987654321")
RECIPIENT_NOUNS = r"ORGANIZATIONS|ORGS|CHARITIES|RECIPIENTS|GRANTEES|BENEFICIARIES|DONEES|NONPROFITS|NON\s+PROFITS|FOUNDATIONS|SCHOOLS|CHURCHES|FOOD\s+BANKS|AGENCIES|ENTITIES|DISTRIBUTIONS|GRANTS|INDIVIDUALS|PERSONS|PATIENTS|STUDENTS"
#: Fixed values, in the order in which they are tried: pattern on the normalised name, reason.
UNSPECIFIC_RECIPIENTS = (
    (r"^\s*$", "blank_recipient_name"),
    (r"\bSEE\s+(SCHEDULE|STATEMENT|ATTACHMENT|ATTACHED|LIST|DETAIL|DETAILS)\b", "see_schedule_or_attachment"),
    (r"\bSEE\s+ATTACHED\b", "see_attached"),
    (r"\bATTACHED\s+(SCHEDULE|STATEMENT|LIST|DETAIL|DETAILS)\b", "attached_schedule_or_list"),
    (r"\bDETAIL(?:ED)?\s+(SCHEDULE|STATEMENT|LIST|ATTACHMENT)\b", "detailed_schedule_or_list"),
    (r"\bAS\s+PER\s+(SCHEDULE|STATEMENT|ATTACHMENT|LIST)\b", "as_per_schedule_or_list"),
    (r"\bPER\s+(ATTACHED|SCHEDULE|STATEMENT|LIST)\b", "per_attached_or_schedule"),
    (r"\bLIST\s+OF\s+(DISTRIBUTIONS?|GRANTS?|RECIPIENTS?|ORGANIZATIONS?)\b", "list_of_recipients"),
    (r"\bDISTRIBUTIONS?\s+(LIST|SCHEDULE|STATEMENT)\b", "distribution_list_or_schedule"),
    (r"\bAVAILABLE\s+UPON\s+REQUEST\b", "available_upon_request_placeholder"),
    (r"\bNETWORK\s+OF\s+(?:OVER\s+)?\d+\s+(AGENCIES|ORGANIZATIONS|RECIPIENTS|ENTITIES)\b", "network_of_recipients_placeholder"),
    (r"\b\d+\s+(?:TO\s+)?\d+\s+DIFFERENT\s+(ORGANIZATIONS|AGENCIES|RECIPIENTS|ENTITIES)\b", "different_recipients_placeholder"),
    (r"\bDIFFERENT\s+(ORGANIZATIONS|AGENCIES|RECIPIENTS|ENTITIES)\b", "different_recipients_placeholder"),
    (r"\bGRANTS?\s+MADE\s+TO\s+VARIOUS\b.*\b(ENTITIES|ORGANIZATIONS|CHARITIES|RECIPIENTS|FOUNDATIONS|NONPROFITS|NON\s+PROFITS)\b", "various_recipients_placeholder"),
    (r"\bDESIGNATIONS?\s+TO\s+OTHER\b.*\b(AGENCIES|UNITED\s+WAYS|UWS|ORGANIZATIONS|CHARITIES|ENTITIES)\b", "designations_to_other_recipients_placeholder"),
    (r"\b(?:\d+\s+)?PARTNER\s+CHARITY\s+ORGANIZATIONS\b", "partner_charity_organizations_placeholder"),
    (r"\bELIGIBLE\s+PATIENTS?\b", "eligible_patients_placeholder"),
    (r"^VARIOUS$", "various_recipients_placeholder"),
    (rf"\bVARIOUS\s+(?:[A-Z0-9]+\s+){{0,3}}({RECIPIENT_NOUNS})\b", "various_recipients_placeholder"),
    (r"^MULTIPLE$", "multiple_recipients_placeholder"),
    (rf"\bMULTIPLE\s+(?:[A-Z0-9]+\s+){{0,3}}({RECIPIENT_NOUNS})\b", "multiple_recipients_placeholder"),
    (r"^NUMEROUS$", "numerous_recipients_placeholder"),
    (rf"\bNUMEROUS\s+(?:[A-Z0-9]+\s+){{0,3}}({RECIPIENT_NOUNS})\b", "numerous_recipients_placeholder"),
    (r"\bMANY\s+(?:[A-Z0-9]+\s+){0,3}(ORGANIZATIONS|RECIPIENTS|INDIVIDUALS|CHARITIES|GRANTEES|BENEFICIARIES|PATIENTS|STUDENTS)\b", "many_recipients_placeholder"),
    (r"\bSCHOLARSHIP\s+(RECIPIENTS?|STUDENTS?)\b", "scholarship_recipient_placeholder"),
    (r"^INDIVIDUALS?$", "individuals_placeholder"),
    (r"^PATIENTS?$", "patients_placeholder"),
    (r"^STUDENTS?$", "students_placeholder"),
    (r"^N\s*A$", "na_placeholder"),
    (r"^NONE$", "none_placeholder"),
    (r"^UNKNOWN$", "unknown_placeholder"),
    (r"^ANNUAL\s+CAMPAIGN$", "campaign_not_recipient"),
    (r"^CAMPAIGN$", "campaign_not_recipient"),
)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body has it."""
    return F.transform(F.array(value), body)[0]


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clean_text(c: Column) -> Column:
    """White space collapsed and trimmed; null is empty."""
    return F.trim(F.regexp_replace(text(c), r"\s+", " "))


def _alnum(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(text(c)), "&", " AND "), "[^A-Z0-9]+", " "))


def _without_legal_words(c: Column) -> Column:
    no_article = F.regexp_replace(c, "^(?:THE(?: |$))+", "")
    return F.trim(F.regexp_replace(no_article, f"(?:(?:^| )(?:{'|'.join(LEGAL_SUFFIXES)}))+$", ""))


def _mapped(c: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.array_join(F.transform(F.split(c, " "), lambda t: F.coalesce(F.try_element_at(pairs, t), t)), " ")


def resolver_name(c: Column) -> Column:
    """Upper case, & as AND, other marks as blanks, no leading THE, no legal suffixes."""
    return _without_legal_words(_alnum(c))


def matcher_name(c: Column) -> Column:
    """As resolver_name, with abbreviations written out first."""
    return _without_legal_words(_mapped(_alnum(c), NAME_ABBREVIATIONS))


def union_name(c: Column) -> Column:
    """Keeps suffixes; LOCAL NO. 12 and LOCAL #12 become LOCAL 12."""
    upper = F.regexp_replace(F.upper(clean_text(c)), "&", " AND ")
    local = F.regexp_replace(upper, r"\bLOCAL\s+(?:NO\.?|NUMBER|#)\s*(\d+)\b", "LOCAL $1")
    return F.trim(F.regexp_replace(local, "[^A-Z0-9]+", " "))


@F.pandas_udf(StringType())
def _nfkc_upper(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFKC", v or "").upper())


@F.pandas_udf(StringType())
def _ascii_upper(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFKD", v or "").encode("ascii", "ignore").decode().upper())


def screening_name(c: Column) -> Column:
    """Compatibility forms folded, diacritics and suffixes kept."""
    marked = F.regexp_replace(_nfkc_upper(text(c)), "&", " AND ")
    return F.trim(F.regexp_replace(F.regexp_replace(marked, r"(?U)[^\w]+", " "), r"\s+", " "))


def network_name(c: Column) -> Column:
    """ASCII letters and digits only, diacritics dropped."""
    return F.trim(F.regexp_replace(_ascii_upper(text(c)), "[^A-Z0-9]+", " "))


def street(c: Column, words: dict[str, str] = STREET_WORDS) -> Column:
    return _mapped(F.trim(F.regexp_replace(F.upper(text(c)), "[^A-Z0-9]+", " ")), words)


def digits(c: Column) -> Column:
    return F.regexp_replace(text(c), r"[^0-9]", "")


def digits9(c: Column) -> Column:
    d = digits(c)
    return F.when(F.length(d) == 9, d).otherwise("")


def zip5(c: Column) -> Column:
    """The first five of all digits."""
    d = digits(c)
    return F.when(F.length(d) >= 5, F.substring(d, 1, 5)).otherwise("")


def zip5_run(c: Column) -> Column:
    """The first run of five digits."""
    return F.regexp_extract(text(c), r"[0-9]{5}", 0)


def reported_id_reason(c: Column) -> Column:
    """'ok', or why a reported nine-digit id can't be used."""
    d = digits(c)
    repeated = F.regexp_replace(d, "^(.)\\1*$", "") == ""
    return (
        F.when(d == "", "reported_ein_blank")
        .when(F.length(d) != 9, F.concat(F.lit("reported_ein_invalid_length_"), F.length(d).cast("string")))
        .when(d.isin(*PLACEHOLDER_IDS) | repeated, "reported_ein_placeholder_value")
        .when(d.startswith("00"), "reported_ein_invalid_00_prefix")
        .otherwise("ok")
    )


def unspecific_name(name: Column) -> Column:
    """The reason of the first pattern that a name as matcher_name gives it fits, else empty."""
    out = F.when(name.rlike(UNSPECIFIC_RECIPIENTS[0][0]), UNSPECIFIC_RECIPIENTS[0][1])
    for pattern, reason in UNSPECIFIC_RECIPIENTS[1:]:
        out = out.when(name.rlike(pattern), reason)
    return out.otherwise("")


def unspecific_recipient(c: Column) -> Column:
    """The reason of the first pattern that the normalised name fits, else empty."""
    return unspecific_name(matcher_name(c))


def name_tokens(name: Column) -> Column:
    """Distinct words of three letters or more that aren't stop words, in order."""
    return F.array_distinct(F.filter(F.split(name, " "), lambda t: (F.length(t) >= 3) & ~t.isin(*NAME_STOPWORDS)))


def distinctive_tokens(name: Column, most: int = 5) -> Column:
    keep = F.filter(name_tokens(name), lambda t: (F.length(t) >= 4) & ~t.isin(*COMMON_NAME_WORDS))
    return F.slice(keep, 1, most)


def number(c: Column) -> Column:
    """Amounts with commas, dollar signs and parentheses for negatives; anything else is null."""
    bare = F.regexp_replace(F.trim(c.cast("string")), "[,$]", "")
    signed = F.regexp_replace(bare, r"^\((.*)\)$", "-$1")
    return F.when(signed.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), signed.cast("double"))


def boolean(c: Column) -> Column:
    v = F.lower(F.trim(c.cast("string")))
    return F.when(v.isin("y", "yes", "true", "t", "1", "x"), 1).when(v.isin("n", "no", "false", "f", "0"), 0)


def flexible_date(c: Column) -> Column:
    """The first of four written forms that fits."""
    v = F.trim(c.cast("string"))
    forms = (
        (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
        (r"^\d{8}$", "yyyyMMdd"), (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    )
    return F.coalesce(*(F.when(v.rlike(shape), F.try_to_date(v, form)) for shape, form in forms))


def yes_no(c: Column) -> Column:
    v = F.upper(F.trim(c.cast("string")))
    return F.when(v.isin("1", "X", "TRUE", "YES", "Y"), "Yes").when(v.isin("0", "FALSE", "NO", "N"), "No").otherwise("")


def stable_hash(*parts: Column, prefix: str = "") -> Column:
    """SHA-1 of the cleaned parts, joined by U+241F."""
    return F.concat(F.lit(prefix), F.sha1(F.concat_ws("␟", *(clean_text(p) for p in parts))))


def edge_id(*parts: Column) -> Column:
    """SHA-256 of the parts, joined by U+001F."""
    return F.sha2(F.concat_ws("\x1f", *(text(p) for p in parts)), 256)


def counterparty(name: Column, city: Column, state: Column, postal: Column) -> Column:
    """struct(counterparty_id, signature, strength) of the strongest key that the parts allow."""
    n, c, s, z = union_name(name), union_name(city), union_name(state), zip5_run(postal)
    signature = (
        F.when(z != "", F.concat_ws("|", F.lit("NAME_ZIP"), n, z))
        .when((c != "") & (s != ""), F.concat_ws("|", F.lit("NAME_CITY_STATE"), n, c, s))
        .otherwise(F.concat_ws("|", F.lit("NAME_ONLY"), n))
    )
    strength = F.when(z != "", "EXACT_NAME_ZIP5").when((c != "") & (s != ""), "EXACT_NAME_CITY_STATE").otherwise("NAME_ONLY")
    return F.struct(F.concat(F.lit("cp_"), F.substring(F.sha2(signature, 256), 1, 24)).alias("counterparty_id"), signature.alias("signature"), strength.alias("strength"))


def object_id(filing_id: Column) -> Column:
    return F.regexp_replace(filing_id, "(?i)_(public|private)$", "")


def uei(c: Column) -> Column:
    """Twelve letters and digits; the migration sentinel isn't one."""
    v = F.upper(F.regexp_replace(text(c), "[^A-Za-z0-9]", ""))
    return F.when((F.length(v) == 12) & (v != "GSAMIGRATION"), v)


def year_hint(c: Column) -> Column:
    """The first year from 1998 on that stands alone in a text."""
    found = F.regexp_extract_all(text(c), F.lit(r"(?<!\d)(19\d{2}|20\d{2})(?!\d)"), F.lit(1))
    return F.get(F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: y >= 1998), F.lit(0))
