"""Signatures that report a number, or name nobody in particular, decided before any adjudication.

A reported number wins unless the first match contradicts it; what it can't settle is reviewed, left out or passed on, as asked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.functions.similarity import ratio
from filigree.functions.text import clean_text, digits9, matcher_name, reported_id_reason, unspecific_name
from filigree.operators.sets import settled

# First-match warnings and statuses that speak against a reported number, warnings that don't, and sources by preference.
HARD_WARNINGS = ("reported_ein_and_name_match_different_known_eins",)
HARD_STATUSES = ("possible_bad_ein_corrected", "conflicting_ein_match")
SOFT_WARNINGS = ("reported_ein_name_disagrees", "reported_ein_points_to=", "multiple_eins_at_address", "address_unique_low_name_similarity")
SOURCE_ORDER = {"returns_org_name": 0, "bmf_name": 1, "returns_dba_name": 2, "bmf_sort_name": 3, "bmf_ico": 9}
OTHER_SOURCE = 5
LEAST_ADDRESS, AGREES, HIGH = 0.85, 0.72, 0.92

ACTIONS = {
    "placeholder": ("no_match", "human_review", "skip", "ollama"),
    "invalid": ("ollama", "no_match", "human_review", "skip"),
    "unsafe": ("human_review", "skip", "ollama"),
    "unverified": ("keep", "human_review", "skip", "ollama"),
}
DECIDED = (
    "struct<decision: string, candidate_id: string, selected_ein: string, selected_name: string, confidence: double, confidence_label: string, reason_codes: array<string>,"
    " needs_human_review: int, auto_accept: int, model_label: string, outcome: string, evidence_candidate_id: string, evidence_ein: string, evidence_name: string>"
)


def counted(text: Column, keys: tuple[str, ...]) -> Column:
    """Whether a JSON object counts any of the keys more than zero times; what isn't a number says yes unless it is empty or false."""
    held = F.from_json(F.coalesce(text, F.lit("{}")), "map<string, string>")

    def says(key: str) -> Column:
        value = F.trim(F.try_element_at(held, F.lit(key)))
        return F.coalesce(F.when(value.try_cast("double").isNotNull(), F.floor(F.abs(value.try_cast("double"))) * F.signum(value.try_cast("double")) > 0).otherwise(~value.isin("", "false", "null", "[]", "{}")), F.lit(False))

    return reduce(lambda a, b: a | b, (says(k) for k in keys))


def warned(flags: Column, marks: tuple[str, ...]) -> Column:
    said = F.lower(clean_text(flags))
    return reduce(lambda a, b: a | b, (said.contains(m) for m in marks))


def best_identities(identities: DataFrame) -> DataFrame:
    """(ein, display_name, name_norm, source) by which each number is best known: by source, its rank, the latest year, the key."""
    known = identities.where("trim(coalesce(display_name, '')) <> '' and ein <> ''")
    place = F.create_map(*(F.lit(x) for kv in SOURCE_ORDER.items() for x in kv))
    order = F.struct(F.coalesce(F.try_element_at(place, F.coalesce("source", F.lit(""))), F.lit(OTHER_SOURCE)), "source_rank", -F.coalesce("tax_year", F.lit(0)), "identity_key")
    return known.groupBy("ein").agg(F.min_by(F.struct("display_name", "name_norm", "source"), order).alias("r")).select("ein", "r.*")


def own_candidates(candidates: DataFrame) -> DataFrame:
    """The first candidate, by rank, of each signature and number, and whether its place is that of the signature."""
    placed = ((F.col("exact_address") == 1) | (F.col("address_score") >= LEAST_ADDRESS)) & (F.col("reported_ein_match") == 1) & ((F.col("zip_match") == 1) | (F.col("city_state_match") == 1))
    numbered = candidates.withColumn("ein", digits9(F.col("ein"))).where("ein <> ''")
    first = F.min_by(F.struct("candidate_id", "candidate_name", F.coalesce(F.col("exact_address") == 1, F.lit(False)).alias("exact"), F.coalesce(placed, F.lit(False)).alias("placed")), F.struct("candidate_rank", "candidate_id"))
    return numbered.groupBy("signature", "ein").agg(first.alias("own"))


def with_evidence(rows: DataFrame, counts: Column, identities: DataFrame, candidates: DataFrame) -> DataFrame:
    """rows (signature, ein, name_norm) with identity, own and name_score where the number counts, null elsewhere.

    A row whose number doesn't count asks for a key of its own that nothing has, so such rows are spread and no hot key; a number
    that very many rows report is joined with one row, which adaptive execution splits.
    """
    asked = rows.withColumn("__ask", F.when(counts, F.col("ein")).otherwise(F.concat(F.lit("-"), F.col("signature").cast("string"))))
    best = best_identities(identities).select(F.col("ein").alias("__ask"), F.struct("display_name", "name_norm", "source").alias("identity"))
    own = own_candidates(candidates).withColumnRenamed("ein", "__ask")
    known = asked.join(best, "__ask", "left").join(own, ["signature", "__ask"], "left").drop("__ask")
    return known.withColumn("name_score", ratio(F.col("name_norm"), F.coalesce("identity.name_norm", F.lit(""))))


def triaged(
    signatures: DataFrame, identities: DataFrame, candidates: DataFrame, *, least_name: float = 0.35, contradictions: bool = False, unverified_confidence: float = 0.935,
    placeholder: str = "no_match", invalid: str = "ollama", unsafe: str = "human_review", unverified: str = "keep",
) -> DataFrame:
    """The decision on each signature, null where it is passed on or left out, and its outcome, which says why.

    signatures: signature (unique), reported_ein, recipient_name, first_pass_warning_flags, first_pass_statuses_json.
    identities: as the identity layer has them. candidates: signature, candidate_id, candidate_rank, candidate_name, ein,
    reported_ein_match, exact_address, zip_match, city_state_match, address_score.

    A name that stands for nobody comes first, then numbers that can't be one, contradictions, a known number whose
    name agrees at least by `least_name`, one whose name doesn't but whose candidate is at the reported place,
    and a number that nobody knows. `placeholder`, `invalid`, `unsafe` and `unverified` choose among ACTIONS what
    becomes of names for nobody, of bad numbers, of known numbers whose name disagrees and of unknown ones. Decisions that choose nobody hold no
    candidate, number or name; what led to review is in the evidence columns. Nulls count as empty
    texts; without identities every number is unknown.
    """
    for name, value in (("placeholder", placeholder), ("invalid", invalid), ("unsafe", unsafe), ("unverified", unverified)):
        if value not in ACTIONS[name]:
            raise ValueError(f"{name} must be one of {', '.join(ACTIONS[name])}")

    # two barriers, because the patterns ask for the name, and the gates for their answer, many times
    rows = settled(
        signatures.select(
            "signature", clean_text(F.col("reported_ein")).alias("raw"), reported_id_reason(F.col("reported_ein")).alias("validity"), clean_text(F.col("recipient_name")).alias("name"),
            matcher_name(F.col("recipient_name")).alias("name_norm"), digits9(F.col("reported_ein")).alias("ein"),
            (warned(F.col("first_pass_warning_flags"), HARD_WARNINGS) | counted(F.col("first_pass_statuses_json"), HARD_STATUSES)).alias("hard"), warned(F.col("first_pass_warning_flags"), SOFT_WARNINGS).alias("soft"),
        )
    )
    rows = settled(rows.withColumn("nobody", unspecific_name(F.col("name_norm"))))
    counts = (F.col("nobody") == "") & (F.col("validity") == "ok") & (F.lit(contradictions) | ~F.col("hard"))
    both = with_evidence(rows, counts, identities, candidates)

    identity, own, score = F.col("identity"), F.col("own"), F.col("name_score")
    none, kept_id = F.lit(""), F.coalesce(own["candidate_id"], F.lit("REPORTED_EIN"))

    def codes(*parts: str | Column) -> Column:
        return F.array_compact(F.array(*(F.lit(p) if isinstance(p, str) else p for p in parts)))

    def passed(outcome: Column) -> Column:
        nothing = [F.lit(None)] * 10
        return F.struct(*nothing, outcome, *[F.lit(None)] * 3).cast(DECIDED)

    def kept(name: Column, confidence: Column, label: Column, reasons: Column, model: str, outcome: str) -> Column:
        return F.struct(F.lit("KEEP_REPORTED_EIN"), kept_id, F.col("ein"), name, confidence, label, reasons, F.lit(0), F.lit(1), F.lit(model), F.lit(outcome), none, none, none).cast(DECIDED)

    def refused(review: bool, reasons: Column, model: str, outcome: Column, seen: tuple[Column, Column, Column] = (none, none, none)) -> Column:
        decision, confidence, label = ("HUMAN_REVIEW", 0.0, "none") if review else ("NO_MATCH", 1.0, "high")
        return F.struct(F.lit(decision), none, none, none, F.lit(confidence), F.lit(label), reasons, F.lit(int(review)), F.lit(0), F.lit(model), outcome, *seen).cast(DECIDED)

    def suffixed(value: Column, action: str) -> Column:
        ends = {"ollama": "_allowed_to_ollama", "skip": "_skipped_no_ai", "no_match": "_no_match_no_ai", "human_review": "_human_review_no_ai"}
        return F.concat(value, F.lit(ends[action]))

    named = F.concat(F.lit("nonadjudicable_recipient_"), F.col("nobody"))
    if placeholder in ("ollama", "skip"):
        for_nobody = passed(suffixed(named, placeholder))
    else:
        said = F.col("raw") != ""
        reasons = codes("recipient_name_nonadjudicable", F.col("nobody"), "attachment_or_bulk_list_not_resolved", "ollama_skipped", F.when(said, "reported_ein_present"), F.when(said, F.col("validity")))
        for_nobody = refused(placeholder == "human_review", reasons, "rule:nonadjudicable_recipient_no_ai", named)

    if invalid in ("ollama", "skip"):
        bad_number = passed(suffixed(F.col("validity"), invalid))
    else:
        bad_number = refused(invalid == "human_review", codes("reported_ein_invalid", F.col("validity"), "ollama_skipped"), "rule:invalid_reported_ein_no_ai", suffixed(F.col("validity"), invalid), (none, none, F.col("name")))

    agrees = score >= AGREES
    reasons = codes(
        "reported_ein_present", "reported_ein_found_in_org_identity", clean_text(identity["source"]), F.when(F.col("soft"), "reported_ein_soft_warning_not_treated_as_hard_conflict"),
        F.when(agrees, "recipient_name_agrees").otherwise("recipient_name_weakly_agrees"), F.when(own.isNotNull(), "reported_ein_candidate_present"),
    )
    known = kept(clean_text(identity["display_name"]), F.when(agrees, 0.985).otherwise(0.94), F.lit("high"), reasons, "rule:reported_ein_identity_lookup", "shortcut_created")

    reasons = codes(
        "reported_ein_present", "reported_ein_known_but_name_disagrees", "reported_ein_candidate_present", "reported_ein_address_location_match", "recipient_name_may_be_alias_or_former_name",
        "ollama_skipped_nonconflicting_reported_ein",
    )
    at_place = kept(clean_text(own["candidate_name"]), F.when(own["exact"], 0.975).otherwise(0.965), F.lit("high"), reasons, "rule:reported_ein_address_location", "reported_ein_known_name_disagrees_address_location_kept_no_ai")

    if unsafe == "human_review":
        reasons = codes("reported_ein_present", "reported_ein_known_but_name_disagrees", "ollama_skipped_nonconflicting_reported_ein")
        disagrees = refused(True, reasons, "rule:reported_ein_no_ai_review", F.lit("reported_ein_known_name_disagrees_human_review_no_ai"), (kept_id, F.col("ein"), clean_text(identity["display_name"])))
    else:
        disagrees = passed(F.lit("recipient_name_disagrees_with_reported_ein_identity" if unsafe == "ollama" else "reported_ein_name_disagrees_skipped_no_ai"))

    if unverified == "keep":
        reasons = codes("reported_ein_present", "reported_ein_valid", "reported_ein_not_in_org_identity", "recipient_name_present", "reported_ein_from_filing_unverified", "ollama_skipped")
        label = F.lit("high" if unverified_confidence >= HIGH else "medium")
        unknown = kept(F.col("name"), F.lit(round(unverified_confidence, 4)), label, reasons, "rule:reported_ein_from_filing_unverified", "reported_ein_unknown_kept_unverified")
    elif unverified == "human_review":
        reasons = codes("reported_ein_present", "reported_ein_not_in_org_identity", "recipient_name_present", "ollama_skipped")
        unknown = refused(True, reasons, "rule:reported_ein_no_ai_review", F.lit("reported_ein_unknown_human_review_no_ai"), (kept_id, F.col("ein"), F.col("name")))
    else:
        unknown = passed(suffixed(F.lit("reported_ein_unknown"), unverified))

    out = (
        F.when(F.col("nobody") != "", for_nobody)
        .when(F.col("raw") == "", passed(F.lit("no_reported_ein")))
        .when(F.col("validity") != "ok", bad_number)
        .when(~counts, passed(F.lit("reported_ein_contradiction_flagged")))
        .when(identity.isNull(), unknown)
        .when(score >= least_name, known)
        .when(own["placed"], at_place)
        .otherwise(disagrees)
    )
    return settled(both.select("signature", out.alias("r"))).select("signature", "r.*")


def outcomes(decided: DataFrame) -> DataFrame:
    """How many signatures each outcome and model label has, and how many of them are accepted."""
    return decided.groupBy("outcome", F.coalesce("model_label", F.lit("")).alias("model_label")).agg(F.count("*").alias("n"), F.coalesce(F.sum("auto_accept"), F.lit(0)).alias("n_accepted"))
