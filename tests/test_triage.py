"""Reported numbers against the cases that a reviewer would ask about, one signature each."""

import pytest

from filigree.operators import triage

SIGNATURE = "signature string, reported_ein string, recipient_name string, first_pass_warning_flags string, first_pass_statuses_json string"
IDENTITY = "ein string, source string, source_rank int, tax_year int, display_name string, name_norm string, identity_key string"
CANDIDATE = (
    "signature string, candidate_id string, candidate_rank int, candidate_name string, ein string, reported_ein_match int, exact_address int, zip_match int, city_state_match int, address_score double"
)
KNOWN = [
    ("208899001", "bmf_name", 20, None, "Lantern Policy House", "LANTERN POLICY HOUSE", "b"),
    ("208899001", "returns_org_name", 10, 2020, "Harbour Trust Old", "HARBOUR TRUST OLD", "c"),
    ("208899001", "returns_org_name", 10, 2022, "Harbour Trust", "HARBOUR TRUST", "d"),
    ("208899001", "bmf_ico", 1, 2023, "A Person", "A PERSON", "e"),
    ("208899001", "returns_org_name", 1, 2024, " ", "", "f"),
]


def decide(spark, rows, candidates=(), known=KNOWN, **how):
    out = triage.triaged(spark.createDataFrame(rows, SIGNATURE), spark.createDataFrame(known, IDENTITY), spark.createDataFrame(list(candidates), CANDIDATE), **how)
    return {r.signature: r for r in out.collect()}


def test_known_numbers(spark):
    """The best identity is the latest of the best source; weak agreement counts, a soft warning doesn't, a hard one does."""
    rows = [
        ("same", "20-8899001", "The Harbour Trust, Inc.", None, None), ("weak", "208899001", "Harbour Fund for Song", "x;REPORTED_EIN_POINTS_TO=abc", "{}"), ("hard", "208899001", "Harbour Trust", "reported_ein_and_name_match_different_known_eins", ""),
        ("status", "208899001", "Harbour Trust", "", '{"possible_bad_ein_corrected": "3"}'), ("none", "208899001", "Harbour Trust", "", '{"possible_bad_ein_corrected": 0, "conflicting_ein_match": null}'), ("odd", "208899001", "Harbour Trust", "", "[1, 2"),
    ]
    got = decide(spark, rows)
    assert (got["same"].decision, got["same"].selected_name, got["same"].confidence, got["same"].candidate_id) == ("KEEP_REPORTED_EIN", "Harbour Trust", 0.985, "REPORTED_EIN")
    assert got["same"].reason_codes == ["reported_ein_present", "reported_ein_found_in_org_identity", "returns_org_name", "recipient_name_agrees"]
    assert got["weak"].confidence == 0.94 and "reported_ein_soft_warning_not_treated_as_hard_conflict" in got["weak"].reason_codes
    assert {k: got[k].outcome for k in ("hard", "status")} == dict.fromkeys(("hard", "status"), "reported_ein_contradiction_flagged")
    assert got["hard"].decision is None and got["none"].auto_accept == got["odd"].auto_accept == 1
    assert all(r.auto_accept == 1 for r in decide(spark, rows, contradictions=True).values())


def test_disagreeing_names_ask_for_the_place(spark):
    """A candidate with the number at the reported place settles it; the first of several counts, and none may lack its place."""
    rows = [(k, "208899001", "Quilting Bees", "", "") for k in ("exact", "near", "far", "nowhere", "first", "other", "no")]
    candidates = [
        ("exact", "C1", 1, "Harbour  Trust", "20-8899001", 1, 1, 1, 0, 0.1), ("near", "C2", 2, "Harbour", "208899001", 1, 0, 0, 1, 0.85), ("far", "C1", 1, "Harbour", "208899001", 1, 0, 1, 1, 0.2),
        ("nowhere", "C1", 1, "Harbour", "208899001", 1, 1, 0, 0, 1.0), ("first", "C1", 1, "Harbour", "208899001", None, 1, 1, 1, 1.0), ("first", "C2", 2, "Harbour", "208899001", 1, 1, 1, 1, 1.0), ("other", "C1", 1, "Else", "111222333", 1, 1, 1, 1, 1.0),
    ]
    got = decide(spark, rows, candidates)
    assert (got["exact"].candidate_id, got["exact"].selected_name, got["exact"].confidence) == ("C1", "Harbour Trust", 0.975)
    assert (got["near"].candidate_id, got["near"].confidence, got["near"].model_label) == ("C2", 0.965, "rule:reported_ein_address_location")
    for k in ("far", "nowhere", "first", "other", "no"):
        r = got[k]
        assert (r.decision, r.candidate_id, r.selected_ein, r.selected_name, r.auto_accept) == ("HUMAN_REVIEW", "", "", "", 0), k
        assert (r.evidence_candidate_id, r.evidence_ein, r.evidence_name) == ("REPORTED_EIN" if k in ("other", "no") else "C1", "208899001", "Harbour Trust")
    assert {r.outcome for r in decide(spark, rows[2:], candidates, unsafe="skip").values()} == {"reported_ein_name_disagrees_skipped_no_ai"}
    assert {r.outcome for r in decide(spark, rows[2:], candidates, unsafe="ollama").values()} == {"recipient_name_disagrees_with_reported_ein_identity"}


def test_names_for_nobody_come_first(spark):
    rows = [("list", "208899001", "See attached schedule", None, None), ("blank", None, None, None, None), ("zero", "0", "NETWORK OF 685 AGENCIES", "reported_ein_and_name_match_different_known_eins", None)]
    got = decide(spark, rows)
    assert all((r.decision, r.confidence, r.auto_accept, r.selected_ein) == ("NO_MATCH", 1.0, 0, "") for r in got.values())
    assert got["list"].reason_codes[-2:] == ["reported_ein_present", "ok"] and got["zero"].reason_codes[-1] == "reported_ein_invalid_length_1"
    assert got["blank"].reason_codes == ["recipient_name_nonadjudicable", "blank_recipient_name", "attachment_or_bulk_list_not_resolved", "ollama_skipped"]
    assert {r.decision for r in decide(spark, rows, placeholder="human_review").values()} == {"HUMAN_REVIEW"}
    assert all(r.decision is None and r.outcome.endswith("_skipped_no_ai") for r in decide(spark, rows, placeholder="skip").values())


def test_numbers_that_cannot_be_one(spark):
    rows = [("short", "12-34", "Real Name Society", "", ""), ("same", "777777777", "Real Name Society", "", ""), ("double", "001234567", "Real Name Society", "", ""), ("none", " ", "Real Name Society", "", "")]
    reasons = {"short": "reported_ein_invalid_length_4", "same": "reported_ein_placeholder_value", "double": "reported_ein_invalid_00_prefix"}
    assert {k: r.outcome for k, r in decide(spark, rows).items()} == {k: v + "_allowed_to_ollama" for k, v in reasons.items()} | {"none": "no_reported_ein"}
    for action, decision in (("human_review", "HUMAN_REVIEW"), ("no_match", "NO_MATCH")):
        got = decide(spark, rows, invalid=action)
        for k, reason in reasons.items():
            assert (got[k].decision, got[k].candidate_id, got[k].selected_ein, got[k].selected_name) == (decision, "", "", "")
            assert got[k].outcome.startswith(reason) and got[k].evidence_name == "Real Name Society"


def test_unknown_numbers(spark):
    rows = [("u", "305551234", "Real Name  Society", "", "")]
    got = decide(spark, rows, known=[])["u"]
    assert (got.decision, got.selected_name, got.confidence, got.confidence_label) == ("KEEP_REPORTED_EIN", "Real Name Society", 0.935, "high")
    assert decide(spark, rows, unverified_confidence=0.9)["u"].confidence_label == "medium"
    assert decide(spark, rows, unverified="human_review")["u"].evidence_ein == "305551234"
    assert decide(spark, rows, unverified="skip")["u"].outcome == "reported_ein_unknown_skipped_no_ai"
    assert decide(spark, []) == {}
    with pytest.raises(ValueError):
        decide(spark, rows, unverified="maybe")
