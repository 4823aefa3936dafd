"""Decisions from three ways of writing, and the master file with and without headers."""

import json

import pytest

from filigree.operators import identity
from filigree.sources import decision_files, master_file

ONE = {"signature_hash": "S1", "output": {"decision": "SELECT_CANDIDATE", "candidate_id": "C1", "confidence": 0.95, "reason_codes": ["a", "b"], "needs_human_review": False}}
TWO = {"id": "S2", "decision": "NO_MATCH", "confidence": "n/a", "reason_codes": "x;y", "explanation": " two\n lines "}
THREE = {"model_output": json.dumps({"signature_hash": "S3", "decision": "HUMAN_REVIEW", "selected_candidate_id": "C9"}), "decision": "ignored"}
WANTED = {
    "S1": ("SELECT_CANDIDATE", "C1", 0.95, ["a", "b"], "", 0),
    "S2": ("NO_MATCH", "", None, ["x", "y"], "two lines", 1),
    "S3": ("HUMAN_REVIEW", "C9", None, [], "", 1),
}


def read(spark, path):
    got = decision_files.read_decisions(spark, f"file://{path}")
    rows = decision_files.decisions(got["rows"]).collect()
    return {r.signature: (r.decision, r.candidate_id, r.confidence, r.reason_codes, r.explanation, r.needs_human_review) for r in rows}, [r.raw for r in got["rejects"].collect()]


def test_lines(spark, tmp_path):
    text = "\ufeff" + "\n".join([json.dumps(ONE), "", json.dumps(TWO), "[1, 2]", "{broken", json.dumps(THREE)]) + "\n"
    (tmp_path / "d.jsonl").write_text(text, encoding="utf-8")
    got, bad = read(spark, tmp_path / "d.jsonl")
    assert got == WANTED and bad == ["[1, 2]", "{broken"]


@pytest.mark.parametrize("wrap", [lambda x: x, lambda x: {"records": x, "note": 1}])
def test_lists(spark, tmp_path, wrap):
    (tmp_path / "d.json").write_text(json.dumps(wrap([ONE, 5, TWO, THREE]), indent=1), encoding="utf-8-sig")
    got, bad = read(spark, tmp_path / "d.json")
    assert got == WANTED and bad == ["5"]
    (tmp_path / "e.json").write_text('{"other": []}')
    got, bad = read(spark, tmp_path / "e.json")
    assert got == {} and bad == ['{"other": []}']


def test_delimited(spark, tmp_path):
    (tmp_path / "d.csv").write_text('\ufeffsignature_hash,decision,candidate_id,confidence,reason_codes,explanation,needs_human_review\nS1,SELECT_CANDIDATE,C1,0.95,"[""a"", ""b""]",,no\nS2,NO_MATCH,,n/a,x;y," two\n lines ",\n', encoding="utf-8")
    got, bad = read(spark, tmp_path / "d.csv")
    assert got["S1"] == WANTED["S1"] and got["S2"][:5] == WANTED["S2"][:5] and bad == []


def test_master_file(spark, tmp_path):
    """One region with a header in another order, one without, one with a short row, one empty."""
    (tmp_path / "eo1.csv").write_text('\ufeffName,E I N,EIN,Tax Period,Street\n"Alpha, ""A""",x,100000001,202012,1 Main\n', encoding="utf-8")
    (tmp_path / "eo2.csv").write_text("100000002,BETA,% SOMEONE,2 MAIN,TOWN,NY,10001-0000,0,03,3,1000,199001,1,15,0,1,01,202112,1,1,01,0,12,5,6,7,B20,BETA SORT\n")
    (tmp_path / "eo3.csv").write_text("EIN,NAME,ASSET_AMT\n100000003,GAMMA\n")
    with pytest.raises(FileNotFoundError, match="eo4.csv"):
        master_file.read_master(spark, f"file://{tmp_path}")
    (tmp_path / "eo4.csv").write_text("")
    out = master_file.read_master(spark, f"file://{tmp_path}")
    rows = {r.source_file: r for r in out.collect()}
    assert out.columns == [*master_file.COLUMNS, "source_file"] and len(master_file.COLUMNS) == 28 and len(rows) == 3
    a, b, c = (rows[f"eo{i}.csv"] for i in (1, 2, 3))
    assert (a.ein, a.name, a.tax_period, a.street, a.city) == ("100000001", 'Alpha, "A"', "202012", "1 Main", "")
    assert (b.ein, b.ico, b.zip, b.revenue_amt, b.sort_name) == ("100000002", "% SOMEONE", "10001-0000", "7", "BETA SORT")
    assert (c.ein, c.name, c.asset_amt) == ("100000003", "GAMMA", "")
    known = {(r.ein, r.source, r.bmf_region) for r in identity.master_identities(out).collect()}
    assert known == {("100000001", "bmf_name", 1), ("100000002", "bmf_name", 2), ("100000002", "bmf_sort_name", 2), ("100000003", "bmf_name", 3)}
    assert master_file.read_master(spark, f"file://{tmp_path}/none", require=False).count() == 0
