"""Metadata files drive the pipe reader: two years whose columns differ."""

import hashlib
import json

import pytest

from filigree.sources import metadata

OLD = "Columns of the table\nRPT_ID  NOT NULL  INTEGER\nUNION_NAME NULL VARCHAR\nCODE NULL VARCHAR\nFILED NULL DATE\n"
NEW = "\ufeffRPT_ID NOT NULL NUMBER\r\nUNION_NAME NULL VARCHAR\r\nPURPOSE NULL TEXT\r\nSTAMP NULL timestamp\r\n"


@pytest.fixture
def root(tmp_path):
    for year, meta, rows in (
        (2020, OLD, "RPT_ID|UNION_NAME|CODE|FILED\n1|Local | Nine|A|2020-01-02\n2|Plain|B|\n|No id|C|2020-01-02\n4|x|A|B|02/03/2020\n"),
        (2021, NEW, "RPT_ID|UNION_NAME|PURPOSE|STAMP\n7|Local\nTwo|rent|2021-02-03T04:05:06\n8|a|b|c|2021-02-03\n"),
    ):
        (tmp_path / str(year)).mkdir()
        (tmp_path / str(year) / "LM_meta.txt").write_text(meta, encoding="utf-8", newline="")
        (tmp_path / str(year) / f"lm_data_{year}.txt").write_text(rows)
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "lm_meta.txt").write_text("X NULL TEXT\n")
    return tmp_path


def test_columns_and_their_hash(spark, root):
    columns = metadata.columns_of(spark, str(root))
    got = [(r.year, r.position, r.name, r.type, r.nullable, r.kind) for r in columns.orderBy("year", "position").collect()]
    assert got[:4] == [(2020, 0, "RPT_ID", "INTEGER", False, "int"), (2020, 1, "UNION_NAME", "VARCHAR", True, "text"), (2020, 2, "CODE", "VARCHAR", True, "code"), (2020, 3, "FILED", "DATE", True, "date")]
    assert [g[2:] for g in got[4:]] == [("RPT_ID", "NUMBER", False, "int"), ("UNION_NAME", "VARCHAR", True, "text"), ("PURPOSE", "TEXT", True, "text"), ("STAMP", "TIMESTAMP", True, "timestamp")]
    plain = [["RPT_ID", "INTEGER", False, 0], ["UNION_NAME", "VARCHAR", True, 1], ["CODE", "VARCHAR", True, 2], ["FILED", "DATE", True, 3]]
    hashes = {r.year: (r.n_columns, r.schema_hash) for r in metadata.schema_hash(columns).collect()}
    assert hashes[2020] == (4, hashlib.sha256(json.dumps(plain, separators=(",", ":")).encode()).hexdigest())


def test_records_of_both_years(spark, root):
    """Pipes are repaired in free texts only, line breaks joined, and columns that a year lacks are null."""
    rows = metadata.read_table(spark, str(root), metadata.columns_of(spark, str(root)), "lm").collect()
    good = {r.rpt_id: r for r in rows if r.error is None}
    assert set(good) == {"1", "2", "7"}
    assert (good["1"].union_name, good["1"].code, good["1"].repair, good["1"].purpose, good["1"].year) == ("Local | Nine", "A", "LITERAL_PIPE", None, 2020)
    assert (good["7"].union_name, good["7"].stamp, good["7"].repair, good["7"].year) == ("Local Two", "2021-02-03T04:05:06", "LINE_BREAK", 2021)
    assert len([r for r in rows if r.error]) == 3  # no id, a date that is none, two ways to repair


def test_what_is_missing(spark, root):
    assert {r.year for r in metadata.columns_of(spark, str(root), [2021]).collect()} == {2021}
    with pytest.raises(FileNotFoundError, match="2019"):
        metadata.columns_of(spark, str(root), [2019, 2020])
    (root / "2021" / "bad_meta.txt").write_text("nothing here\n")
    with pytest.raises(ValueError, match="bad_meta"):
        metadata.columns_of(spark, str(root))
    with pytest.raises(KeyError):
        metadata.read_table(spark, str(root), metadata.columns_of(spark, str(root), [2020]), "other")
    assert [metadata.table_name(n) for n in ("AR_Rates", "2 b", "a b.")] == ["ar_rates", "t_2_b", "a_b"]
