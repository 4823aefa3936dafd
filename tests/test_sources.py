import json

import pytest
from pyspark.sql import functions as F

from filigree.sources import delimited, html_pages, sinks, xml_filing
from filigree.sources.pipe_records import Field, parsed, read_files, split_record
from filigree.streaming.append import follow

FIELDS = (Field("a", "int", False), Field("t", "text"), Field("d", "date"), Field("u", "text"))


def test_literal_pipes():
    assert split_record("1|x|2020-01-01|y", FIELDS) == (["1", "x", "2020-01-01", "y"], "")
    assert split_record("1|x|z|2020-01-01|y", FIELDS) == (["1", "x|z", "2020-01-01", "y"], "LITERAL_PIPE")
    assert split_record("1|x", FIELDS)[0] is None
    assert split_record("q|x|2020-01-01|y", FIELDS)[0] is None
    assert "2 repairs" in split_record("1|a|b|c", (Field("i", "int"), Field("x", "text"), Field("y", "text")))[1]


def test_parsed_and_files(spark, tmp_path):
    df = parsed(spark.createDataFrame([("1|x||y",), ("x",), (None,)], "value string"), FIELDS)
    assert [(r.a, r.t, r.d, r.error is None) for r in df.collect()] == [(1, "x", None, True), (None, None, None, False), (None, None, None, False)]
    (tmp_path / "f.txt").write_text("a|t|d|u\n1|x|2020-01-01|y\n2|two\nlines|2020-01-02|z\n")
    got = read_files(spark, f"file://{tmp_path}", FIELDS).collect()
    assert [(r.a, r.t, r.repair) for r in got] == [("1", "x", ""), ("2", "two lines", "LINE_BREAK")]


def test_xml(spark, tmp_path):
    layout = xml_filing.Layout({"ein": ("H/EIN",), "year": ("H/TaxYr", "H/Yr")}, ("ein", "year"), {"grants": ("D/*/G", {"name": ("N/L1", "N"), "cash": ("C",)})})
    (tmp_path / "a.xml").write_text('<R xmlns="u"><H><EIN>1</EIN><Yr>2020</Yr></H><D><S><G><N><L1>x</L1></N><C>5</C></G><G><C> </C></G></S></D></R>')
    (tmp_path / "b.xml").write_text("<R><H><EIN>2</EIN></H></R>")
    (tmp_path / "c.xml").write_text("<R>")
    df = xml_filing.read_filings(spark, f"file://{tmp_path}", layout)
    assert [r.error is None for r in df.orderBy("path").collect()] == [True, False, False]
    assert [tuple(r) for r in xml_filing.child_rows(df, "grants", "ein").collect()] == [("1", 0, "x", "5")]


def test_delimited(spark, tmp_path):
    (tmp_path / "f.csv").write_text('Report ID,"EIN"\n1,"a ""b"""\n,x\n')
    df = delimited.read_delimited(spark, str(tmp_path / "f.csv"), {"report_id": (), "auditee": ("ein",), "other": ()}, required=("report_id",), parse={"report_id": lambda c: c.cast("int")})
    good, bad = delimited.with_rejects(df, F.col("report_id").isNotNull())
    assert [tuple(r) for r in good.collect()] == [(1, 'a "b"', None)] and bad.count() == 1


def test_html(spark):
    page = "<html><title>A &amp; B</title><script>var t='<p>no</p>'</script><p>one <a href='/x'>two</a></p><p></p></html>"
    rows = html_pages.extracted(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).collect()
    assert [tuple(r) for r in rows] == [(1, "A & B", 1, 1, "one two"), (2, "", 0, 0, "")]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    assert sorted(tuple(r) for r in sinks.upserted(old, new, ["k"], [F.desc("v")]).collect()) == [(1, "a"), (2, "c"), (3, "e")]
    assert sorted(tuple(r) for r in sinks.first_wins(old, new, ["k"], [F.col("v")]).collect()) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(tuple(r) for r in sinks.replaced_children(old, new, "k").collect()) == [(1, "a"), (2, "c"), (3, "d"), (3, "e")]
    target = f"file://{tmp_path}/t"
    for df in (old, new):
        sinks.publish(df, target, lambda d: d.count())
    assert spark.read.parquet(target).count() == 3

    def refuse(df):
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        sinks.publish(old, target, refuse)
    assert spark.read.parquet(target).count() == 3  # what was there stays
    sinks.export_csv(old, f"file://{tmp_path}/csv")
    assert sorted(tuple(r) for r in spark.read.csv(f"file://{tmp_path}/csv", header=True).collect()) == [("1", "a"), ("2", "b")]
    sinks.export_batches(spark.range(25), f"file://{tmp_path}/b", ["id"], 10)
    sizes = [len([json.loads(x) for f in p.glob("*.json") for x in f.read_text().splitlines()]) for p in sorted((tmp_path / "b").glob("batch=*"))]
    assert sizes == [10, 10, 5]


def test_stream_appends_each_key_once(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    for rows in (df, df.where("k = 2").unionByName(spark.createDataFrame([(3, "c")], "k int, v string"))):
        rows.write.mode("append").parquet(source)
        follow(spark, source, df.schema, target, "k", f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_tags_and_scoped_amounts(spark):
    assert xml_filing.tags("cash_grant_amt") == ("CashGrantAmt",) and xml_filing.tags("recipient_ein") == ("RecipientEin", "RecipientEIN", "EIN")
    xml = b"<r><A><FilingOrganizationsTotalAmt>1</FilingOrganizationsTotalAmt></A><TotalLobbyingExpendGrp><z><FILINGOrganizationsTotalAmt>2</FILINGOrganizationsTotalAmt></z></TotalLobbyingExpendGrp><PoliticalExpendituresAmt> </PoliticalExpendituresAmt><q><PoliticalExpendituresAmt>5</PoliticalExpendituresAmt></q></r>"
    header, _, error = xml_filing.parse(xml, xml_filing.Layout(header=xml_filing.schedule_c("political_expenditures_amt")))
    assert error is None and header["total_lobbying_expend_grp_amt"] == "2" and header["total_direct_lobbying_amt"] is None and header["political_expenditures_amt"] == "5"


def test_placeholder_grants(spark):
    """Zero alone isn't a grant; zero with anything else is, and so is a row without an amount."""
    rows = [("a", "0", None), ("b", "0.00", " "), ("c", "0", "x"), ("d", None, "y"), ("e", None, ""), ("f", "5", None), ("g", "none", None)]
    df = spark.createDataFrame(rows, "filing_id string, cash_grant_amt string, purpose string")
    assert sorted(r.filing_id for r in xml_filing.without_placeholders(df).collect()) == ["c", "d", "f", "g"]
