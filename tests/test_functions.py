import pytest
from pyspark.sql import functions as F

from filigree.functions import text as t
from filigree.functions.similarity import ratio


def values(spark, expression, rows):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (t.resolver_name, ["The Acme & Sons, Inc.", "THE", None, "Foo Corp LLC", "Center for Co-op"], ["ACME AND SONS", "", "", "FOO", "CENTER FOR CO OP"]),
        (t.matcher_name, ["St. Mary Univ", "The Natl Assn of X Inc"], ["SAINT MARY UNIVERSITY", "NATIONAL ASSOCIATION OF X"]),
        (t.union_name, ["Teamsters Local No. 12", "local #7", "A&B Inc"], ["TEAMSTERS LOCAL 12", "LOCAL 7", "A AND B INC"]),
        (t.network_name, ["José O'Neil", None], ["JOSE O NEIL", ""]),
        (t.screening_name, ["ﬁrst José & co", "a_b"], ["FIRST JOSÉ AND CO", "A_B"]),
        (t.street, ["12 Main Street, Suite 4", "North Road"], ["12 MAIN ST STE 4", "NORTH RD"]),
        (t.digits9, ["12-3456789", "123", None], ["123456789", "", ""]),
        (t.zip5, ["1-2345-678", "12"], ["12345", ""]),
        (t.zip5_run, ["1-2345-678", "x 12345-6"], ["", "12345"]),
        (t.reported_id_reason, ["12-3456788", "", "12", "999999999", "123456789", "001234567"], ["ok", "reported_ein_blank", "reported_ein_invalid_length_2", "reported_ein_placeholder_value", "reported_ein_placeholder_value", "reported_ein_invalid_00_prefix"]),
        (t.unspecific_recipient, ["See attached list", "National Multiple Sclerosis Society", "Various local charities", "", "N/A"], ["see_schedule_or_attachment", "", "various_recipients_placeholder", "blank_recipient_name", "na_placeholder"]),
        (t.number, ["$1,234.50", "(12)", "n/a", "", "abc", None], [1234.5, -12.0, None, None, None, None]),
        (t.boolean, ["Yes", "x", "F", "0", "?"], [1, 1, 0, 0, None]),
        (t.uei, ["abc-123-def-456", "GSA_MIGRATION", "x"], ["ABC123DEF456", None, None]),
        (t.year_hint, ["audit 1997 to 2003", "12345"], [2003, None]),
        (t.object_id, ["123_public", "123_PRIVATE", "9"], ["123", "123", "9"]),
    ],
)
def test_normalisers(spark, f, given, wanted):
    assert values(spark, f, given) == wanted


def test_dates(spark):
    got = values(spark, lambda c: t.flexible_date(c).cast("string"), ["2020-02-03", "2/3/2020", "20200203", "03-Feb-2020", "00000000", "soon", None])
    assert got == ["2020-02-03"] * 4 + [None] * 3


def test_counterparty_uses_the_strongest_key(spark):
    df = spark.createDataFrame([("A Inc", "X", "NY", "12345"), ("A Inc", "X", "NY", None), ("A Inc", None, None, None)], "n string, c string, s string, z string")
    rows = df.select(t.counterparty(F.col("n"), F.col("c"), F.col("s"), F.col("z")).alias("p")).select("p.*").collect()
    assert [r.strength for r in rows] == ["EXACT_NAME_ZIP5", "EXACT_NAME_CITY_STATE", "NAME_ONLY"]
    assert rows[0].signature == "NAME_ZIP|A INC|12345" and len({r.counterparty_id for r in rows}) == 3


def test_ratio_keeps_order_and_edges(spark):
    df = spark.createDataFrame([("abcd", "bcde"), ("", "x"), ("a", "a"), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(ratio("a", "b")).collect()] == [0.75, 0.0, 1.0, 0.0]
