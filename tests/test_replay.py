from filigree.operators import replay

SCHEMA = "filing_id int, name string, cash string, other string"


def outcome(spark, source, repaired):
    out = replay.explained(spark.createDataFrame(source, SCHEMA), spark.createDataFrame(repaired, SCHEMA), ["name", "cash", "other"], filled=["cash", "other"], amount="cash").collect()
    return {r.filing_id: (r.n_equal, r.n_to_zero, r.n_to_number, r.n_placeholders, r.left_source, r.left_repaired, r.replay_factor, r.status) for r in out}


def test_allowed_changes(spark):
    source = [(1, "a", "1", None), (2, "a", None, "x"), (3, "a", None, "x"), (4, None, "0", None), (4, "b", "2", "y"), (5, "a", "1", None), (6, "a", None, None), (8, None, "0.00", " "), (9, "a", "1", "x"), (9, "a", "1", "x"), (10, None, None, None)]
    repaired = [(1, "a", "1", None), (2, "a", "0", "x"), (3, "a", "7", "x"), (4, "b", "2", "y"), (5, "a", "2", None), (6, "a", "5", "0"), (7, "n", "1", None), (9, "a", "1", "x"), (10, None, None, "word")]
    got = outcome(spark, source, repaired)
    assert got[1] == (1, 0, 0, 0, 0, 0, None, "equal") and got[2] == (0, 1, 0, 0, 0, 0, None, "explained") and got[3] == (0, 0, 1, 0, 0, 0, None, "explained")
    assert got[4] == (1, 0, 0, 1, 0, 0, None, "explained") and got[5] == (0, 0, 0, 0, 1, 1, None, "unexplained") and got[6] == (0, 0, 1, 0, 0, 0, None, "explained")
    assert got[7] == (0, 0, 0, 0, 0, 1, None, "unexplained") and got[8] == (0, 0, 0, 1, 0, 0, None, "explained") and got[9] == (1, 0, 0, 0, 1, 0, 2, "replayed") and got[10] == (0, 0, 0, 0, 1, 1, None, "unexplained")
    assert outcome(spark, [], []) == {}


def test_competing_rows_are_placed_as_well_as_can_be(spark):
    """Two rows miss both values, one only the second: taken greedily, the first might use up what the other needs."""
    source = [(1, "a", None, None), (1, "a", "3", None)]
    repaired = [(1, "a", "3", "4"), (1, "a", "9", "9")]
    assert outcome(spark, source, repaired)[1] == (0, 0, 2, 0, 0, 0, None, "explained")
    assert outcome(spark, source * 2, repaired * 2 + [(1, "a", "3", "5")])[1] == (0, 0, 4, 0, 0, 1, None, "unexplained")
    mixed = outcome(spark, [(1, "a", None, "1"), (1, "a", None, None)], [(1, "a", "0", "1"), (1, "a", "0", "0")])
    assert mixed[1] == (0, 2, 0, 0, 0, 0, None, "explained")


def test_columns_are_told_apart(spark):
    """A separator inside a text doesn't make rows alike whose columns differ."""
    schema = "filing_id int, name string, other string, cash string"
    source, repaired = spark.createDataFrame([(1, "x\x1f=y", "z", None)], schema), spark.createDataFrame([(1, "x", "y\x1f=z", "0")], schema)
    row = replay.explained(source, repaired, ["name", "other", "cash"], filled=["cash"], amount="cash").first()
    assert (row.n_to_zero, row.left_source, row.left_repaired, row.status) == (0, 1, 1, "unexplained")
