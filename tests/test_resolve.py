import pytest
from pyspark.sql import functions as F

from filigree.operators import inventory, resolve, screening, transport

INDEX = "ein string, name string, address string, city string, state string, zip5 string, tax_year int, filing_id string"
ROWS = "grant_id int, reported_ein string, name string, address string, city string, state string, zip5 string"


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        ("1", "ACME RELIEF", "1 MAIN ST", "X", "NY", "10001", 2020, "a"), ("1", "ACME", "1 MAIN ST", "X", "NY", "10001", 2019, "b"), ("2", "BETA HOUSE", "2 OAK AVE", "X", "NY", "10001", 2020, "c"),
        ("3", "TWIN", "3 ELM", "Y", "NJ", "07001", 2020, "d"), ("4", "TWIN", "4 ELM", "Y", "NJ", "07001", 2020, "e"), ("5", "GAMMA CENTER FOR ARTS", "2 OAK AVE", "Z", "CA", "90001", 2020, "f"),
    ]
    return spark.createDataFrame(rows, INDEX)


def test_tiers_in_order(spark, index):
    rows = [
        (1, "1", "ACME RELIEF INTL", "", "", "", ""), (2, "1", "", "", "", "", ""), (3, "", "BETA HOUSE", "", "", "", "10001"), (4, "", "BETTA HOUZE", "2 OAK AVE", "", "", "10001"), (5, "", "TWIN", "", "Y", "NJ", ""),
        (6, "", "GAMMA CENTER FOR ARTS", "", "", "", ""), (7, "2", "ACME RELIEF", "", "X", "NY", ""), (8, "", "GAMMA CENTRE FOR ARTS", "", "Z", "CA", ""), (9, None, None, None, None, None, None),
    ]
    rows += [(10, "99", "BETA HOUSE", "", "", "", "10001"), (11, "", "ACME RELIEV", "2 ELM", "", "", "10001"), (12, "", "GAMMA CENTER FOR THE ARTS", "2 OAK AVE", "", "", "")]
    rows += [(13, "", "GAMMA CENTER OF ARTS", "5 PINE", "Q", "CA", ""), (14, "", "GAMMA CENTER FOR ARTZ", "9 ASH", "", "", "20002"), (15, "", "NOTHING ALIKE", "9 ASH", "", "", "20002")]
    shared = [("6", "GAMMA CENTER FOR ART", "9 ASH", "P", "TX", "20002", 2020, "g"), ("7", "DELTA CLUB", "9 ASH", "P", "TX", "20002", 2020, "h")]
    out = resolve.resolve(spark.createDataFrame(rows, ROWS), index.unionByName(spark.createDataFrame(shared, INDEX)), fuzzy=True).collect()
    got = {r.grant_id: (r.resolved_ein, r.method, r.confidence, r.status) for r in out}
    said = {r.grant_id: r.warnings for r in out}
    assert got[1] == ("1", "reported_ein_known_name_agrees", 0.99, "ein_exact") and got[2] == ("1", "reported_ein_known_no_name_to_validate", 0.92, "ein_exact")
    assert got[3] == ("2", "name_zip_exact", 0.97, "name_address_high_confidence") and got[4][:2] == ("2", "address_zip_unique") and got[4][3] == "address_unique"
    assert got[4][2] == pytest.approx(0.95) and said[4] == []  # similar from 0.72 on: 0.05 more
    assert got[5] == (None, "none", 0.0, "unresolved") and got[6] == ("5", "name_unique_national_exact", 0.88, "name_exact")
    assert got[7] == ("1", "name_city_state_exact", 0.95, "possible_bad_ein_corrected") and said[7] == ["reported_ein_name_disagrees", "reported_ein_points_to=BETA HOUSE"]
    assert got[8][:2] == ("5", "fuzzy_name_within_city_state") and 0.88 < got[8][2] <= 0.93 and got[8][3] == "fuzzy_probable" and got[9][3] == "unresolved"
    assert got[10] == ("2", "name_zip_exact", 0.97, "reported_ein_not_found_name_matched") and said[10] == ["reported_ein_not_found_in_returns"]
    assert got[13][:2] == ("5", "fuzzy_name_within_state") and got[14][1] == "address_zip_name_within_address" and got[14][3] == "address_narrowed_name_match" and said[14] == ["multiple_eins_at_address"]
    assert got[15][0] is None and said[15] == ["multiple_eins_at_address"]


def test_candidates_and_decisions(spark, index):
    identities = index.withColumn("identity_id", F.row_number().over(__import__("pyspark").sql.Window.orderBy("filing_id"))).withColumn("source_rank", F.lit(4))
    s = spark.createDataFrame([("s1", "", "ACME RELIEF", "1 MAIN ST", "X", "NY", "10001"), ("s2", "3", "TWIN", "", "Y", "NJ", "")], "signature string, " + ROWS.split(", ", 1)[1])
    got = resolve.candidates(s, identities)
    best = {(r.signature, r.rank): (r.ein, r.cs) for r in got.collect()}
    assert best[("s1", 1)] == ("1", 45 + 30 + 16 + 12 + 11.0) and best[("s2", 1)] == ("3", 65 + 45 + 12 + 11.0) and best[("s2", 2)][0] == "4"
    told = [("s1", "SELECT_CANDIDATE", "1", 0.95), ("s1", "SELECT_CANDIDATE", "9", 0.95), ("s1", "SELECT_CANDIDATE", None, 0.9), ("s2", "NO_MATCH", "3", 0.9), ("s2", "HUMAN_REVIEW", None, 0.5), ("s2", "MAYBE", None, 0.5), ("s2", "NO_MATCH", None, 1.5)]
    checked = resolve.validated(spark.createDataFrame(told, "signature string, decision string, selected_ein string, confidence double"), got)
    assert sorted(r.validation_status for r in checked.collect()) == sorted(["ok", "ein_not_a_candidate", "selection_without_ein", "identity_without_selection", "ok", "unknown_decision", "confidence_out_of_range"])
    members = spark.createDataFrame([("s1", 1), ("s1", 2), ("s2", 3)], "signature string, grant_id int")
    assert sorted((r.grant_id, r.selected_ein) for r in resolve.applied(checked, members).collect()) == [(1, "1"), (2, "1")]
    assert resolve.without_leaked_identity(checked).where("decision = 'NO_MATCH' and selected_ein is not null").count() == 0
    assert {r.reported_ein: r.best for r in resolve.with_names(s.select("reported_ein"), identities, "reported_ein", "best").collect()} == {"": None, "3": "TWIN"}


def test_inventory(spark):
    files = [("a/x.xml", "1", b"<a p='1' q='2'> <b/></a>"), ("old/a/x.xml", "1", b'<a q="2" p="1"><b></b></a>'), ("y.xml", "2", b"<a/>"), ("b/y.xml", "2", b"<c/>"), ("z.xml", "3", b"<broken")]
    df = spark.createDataFrame(files, "path string, object_id string, content binary").withColumn("sha256", F.sha2("content", 256)).withColumn("canonical_sha256", inventory.canonical_xml_sha256("content"))
    got = {r.path: (r.duplicate_status, r.keep) for r in inventory.with_primaries(df).collect()}
    assert got == {"a/x.xml": ("equivalent", True), "old/a/x.xml": ("equivalent", False), "y.xml": ("object_id_conflict", False), "b/y.xml": ("object_id_conflict", False), "z.xml": ("unique", True)}
    loaded = spark.createDataFrame([("y.xml", "f2", "2")], "source_file string, filing_id string, object_id string")
    assert sorted(r.path for r in inventory.to_load(df, loaded).collect()) == ["a/x.xml", "z.xml"]
    assert {r.path: (r.loaded_exact, r.loaded_object) for r in inventory.source_audit(df, loaded).where("object_id = '2'").collect()} == {"y.xml": ("f2", "f2"), "b/y.xml": (None, "f2")}


def test_screening(spark):
    cases = [("NY", "X", [("X", "NY", "US")], "exact"), ("NY", None, [(None, "NY", None)], "exact"), ("NY", "X", [(None, "NY", None)], "partial"), ("NY", None, [("X", "NJ", None)], "conflict"), ("NY", None, [(None, None, None)], "unknown"), (None, None, [("X", "NY", "US")], "not_requested")]
    df = spark.createDataFrame([(r, c, a) for r, c, a, _ in cases], "region string, city string, addresses array<struct<city:string,region:string,country:string>>")
    got = df.select(screening.location_evidence(F.col("city"), F.col("region"), F.lit(None).cast("string"), F.col("addresses")).alias("e")).collect()
    assert [r.e for r in got] == [w for *_, w in cases]
    entities = spark.createDataFrame([(1, "A B"), (2, "C")], "entity_id int, name_norm string")
    aliases = spark.createDataFrame([(1, "A B"), (2, "A B")], "entity_id int, name_norm string")
    hits = screening.name_candidates(spark.createDataFrame([("A B",), ("",)], "name_norm string"), entities, aliases)
    assert sorted((r.entity_id, r.is_alias) for r in hits.collect()) == [(1, 0), (2, 1)]


def test_transport(spark):
    assert transport.max_flow([2, 1], [1, 2], {(0, 0), (0, 1), (1, 0)}) == 3
    assert transport.max_flow([3], [1, 1], {(0, 0)}) == 1
    source = spark.createDataFrame([(1, "null", 2), (1, "a", 1), (2, "null", 1)], "filing_id int, payload string, n int")
    repaired = spark.createDataFrame([(1, "0", 2), (1, "a", 1), (2, "7", 1)], "filing_id int, payload string, n int")
    rule = spark.createDataFrame([("null", "0")], "source_payload string, repaired_payload string")
    assert {r.filing_id: r.explained for r in transport.transform_explained(source, repaired, rule).collect()} == {1: True, 2: False}


def test_a_key_that_many_identities_have_is_told_whole(spark):
    keys = "reported_ein string, name string, address string, city string, state string, zip5 string"
    identities = spark.range(300).select(
        F.col("id").alias("identity_id"), F.lit(1).alias("source_rank"), F.lit(2000).alias("tax_year"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("ein"), F.lit("TWIN").alias("name"),
        *(F.lit(None).cast("string").alias(c) for c in ("address", "city")), F.when(F.col("id") < 200, "NY").alias("state"), F.when(F.col("id") < 90, "10001").alias("zip5"),
    )
    s = spark.createDataFrame([("s1", "e250", "TWIN", None, None, "NY", "10001"), ("s2", None, "TWIN", None, None, None, None), ("s3", None, "ALONE", None, None, None, None)], "signature string, " + keys)
    assert resolve.lookups(s, identities).where("signature = 's2'").count() == 75  # the limit of a key, which the rows below don't have
    rows = resolve.postings(s, identities).cache()
    mine, theirs = rows.where("side = 'signature'"), rows.where("side = 'identity'")
    pairs = mine.alias("a").join(theirs.alias("b"), ["lookup", "key"]).select(F.col("a.id").alias("signature"), F.col("b.id").cast("long").alias("identity_id")).distinct()
    assert {(r.signature, r.identity_id) for r in pairs.collect()} == {(k, n) for k in ("s1", "s2") for n in range(300)}
    assert {(r.id, r.lookup, r.n) for r in mine.collect()} == {("s1", 1, 1), ("s1", 4, 90), ("s1", 8, 200), ("s1", 9, 300), ("s2", 9, 300)}
    assert {(r.lookup, r.n) for r in theirs.collect()} == {(1, 1), (4, 1), (8, 1), (9, 2)}
    rows.unpersist()
