import random

from pyspark.sql import functions as F

from filigree.operators import identity, network, union_match

ORG = "f_num long, display_name string, union_name string, unit_name string, city string, state string, zip string"
RET = "ein string, org_name string, dba_name string, city string, state string, zip string"
HAND = "seq long, f_num string, action string, ein string, note string"


def matches(spark, orgs, returns, hand=()):
    o = spark.createDataFrame(orgs, ORG)
    c = union_match.identity_candidates(spark.createDataFrame(returns, RET), union_match.name_variants(o))
    out = union_match.matched(o, c, spark.createDataFrame(list(hand), HAND))
    chosen = {r.f_num: r.candidate_ein for r in union_match.accepted(out).collect()}
    return {(r.f_num, r.candidate_ein, r.match_method): r.match_status for r in out.collect()}, chosen


TEACHERS = (1, "Teachers Local #5", None, None, "Rome", "NY", "13440-1")


def test_places_decide_and_ambiguity_stays_open(spark):
    one = [("11", "TEACHERS LOCAL NO. 5", None, "X", "ZZ", "13440"), ("11", "Teachers Local 5", None, "Rome", "NY", ""), ("12", "Other", "Teachers  Local Number 5", "Utica", "NY", ""), ("13", "Teachers Local 5", None, "Q", "Q", "")]
    found, chosen = matches(spark, [TEACHERS], one)
    assert found[1, "11", "EXACT_NAME_ZIP5"] == found[1, "11", "EXACT_NAME_CITY_STATE"] == "MATCHED_HIGH_CONFIDENCE" and chosen == {1: "11"}
    assert found[1, "12", "EXACT_NAME_STATE_REVIEW"] == found[1, "13", "EXACT_NAME_LOCATION_MISMATCH"] == "CANDIDATE_REVIEW"
    both = [*one, ("14", "Teachers Local 5", None, "Rome", "NY", "")]
    found, chosen = matches(spark, [TEACHERS], both)
    assert set(found.values()) == {"CANDIDATE_REVIEW"} and chosen == {}
    found, chosen = matches(spark, [TEACHERS], both, [(1, "1", "Reject", "14", "")])
    assert found[1, "14", "EXACT_NAME_CITY_STATE"] == "REJECTED_MANUAL" and chosen == {1: "11"}


def test_overrides_come_last(spark):
    returns = [("11", "Teachers Local 5", None, "Rome", "NY", "")]
    found, chosen = matches(spark, [TEACHERS], returns, [(1, "1", "unmatch", "", "no"), (2, "x", "accept", "11", ""), (3, "77", "accept", "11", "")])
    assert chosen == {} and found[1, None, "MANUAL_UNMATCH"] == "UNMATCHED" and found[1, "11", "EXACT_NAME_CITY_STATE"] == "CANDIDATE_REVIEW" and len(found) == 2
    found, chosen = matches(spark, [TEACHERS, (2, "Nobody", "", "", "", "", "")], returns, [(1, "1", "accept", "99-9", ""), (2, "1", "accept", "11", "")])
    assert chosen == {1: "11"} and found[1, "999", "MANUAL_ACCEPT"] == "MATCHED_MANUAL" and found[2, None, "NO_EXACT_NAME_CANDIDATE"] == "UNMATCHED"


def test_hubs_after_three_rounds_equal_a_full_build(spark):
    r = random.Random(3)
    schema = "filing int, target_key string, source_ein string, tax_year int"

    def edges(filings):
        return [(f, f"{k}:{r.randint(0, 6)}", f"e{r.randint(0, 70)}", r.choice((2019, 2020, None))) for f in filings for k in ("person", "address", "ein") for _ in range(r.randint(0, 9))]

    rows = edges(range(60))
    counts = network.hub_counts(spark.createDataFrame(rows, schema))
    stats = network.hub_stats_of(counts, F.lit(29))
    for _ in range(3):
        changed = set(r.sample(range(70), 12))
        old, new = [x for x in rows if x[0] in changed], edges(changed)
        rows = [x for x in rows if x[0] not in changed] + new
        counts, stats = (spark.createDataFrame(t.collect(), t.schema) for t in network.hubs_after(counts, stats, spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), F.lit(29)))
    full = network.node_stats(spark.createDataFrame(rows, schema), F.lit(29))
    assert sorted(map(tuple, stats.select(full.columns).collect())) == sorted(map(tuple, full.collect())) and stats.where("is_hub = 1").count() in range(1, 21)


def test_money_must_come_back_in_time(spark):
    rows = [("a", "b", 2020, 100.0), ("a", "b", 2015, 50.0), ("b", "a", 2022, 30.0), ("b", "a", 2019, 9.0), ("c", "d", 2020, 5.0), ("d", "c", 2023, 5.0), ("e", "f", 2020, 5.0), ("f", "e", None, 5.0), ("g", "g", 2020, 5.0)]
    flows = network.yearly(spark.createDataFrame(rows, "source string, target string, tax_year int, amount double"))
    got = {(r.ein, r.via): (r.first_hop_amount, r.amount, r.rows, list(r.first_years), list(r.second_years)) for r in network.grant_returns(flows).collect()}
    assert got == {("a", "b"): (100.0, 30.0, 1, [2020], [2022]), ("b", "a"): (9.0, 100.0, 1, [2019], [2020])}
    assert {(r.ein, r.paid, r.received) for r in network.reciprocal_grants(flows).collect()} == {("a", 100.0, 39.0), ("b", 39.0, 100.0)}


def test_identity_words_are_bucketed(spark, tmp_path):
    rows = [("f1", "12-3456780", "Acme & Sons, Inc.", "ACME AND SONS", "1 Elm Street", "Rome", "ny", "13440", 2020), ("f2", "bad", "X", None, "", "", "", "", 2020), ("f1", "123456780", "Acme and Sons", None, "1 Elm St.", " rome ", "NY", "13440-0001", 2020)]
    r = spark.createDataFrame(rows, "filing_id string, ein string, org_name string, dba_name string, us_address_line1 string, city string, state string, zip string, tax_year int")
    made = identity.layer(identity.returns_identities(r, spark.createDataFrame([("f1", 2019)], "filing_id string, tax_year int")))
    got = made.collect()
    assert len(got) == 1 and (got[0].name_norm, got[0].street_norm, got[0].city, got[0].tax_year, got[0].source) == ("ACME AND SONS", "1 ELM ST", "ROME", 2019, "returns_org_name")
    identity.written(made, str(tmp_path / "ids"), "identity_words", buckets=4)
    try:
        words = spark.table("identity_words")
        assert {x.token for x in words.collect()} == {"ACME", "SONS"}
        counted = words.groupBy("token").agg(F.count("*").alias("n"))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in counted
    finally:
        spark.sql("DROP TABLE identity_words")
