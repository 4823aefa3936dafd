"""Work that must grow with the rows and not with the pairs that share a frequent name, counted in rows shuffled."""

from pyspark.sql import functions as F

from filigree import plans
from filigree.operators import aggs, network, replay, retrieval, screening, union_match
from filigree.plans import graph


def rows_shuffled(spark, df):
    """The rows that a query sends through shuffles."""

    def stages():
        found = spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
        return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))

    before = stages()
    n = len(df.collect())
    return n, stages() - before


def test_queries_of_the_same_words_are_answered_once(spark):
    rows = spark.range(4000).select(F.col("id").alias("entry"), F.col("id").alias("query"), F.lit("x").alias("place"), F.array(F.lit("ALL"), F.lit("SAME")).alias("tokens"))
    out = retrieval.shared_tokens(rows, rows, query="query", entry="entry", tokens="tokens", place="place", order=["entry"], k=20)
    n, shuffled = rows_shuffled(spark, out)
    assert n == 80_000 and shuffled < 30_000


def test_parts_of_the_same_name_are_compared_once(spark, tmp_path):
    name = F.concat(F.lit("n "), (F.col("id") % 20).cast("string"))
    spark.range(3000).select(F.col("id").alias("p_partkey"), F.lit("T").alias("p_type"), F.lit(1).alias("p_size"), name.alias("p_name")).write.parquet(f"{tmp_path}/part.parquet")
    n, shuffled = rows_shuffled(spark, plans.QUERIES["fuzzy_resolution"](spark, str(tmp_path)))
    assert n == 3000 and shuffled < 12_000


def test_screened_pairs_are_not_shuffled(spark):
    wanted = spark.range(600).select("id", F.lit("N1").alias("name_norm"))
    entities = spark.range(300).select(F.col("id").alias("entity_id"), F.lit("N1").alias("name_norm"))
    n, shuffled = rows_shuffled(spark, screening.name_candidates(wanted, entities, entities))
    assert n == 180_000 and shuffled < 5000


def same_name(spark, n):
    """Unions and filers of one name; the filers are all in another place but those of unions 0 to 9."""
    orgs = spark.range(n).select(F.col("id").alias("f_num"), F.lit("Acme Local 1").alias("display_name"), F.lit("").alias("union_name"), F.lit("").alias("unit_name"), F.lit("").alias("city"), F.lit("").alias("state"), (F.col("id") + 10000).cast("string").alias("zip"))
    place = F.when(F.col("id") < 10, F.col("id") + 10000).otherwise(F.lit(54321)).cast("string")
    returns = spark.range(n).select(F.col("id").cast("string").alias("ein"), F.lit("Acme Local 1").alias("org_name"), F.lit("").alias("dba_name"), F.lit("c").alias("city"), F.lit("s").alias("state"), place.alias("zip"))
    overrides = spark.createDataFrame([(1, "0", "reject", "0", ""), (2, "1", "unmatch", "", ""), (3, "20", "accept", "7", "")], "seq long, f_num string, action string, ein string, note string")
    return orgs, union_match.identity_candidates(returns, union_match.name_variants(orgs)), overrides


def test_accepted_matches_make_no_other_pairs(spark):
    orgs, candidates, overrides = same_name(spark, 300)
    out = union_match.accepted_matches(orgs, candidates, overrides)
    wanted = union_match.accepted(union_match.matched(orgs, candidates, overrides))
    assert sorted(out.collect(), key=str) == sorted(wanted.select(out.columns).collect(), key=str)
    n, shuffled = rows_shuffled(spark, out)
    assert n == 9 and shuffled < 30_000 < 300 * 300


def test_counterparties_of_a_frequent_name_meet_ends_only(spark):
    _, candidates, _ = same_name(spark, 300)
    parties = spark.range(400).select(F.col("id").alias("counterparty_id"), F.lit(candidates.first()["name_norm"]).alias("canonical_name_norm"), F.when(F.col("id") < 5, F.col("id") + 10000).otherwise(F.lit(54321)).cast("string").alias("zip5"), F.lit("").alias("city"), F.lit("").alias("state"))
    n, shuffled = rows_shuffled(spark, union_match.counterparty_matches(parties, candidates))
    assert n == 5 and shuffled < 10_000 < 395 * 290


def test_candidates_are_compared_in_many_tasks(spark):
    """A nation's pairs, which are many for two small tables, are made by more tasks than the tables have parts."""
    store = spark._jsc.sc().statusStore()

    def tasks():
        found = store.stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).numTasks() for i in range(found.size())}

    before = tasks()
    assert plans.QUERIES["candidate_scoring"](spark, "/root/testdata/sf0.01").count() == 1500
    assert max(n for i, n in tasks().items() if i not in before) >= 4 * spark.sparkContext.defaultParallelism


def test_paths_are_dealt_before_they_are_grouped(spark):
    """Pairs of ends hardly repeat within a task, so none are combined before they are dealt."""
    plan = plans.QUERIES["two_hop_paths"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    before_join = plan[: plan.index("SortMergeJoin") if "SortMergeJoin" in plan else plan.index("HashJoin")]
    assert before_join.rindex("Exchange hashpartitioning(a") > before_join.rindex("HashAggregate")


def test_looked_up_pairs_are_dealt_before_they_are_made_distinct(spark):
    """A key's identities times its signatures are made in one task, which must not hold them."""
    plan = plans.QUERIES["candidate_lookups"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    before_union = plan[: plan.index("Union")]
    assert before_union.rindex("Exchange hashpartitioning(signature") > before_union.rindex("HashAggregate")


def test_edges_are_dealt_before_they_are_counted(spark):
    edges = spark.range(9).selectExpr("concat('person:', id % 2) AS target_key", "id AS source_ein", "2000 AS tax_year")
    stats = network.node_stats(edges)
    assert sorted((r.target_key, r.distinct_org_count, r.edge_count) for r in stats.collect()) == [("person:0", 5, 5), ("person:1", 4, 4)]
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [target_key" in plan


def test_audited_rows_are_dealt_once(spark):
    """Each row goes through one shuffle, and one more as part of its filing's sums."""
    rows = spark.range(3000).select((F.col("id") % 500).alias("filing_id"), F.col("id").cast("string").alias("name"), F.when(F.col("id") % 2 == 0, "5").alias("cash"))
    out = replay.explained(rows, rows.fillna("7", ["cash"]), ["name", "cash"], filled=["cash"], amount="cash")
    n, shuffled = rows_shuffled(spark, out)
    assert n == 500 and shuffled <= 3 * 3000
    assert {(r.n_equal, r.n_to_number, r.status) for r in out.collect()} == {(6, 0, "equal"), (0, 6, "explained")}


def test_edges_of_lines_come_from_one_join(spark):
    """Lines meet their filings once, whatever number of kinds of edges they make; pairs are summed where they are joined."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n, shuffled = rows_shuffled(spark, plans.QUERIES["edges_all_sources"](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert n > 3 * lines and shuffled <= 2 * (lines + orders)


def test_lines_without_a_part_are_of_no_table_of_related_organisations(spark):
    rows = spark.createDataFrame([(1, 2000, 7, 21, None, 5.0), (1, 2000, 7, 21, 3, 5.0)], "ein long, tax_year long, filing_id long, recipient long, part long, cash double")
    made = graph.line_edges(rows).collect()
    assert sorted((r.edge_type, r.target_key) for r in made if r.edge_type.startswith("schedule")) == [("schedule_r_unrelated_taxable_partnership", "ein:120000021")]
    assert all(r.edge_id and r.edge_type and r.target_key for r in made)


def test_shares_are_dealt_once(spark):
    """Parts and totals are summed where a key's rows are, so no part of a key is dealt again."""
    rows = spark.range(3000).select((F.col("id") % 700).alias("ein"), (F.col("id") % 3 + 2000).alias("tax_year"), (F.col("id") * 7).alias("recipient"), F.lit(0.126).alias("cash"))
    out = aggs.concentration(rows, ["ein", "tax_year"], "recipient", "cash")
    n, shuffled = rows_shuffled(spark, out)
    assert n == 2100 and shuffled <= 3000
    plan = aggs.concentration(rows, ["ein", "tax_year"], "recipient", "cash")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    rounded = aggs.concentration(rows, ["ein"], "recipient", "cash", places=2).where("ein = 0").first()
    assert (round(rounded.total, 6), rounded.largest, rounded.n_parts) == (0.65, 0.13, 5)


def test_matched_pairs_are_not_shuffled(spark, monkeypatch):
    """A name's unions and filers meet once, in blocks, and what a pair is judged by comes with them."""
    orgs, candidates, overrides = same_name(spark, 300)
    out = union_match.matched(orgs, candidates, overrides)
    n, shuffled = rows_shuffled(spark, out)
    assert n == 300 * 300 + 2 and shuffled < 10_000
    status = {(r.match_status, r.manual_override_status): r["count"] for r in out.groupBy("match_status", "manual_override_status").count().collect()}
    assert status == {("MATCHED_HIGH_CONFIDENCE", None): 8, ("CANDIDATE_REVIEW", None): 300 * 300 - 9, ("REJECTED_MANUAL", "reject"): 1, ("UNMATCHED", "unmatch"): 1, ("MATCHED_MANUAL", "accept"): 1}
    for name, value in (("SHEAF", 7), ("UNIONS", 50), ("FILERS", 40)):
        monkeypatch.setattr(union_match, name, value)
    many = union_match.matched(orgs, candidates, overrides)
    assert many.exceptAll(out).count() == out.exceptAll(many).count() == 0
