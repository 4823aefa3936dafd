"""Queries on source inventory, screening, decisions, sinks and digests, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.functions import text as t
from filigree.operators import aggs, inventory, joins, network, resolve, risk, screening, sets, windows
from filigree.plans.roles import GRANTS, RETURNS, grants, returns, table, with_
from filigree.sources import sinks

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


FILES = """files AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'a/b/' ELSE 'a/' END || p_name || '_' || p_partkey AS path, p_name || '/' || (p_size % 4) AS object_id, md5(CAST(CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_partkey % 3 END AS VARCHAR)) AS sha256,
  CASE WHEN p_size % 4 = 1 THEN 'c' WHEN p_size % 4 <> 2 THEN md5(CAST(p_partkey % 3 AS VARCHAR)) END AS canonical_sha256 FROM part)"""


def files(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size") % 4
    three = F.md5((k % 3).cast("string"))
    return table(spark, d, "part").select(
        F.concat(F.when(k % 3 == 0, "a/b/").otherwise("a/"), "p_name", F.lit("_"), k.cast("string")).alias("path"), F.concat("p_name", F.lit("/"), s.cast("string")).alias("object_id"),
        F.when(s == 0, F.md5(F.lit("0"))).otherwise(three).alias("sha256"), F.when(s == 1, "c").when(s != 2, three).alias("canonical_sha256"),
    )


@query(
    with_(FILES, "g AS (SELECT object_id, count(*) AS n, count(DISTINCT sha256) AS byte_kinds, count(DISTINCT coalesce(canonical_sha256, sha256)) AS kinds FROM files GROUP BY object_id)",
          "r AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY len(string_split(path, '/')), path) AS k FROM files)")
    + """SELECT path, object_id, CASE WHEN n = 1 THEN 'unique' WHEN byte_kinds = 1 THEN 'identical' WHEN kinds = 1 THEN 'equivalent' ELSE 'object_id_conflict' END AS duplicate_status,
  k = 1 AND (n = 1 OR byte_kinds = 1 OR kinds = 1) AS keep FROM r JOIN g USING (object_id)"""
)
def duplicate_files(spark: SparkSession, d: str) -> DataFrame:
    return inventory.with_primaries(files(spark, d)).select("path", "object_id", "duplicate_status", "keep")


@query(
    with_(FILES, "l AS (SELECT DISTINCT object_id FROM files WHERE object_id LIKE '%/1')", "r AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY len(string_split(path, '/')), path) AS k FROM files WHERE object_id NOT IN (SELECT object_id FROM l))")
    + "SELECT path, object_id FROM r WHERE k = 1"
)
def files_to_load(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    return inventory.to_load(f, f.where("object_id like '%/1'").select("object_id")).select("path", "object_id")


@query(
    with_(FILES, "l AS (SELECT path AS source_file, object_id, 'f' || path AS filing_id FROM files WHERE path LIKE 'a/b/%')", "o AS (SELECT object_id, min(filing_id) AS loaded_object FROM l GROUP BY object_id)")
    + "SELECT path, files.object_id, l.filing_id AS loaded_exact, loaded_object FROM files LEFT JOIN l ON l.source_file = path LEFT JOIN o ON o.object_id = files.object_id"
)
def loaded_files(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    loaded = f.where("path like 'a/b/%'").select(F.col("path").alias("source_file"), "object_id", F.concat(F.lit("f"), "path").alias("filing_id"))
    return inventory.source_audit(f, loaded).select("path", "object_id", "loaded_exact", "loaded_object")


@query(
    """SELECT object_id, loaded_path, path FROM (SELECT *, count(*) OVER (PARTITION BY object_id) AS n FROM (
  SELECT CASE WHEN p_partkey % 3 = 0 THEN 's' || p_size ELSE CAST(p_partkey AS VARCHAR) END AS object_id, 'root/' || p_name || '/' || p_brand AS path, p_name || '/' || p_brand AS loaded_path FROM part)) WHERE n = 1"""
)
def suffix_of_loaded_path(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("s"), F.col("p_size").cast("string"))).otherwise(F.col("p_partkey").cast("string"))
    rows = table(spark, d, "part").select(key.alias("object_id"), F.concat_ws("/", "p_name", "p_brand").alias("loaded_path"))
    once = rows.withColumn("path", F.concat(F.lit("root/"), "loaded_path"))
    alone = once.groupBy("object_id").agg(F.count("*").alias("n")).where("n = 1").select("object_id")
    pairs = once.join(alone, "object_id", "left_semi")
    return joins.suffix_match(pairs.select("object_id", "path"), pairs.select("object_id", "loaded_path"), "object_id").select("object_id", "loaded_path", "path")


@query(
    """SELECT report_id FROM (SELECT o_orderkey AS report_id, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate), o_orderkey % 2 ORDER BY accepted DESC NULLS LAST, o_orderkey DESC) AS k
  FROM (SELECT *, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS accepted FROM orders)) WHERE k = 1"""
)
def latest_audit_reports(spark: SparkSession, d: str) -> DataFrame:
    reports = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("auditee_ein"), F.year("o_orderdate").alias("fy_start_date"), (F.col("o_orderkey") % 2).alias("fy_end_date"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate").cast("date")).alias("accepted_date"),
    )
    return screening.latest_reports(reports).select("report_id")


@query(
    """WITH names AS (SELECT s_suppkey AS entity_id, 'N' || (s_suppkey % 30) AS name_norm, 0 AS is_alias FROM supplier UNION ALL SELECT s_suppkey, 'N' || (s_suppkey % 45), 1 FROM supplier),
w AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'N' || (c_custkey % 60) END AS name_norm FROM customer)
SELECT c_custkey, entity_id, min(is_alias) AS is_alias FROM w JOIN names USING (name_norm) WHERE name_norm <> '' GROUP BY c_custkey, entity_id"""
)
def screening_candidates(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")

    def named(n: int) -> DataFrame:
        return s.select(F.col("s_suppkey").alias("entity_id"), F.concat(F.lit("N"), (F.col("s_suppkey") % n).cast("string")).alias("name_norm"))

    wanted = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.concat(F.lit("N"), (F.col("c_custkey") % 60).cast("string"))).alias("name_norm"))
    return screening.name_candidates(wanted, named(30), named(45)).select("c_custkey", "entity_id", "is_alias")


@query(
    """SELECT c_custkey, CASE WHEN c = '' AND r IS NULL THEN 'not_requested' WHEN (c = '' OR c = 'Rome') AND (r IS NULL OR r = 'LA') THEN 'exact' WHEN c = 'Rome' THEN 'conflict' WHEN r = 'LA' THEN 'conflict' WHEN c = '' THEN 'conflict' ELSE 'conflict' END AS evidence
FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Rome' WHEN 1 THEN 'Oslo' ELSE '' END AS c, CASE c_custkey % 4 WHEN 0 THEN 'LA' WHEN 1 THEN 'NO' END AS r FROM customer)"""
)
def screening_locations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    city, region = F.when(k % 3 == 0, "Rome").when(k % 3 == 1, "Oslo").otherwise(""), F.when(k % 4 == 0, "LA").when(k % 4 == 1, "NO")
    known = F.array(F.struct(F.lit("ROME").alias("city"), F.lit("la").alias("region"), F.lit(None).cast("string").alias("country")))
    return table(spark, d, "customer").select("c_custkey", screening.location_evidence(city, region, F.lit(None).cast("string"), known).alias("evidence"))


@query("SELECT c_custkey AS ein, CASE WHEN c_custkey % 2 = 0 THEN 'Medium' ELSE 'High' END AS severity FROM customer WHERE c_custkey % 3 = 0")
def revocations(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("ein"))
    revoked = c.withColumn("reinstated_date", F.when(F.col("ein") % 3 != 0, "2020-01-01"))
    return screening.revocation_indicator(revoked, c.where("ein % 2 = 0"), list_loaded=True)


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ABC123DEF456' END AS uei, CASE p_partkey % 5 WHEN 0 THEN 1998 WHEN 1 THEN 2021 END AS year_hint,
  CASE p_partkey % 3 WHEN 0 THEN 'x1' WHEN 1 THEN 'x2' ELSE 'public_x' END AS object_id, CASE WHEN p_size >= 25 THEN 1000000 ELSE 750000 END AS threshold FROM part"""
)
def identifiers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, " abc-123 def456").when(k % 4 == 1, "GSA_MIGRATION").when(k % 4 == 2, "short")
    path = F.when(k % 5 == 0, "x/1997/19981/1998-a").when(k % 5 == 1, "2021").when(k % 5 == 2, "120223")
    filing = F.when(k % 3 == 0, "x1_PUBLIC").when(k % 3 == 1, "x2_private").otherwise("public_x")
    start = F.when(F.col("p_size") >= 25, "2024-10-01").otherwise("2024-09-30").cast("date")
    return table(spark, d, "part").select("p_partkey", t.uei(raw).alias("uei"), t.year_hint(path).alias("year_hint"), t.object_id(filing).alias("object_id"), risk.audit_threshold(start).alias("threshold"))


UPDATES = "n AS (SELECT o_custkey AS k, o_orderkey AS v FROM orders WHERE o_orderkey % 3 = 0), o AS (SELECT c_custkey AS k, -1 AS v FROM customer)"


@query(f"WITH {UPDATES} SELECT k, max(v) AS v FROM n GROUP BY k UNION ALL SELECT k, v FROM o WHERE k NOT IN (SELECT k FROM n)")
def upsert_by_key(spark: SparkSession, d: str) -> DataFrame:
    old, new = updates(spark, d)
    return sinks.upserted(old, new, ["k"], [F.desc("v")])


@query(f"WITH {UPDATES}, e AS (SELECT * FROM o WHERE k % 2 = 0) SELECT k, v FROM e UNION ALL SELECT k, min(v) FROM n WHERE k NOT IN (SELECT k FROM e) GROUP BY k")
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    old, new = updates(spark, d)
    return sinks.first_wins(old.where("k % 2 = 0"), new, ["k"], [F.col("v")])


@query(f"WITH {UPDATES}, c AS (SELECT o_custkey AS k, o_orderkey AS v FROM orders) SELECT k, v FROM c WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT k, v FROM n")
def replaced_filing_children(spark: SparkSession, d: str) -> DataFrame:
    _, new = updates(spark, d)
    return sinks.replaced_children(table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v")), new, "k")


def updates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    new = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(-1).cast("long").alias("v")), new


@query(
    with_(RETURNS, GRANTS)
    + """, old AS (SELECT filing_id, recipient, 'old' AS v FROM grants WHERE recipient % 3 = 0), nw AS (SELECT filing_id, recipient, 'new' AS v FROM grants WHERE recipient % 3 = 1), ch AS (SELECT filing_id FROM returns WHERE filing_id % 2 = 0)
SELECT * FROM old WHERE filing_id NOT IN (SELECT filing_id FROM ch) UNION ALL SELECT * FROM nw WHERE filing_id IN (SELECT filing_id FROM ch)"""
)
def incremental_edges(spark: SparkSession, d: str) -> DataFrame:
    g = grants(spark, d).select("filing_id", "recipient")
    old, new = (g.where(f"recipient % 3 = {i}").withColumn("v", F.lit(n)) for i, n in enumerate(("old", "new")))
    return network.refreshed(old, new, returns(spark, d).where("filing_id % 2 = 0").select("filing_id"))


@query(with_(GRANTS) + "SELECT flag, status, count(*) AS n FROM grants GROUP BY flag, status")
def flag_histogram(spark: SparkSession, d: str) -> DataFrame:
    return aggs.histogram(grants(spark, d), "flag", "status")


@query(with_(GRANTS) + "SELECT filing_id, recipient, part, round(recipient % 5 + CASE WHEN part % 3 = 0 THEN 0 ELSE log10(greatest(cash, 1)) END, 6) AS rank FROM grants")
def network_ranking(spark: SparkSession, d: str) -> DataFrame:
    rank = network.connection_rank(F.col("recipient") % 5, F.when(F.col("part") % 3 != 0, F.col("cash")))
    return grants(spark, d).select("filing_id", "recipient", "part", F.round(rank, 6).alias("rank"))


DECISIONS = """c AS (SELECT o_custkey AS signature, CAST(o_orderkey AS VARCHAR) AS ein FROM orders),
dec AS (SELECT o_orderkey AS id, o_custkey AS signature, CASE o_orderkey % 6 WHEN 0 THEN 'SELECT_CANDIDATE' WHEN 1 THEN 'KEEP_REPORTED_EIN' WHEN 2 THEN 'NO_MATCH' WHEN 3 THEN 'AMBIGUOUS' WHEN 4 THEN 'GUESS' ELSE 'SELECT_CANDIDATE' END AS decision,
  CASE WHEN o_orderkey % 7 <> 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'none' ELSE CAST(o_orderkey AS VARCHAR) END END AS selected_ein, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 13) / 12.0::DOUBLE ELSE 1.5 END AS confidence FROM orders),
val AS (SELECT *, CASE WHEN decision = 'GUESS' THEN 'unknown_decision' WHEN s AND selected_ein IS NULL THEN 'selection_without_ein' WHEN s AND NOT known THEN 'ein_not_a_candidate' WHEN NOT s AND selected_ein IS NOT NULL THEN 'identity_without_selection'
  WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence_out_of_range' ELSE 'ok' END AS validation_status
  FROM (SELECT *, decision IN ('SELECT_CANDIDATE', 'KEEP_REPORTED_EIN') AS s, EXISTS (SELECT 1 FROM c WHERE c.signature = dec.signature AND c.ein = dec.selected_ein) AS known FROM dec)),
fin AS (SELECT *, CAST(validation_status = 'ok' AND s AND confidence >= 0.9 AS INTEGER) AS auto_accept FROM val)"""


def decisions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k, o = F.col("o_orderkey"), table(spark, d, "orders")
    kind = F.element_at(F.array(*map(F.lit, ("SELECT_CANDIDATE", "KEEP_REPORTED_EIN", "NO_MATCH", "AMBIGUOUS", "GUESS", "SELECT_CANDIDATE"))), (k % 6 + 1).cast("int"))
    rows = o.select(
        k.alias("id"), F.col("o_custkey").alias("signature"), kind.alias("decision"), F.when(k % 7 != 0, F.when(k % 5 == 0, "none").otherwise(k.cast("string"))).alias("selected_ein"), F.when(k % 11 != 0, (k % 13) / 12.0).otherwise(1.5).alias("confidence")
    )
    return rows, o.select(F.col("o_custkey").alias("signature"), k.cast("string").alias("ein"))


@query(f"WITH {DECISIONS} SELECT id, signature, selected_ein, validation_status, auto_accept FROM fin")
def decisions_validated(spark: SparkSession, d: str) -> DataFrame:
    return resolve.validated(*decisions(spark, d)).select("id", "signature", "selected_ein", "validation_status", "auto_accept")


@query(f"WITH {DECISIONS} SELECT c_custkey AS grant_id, signature, selected_ein, confidence, decision FROM fin JOIN customer ON c_custkey = signature WHERE auto_accept = 1")
def decisions_applied(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "customer").select(F.col("c_custkey").alias("grant_id"), F.col("c_custkey").alias("signature"))
    return resolve.applied(resolve.validated(*decisions(spark, d)), members).select("grant_id", "signature", "selected_ein", "confidence", "decision")


@query(f"WITH {DECISIONS} SELECT id, CASE WHEN decision IN ('SELECT_CANDIDATE', 'KEEP_REPORTED_EIN') THEN selected_ein END AS selected_ein FROM dec")
def identity_leaks_removed(spark: SparkSession, d: str) -> DataFrame:
    return resolve.without_leaked_identity(decisions(spark, d)[0]).select("id", "selected_ein")


@query(
    """SELECT c_custkey, b.name FROM customer LEFT JOIN (SELECT * FROM (SELECT o_custkey AS ein, 'N' || o_orderkey AS name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3, year(o_orderdate) DESC, o_orderkey) AS k FROM orders) WHERE k = 1) b ON b.ein = c_custkey"""
)
def best_names(spark: SparkSession, d: str) -> DataFrame:
    index = table(spark, d, "orders").select(
        F.col("o_custkey").alias("ein"), F.concat(F.lit("N"), F.col("o_orderkey").cast("string")).alias("name"), (F.col("o_orderkey") % 3).alias("source_rank"), F.year("o_orderdate").alias("tax_year"), F.col("o_orderkey").alias("identity_id")
    )
    return resolve.with_names(table(spark, d, "customer").select("c_custkey"), index, "c_custkey", "name")


@query(with_(GRANTS, "c AS (SELECT part AS signature, recipient AS ein, max(cash) AS cs FROM grants GROUP BY part, recipient)") + "SELECT signature, ein, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY cs DESC, ein) AS k FROM c) WHERE k <= 20")
def twenty_candidates(spark: SparkSession, d: str) -> DataFrame:
    scored = grants(spark, d).groupBy(F.col("part").alias("signature"), F.col("recipient").alias("ein")).agg(F.max("cash").alias("cs"))
    return windows.top_k_per_group(scored, ["signature"], [F.desc("cs"), F.col("ein")], 20, rank="rank").select("signature", "ein", "rank")


COPIES = "s AS (SELECT o_custkey % 50 AS k, o_orderpriority AS v FROM orders)"


@query(f"WITH {COPIES} SELECT k, CASE WHEN k % 4 < 3 THEN k % 4 END AS factor FROM (SELECT DISTINCT k FROM s)")
def replay_factors(spark: SparkSession, d: str) -> DataFrame:
    """A copy that holds each key's rows no, one or two times; of every fourth key one row is missing."""
    s = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("k"), F.col("o_orderpriority").alias("v"))
    one, two = s.where("k % 4 in (1, 2)"), s.where("k % 4 = 2")
    part = s.where("k % 4 = 3").withColumn("v", F.concat("v", F.lit("?")))
    return sets.replay_factor(s, one.unionByName(two).unionByName(part), ["k"])


@query("SELECT TRUE AS same, FALSE AS other, count(*) AS n FROM orders")
def digests_equal(spark: SparkSession, d: str) -> DataFrame:
    """Equal multisets have equal digests in any order, and one repeated row more makes another."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    named = (("a", o), ("b", o.orderBy(F.desc("o_totalprice"))), ("c", o.unionByName(o.limit(1))))
    digests = [sets.multiset_digest(df).select(F.lit(n).alias("name"), "n_rows", F.struct("n_rows", "sum_1", "sum_2").alias("digest")) for n, df in named]

    def of(name: str, column: str = "digest") -> F.Column:
        return F.max(F.when(F.col("name") == name, F.col(column)))

    return reduce(DataFrame.unionByName, digests).agg((of("a") == of("b")).alias("same"), (of("a") == of("c")).alias("other"), of("a", "n_rows").alias("n"))
