"""Queries on filings, grants and identities, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.functions.text import yes_no
from filigree.operators import aggs, joins, rules, sets, windows
from filigree.plans.roles import CANONICAL, FLOWS, GRANTS, PAIRS, RETURNS, flows, grant_pairs, grants, returns, table, with_

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def canonical(spark: SparkSession, d: str) -> DataFrame:
    return windows.canonical_filings(returns(spark, d), ["F", "O"])


@query(with_(RETURNS, CANONICAL) + "SELECT ein, tax_year, filing_id, return_type FROM canonical")
def canonical_latest(spark: SparkSession, d: str) -> DataFrame:
    return canonical(spark, d).select("ein", "tax_year", "filing_id", "return_type")


LATEST = "latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ein ORDER BY tax_year DESC, return_ts DESC NULLS LAST, filing_id DESC) AS rn FROM returns) WHERE rn = 1)"


def latest_names(df: DataFrame) -> DataFrame:
    return windows.latest_per_key(df, ["ein"], [F.desc("tax_year"), F.desc("return_ts"), F.desc("filing_id")])


@query(with_(RETURNS, LATEST) + "SELECT ein, org_name, filing_id FROM latest")
def latest_name_per_key(spark: SparkSession, d: str) -> DataFrame:
    return latest_names(returns(spark, d)).select("ein", "org_name", "filing_id")


def paid_chain(spark: SparkSession, d: str) -> DataFrame:
    """Grants of canonical filings with the filer's latest name, largest first."""
    filers = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("ein"))
    paid = joins.exists(canonical(spark, d), filers, ["ein"]).join(grant_pairs(spark, d), "filing_id")
    names = latest_names(joins.exists(returns(spark, d), filers, ["ein"])).select("ein", "org_name")
    out = paid.drop("org_name").join(names, "ein").select("ein", "org_name", "tax_year", "filing_id", "recipient", "amount")
    return out.orderBy(F.desc("amount"), "filing_id", "recipient")


@query(
    with_(RETURNS, GRANTS, PAIRS, CANONICAL, LATEST)
    + """SELECT c.ein, latest.org_name, c.tax_year, c.filing_id, p.recipient, p.amount
FROM canonical c JOIN pairs p ON p.filing_id = c.filing_id JOIN latest ON latest.ein = c.ein
WHERE c.ein IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
ORDER BY p.amount DESC, c.filing_id, p.recipient"""
)
def grants_paid_all(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain, as the reference's full fetch."""
    return paid_chain(spark, d)


@query(
    with_(RETURNS, GRANTS, PAIRS, CANONICAL, LATEST)
    + """SELECT c.ein, latest.org_name, c.tax_year, c.filing_id, p.recipient, p.amount
FROM canonical c JOIN pairs p ON p.filing_id = c.filing_id JOIN latest ON latest.ein = c.ein
WHERE c.ein IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
ORDER BY p.amount DESC, c.filing_id, p.recipient LIMIT 500"""
)
def grants_paid_chain(spark: SparkSession, d: str) -> DataFrame:
    """The first 500 rows of the chain, as the reference's preview shows."""
    return paid_chain(spark, d).limit(500)


@query(
    with_(RETURNS, GRANTS, CANONICAL)
    + """SELECT s.s_name AS recipient_name, c.tax_year, count(*) AS n_grants, round(sum(g.cash), 2) AS amount
FROM grants g JOIN canonical c ON c.filing_id = g.filing_id JOIN supplier s ON s.s_suppkey = g.recipient
WHERE s.s_nationkey < 10 GROUP BY s.s_name, c.tax_year"""
)
def grants_received_chain(spark: SparkSession, d: str) -> DataFrame:
    recipients = table(spark, d, "supplier").where("s_nationkey < 10").select(F.col("s_suppkey").alias("recipient"), F.col("s_name").alias("recipient_name"))
    got = grants(spark, d).join(recipients, "recipient").join(canonical(spark, d).select("filing_id", "tax_year"), "filing_id")
    return got.groupBy("recipient_name", "tax_year").agg(F.count("*").alias("n_grants"), F.round(F.sum("cash"), 2).alias("amount"))


RESOLVED = "resolved AS (SELECT filing_id, recipient, CASE WHEN recipient % 7 <> 0 THEN recipient END AS resolved_ein, (recipient % 100) / 100.0::DOUBLE AS confidence FROM pairs)"
APPLIED = """applied AS (SELECT filing_id, recipient, recipient + 100000 AS applied_ein, 0.9::DOUBLE AS applied_confidence,
  CASE WHEN recipient % 2 = 0 THEN 'rule:deterministic' WHEN recipient % 5 = 0 THEN 'rule:reported' ELSE 'model' END AS model FROM pairs WHERE recipient % 3 = 0)"""
DECIDED = "decided AS (SELECT filing_id, recipient, recipient + 200000 AS decision_ein, 0.8::DOUBLE AS decision_confidence FROM pairs WHERE recipient % 4 = 1)"


def layers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resolver, applied and decision layers on the grants."""
    pairs, r = grant_pairs(spark, d).select("filing_id", "recipient"), F.col("recipient")
    resolved = pairs.select("filing_id", "recipient", F.when(r % 7 != 0, r).alias("resolved_ein"), ((r % 100) / 100.0).alias("confidence"))
    model = F.when(r % 2 == 0, "rule:deterministic").when(r % 5 == 0, "rule:reported").otherwise("model")
    applied = pairs.where(r % 3 == 0).select("filing_id", "recipient", (r + 100000).alias("applied_ein"), F.lit(0.9).alias("applied_confidence"), model.alias("model"))
    decided = pairs.where(r % 4 == 1).select("filing_id", "recipient", (r + 200000).alias("decision_ein"), F.lit(0.8).alias("decision_confidence"))
    return resolved, applied, decided


@query(
    with_(GRANTS, PAIRS, RESOLVED, APPLIED, DECIDED)
    + """SELECT filing_id, recipient, coalesce(applied_ein, decision_ein, resolved_ein) AS final_ein, coalesce(applied_confidence, decision_confidence, confidence) AS final_confidence,
  CASE WHEN applied_ein IS NULL THEN 'resolver' WHEN model = 'rule:deterministic' THEN 'deterministic_rule' WHEN model LIKE 'rule:%' THEN 'reported_ein_rule' ELSE 'ai_adjudicated' END AS final_source
FROM resolved LEFT JOIN applied USING (filing_id, recipient) LEFT JOIN decided USING (filing_id, recipient)"""
)
def enhanced_final_identity(spark: SparkSession, d: str) -> DataFrame:
    return joins.final_identity(*layers(spark, d), ["filing_id", "recipient"], joins.source_label(module=True))


@query(
    with_(GRANTS, PAIRS, RESOLVED, APPLIED)
    + """SELECT filing_id, recipient, applied_ein AS ein, 'applied' AS layer FROM applied
UNION ALL SELECT filing_id, recipient, resolved_ein AS ein, 'resolved' AS layer FROM resolved r
WHERE NOT EXISTS (SELECT 1 FROM applied a WHERE a.filing_id = r.filing_id AND a.recipient = r.recipient)"""
)
def applied_union_deterministic(spark: SparkSession, d: str) -> DataFrame:
    resolved, applied, _ = layers(spark, d)
    a = applied.select("filing_id", "recipient", F.col("applied_ein").alias("ein"), F.lit("applied").alias("layer"))
    r = resolved.select("filing_id", "recipient", F.col("resolved_ein").alias("ein"), F.lit("resolved").alias("layer"))
    return joins.applied_or_resolved(a, r, ["filing_id", "recipient"])


AMOUNTS = (1000, 2500, 5000, 10000, 20000, 30000, 40000, 50000, 60000, 70000, 80000, 90000, 100000)
AMOUNT_LABELS = (*(f"{i:02d}_under_{b}" for i, b in enumerate(AMOUNTS)), "13_more")


@query(
    with_(RETURNS, GRANTS, PAIRS, CANONICAL, APPLIED)
    + f"""SELECT bucket, count(*) AS n, round(sum(amount), 2) AS amount, round(100.0 * sum(amount) / sum(sum(amount)) OVER (), 6) AS percent
FROM (SELECT amount, CASE {" ".join(f"WHEN amount < {b} THEN '{label}'" for b, label in zip(AMOUNTS, AMOUNT_LABELS, strict=False))} ELSE '13_more' END AS bucket
      FROM pairs p WHERE EXISTS (SELECT 1 FROM canonical c WHERE c.filing_id = p.filing_id)
        AND NOT EXISTS (SELECT 1 FROM applied a WHERE a.filing_id = p.filing_id AND a.recipient = p.recipient)) GROUP BY bucket"""
)
def remaining_queue_buckets(spark: SparkSession, d: str) -> DataFrame:
    _, applied, _ = layers(spark, d)
    queue = joins.missing(joins.exists(grant_pairs(spark, d), canonical(spark, d), ["filing_id"]), applied, ["filing_id", "recipient"])
    counted = queue.groupBy(aggs.bucket(F.col("amount"), AMOUNTS, AMOUNT_LABELS).alias("bucket")).agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    return windows.share_of_total(counted, "amount", "percent").select("bucket", "n", F.round("amount", 2).alias("amount"), F.round("percent", 6).alias("percent"))


@query(
    with_(RETURNS, GRANTS)
    + "SELECT filing_id, ein FROM returns r WHERE EXISTS (SELECT 1 FROM grants g JOIN part p ON p.p_partkey = g.part WHERE g.filing_id = r.filing_id AND g.flag = 'R' AND p.p_name ILIKE '%a%' AND p.p_size > 40)"
)
def exists_child_pattern(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").where(F.col("p_name").ilike("%a%") & (F.col("p_size") > 40)).select(F.col("p_partkey").alias("part"))
    children = grants(spark, d).where("flag = 'R'").join(parts, "part").select("filing_id")
    return joins.exists(returns(spark, d), children, ["filing_id"]).select("filing_id", "ein")


@query(with_(GRANTS) + "SELECT DISTINCT filing_id, recipient FROM grants g WHERE NOT EXISTS (SELECT 1 FROM grants r WHERE r.filing_id = g.filing_id AND r.recipient = g.recipient AND r.flag = 'R')")
def unresolved_increment(spark: SparkSession, d: str) -> DataFrame:
    done = grants(spark, d).where("flag = 'R'").select("filing_id", "recipient")
    return joins.missing(grants(spark, d).select("filing_id", "recipient"), done, ["filing_id", "recipient"]).distinct()


@query(
    with_(RETURNS)
    + """SELECT filing_id, CASE return_type WHEN 'F' THEN total WHEN 'O' THEN total * 0.9 END AS revenue,
  CASE WHEN upper(trim(coalesce(amended, ''))) IN ('1', 'X', 'TRUE', 'YES', 'Y') THEN 'Yes' WHEN upper(trim(coalesce(amended, ''))) IN ('0', 'FALSE', 'NO', 'N') THEN 'No' ELSE '' END AS amended,
  CASE WHEN ein % 3 = 0 THEN '501(c)(' || (ein % 20) || ')' END AS exempt_status FROM returns"""
)
def form_dispatch_projection(spark: SparkSession, d: str) -> DataFrame:
    revenue = F.when(F.col("return_type") == "F", F.col("total")).when(F.col("return_type") == "O", F.col("total") * 0.9)
    status = F.when(F.col("ein") % 3 == 0, F.concat(F.lit("501(c)("), (F.col("ein") % 20).cast("string"), F.lit(")")))
    return returns(spark, d).select("filing_id", revenue.alias("revenue"), yes_no(F.col("amended")).alias("amended"), status.alias("exempt_status"))


PARTS_OF = "amounts AS (SELECT filing_id, sum(CASE WHEN flag = 'R' THEN cash END) AS total, sum(CASE WHEN flag = 'A' THEN cash END) AS group_total, coalesce(sum(CASE WHEN status = 'F' THEN noncash END), 0) AS direct, coalesce(sum(CASE WHEN status = 'O' THEN noncash END), 0) AS grass FROM grants GROUP BY filing_id)"


def amounts(spark: SparkSession, d: str) -> DataFrame:
    def of(column: str, value: str, amount: str) -> F.Column:
        return F.sum(F.when(F.col(column) == value, F.col(amount)))

    return grants(spark, d).groupBy("filing_id").agg(
        of("flag", "R", "cash").alias("total"), of("flag", "A", "cash").alias("group_total"),
        F.coalesce(of("status", "F", "noncash"), F.lit(0.0)).alias("direct"), F.coalesce(of("status", "O", "noncash"), F.lit(0.0)).alias("grass"),
    )


@query(
    with_(GRANTS, PARTS_OF)
    + """SELECT filing_id, round(coalesce(total, group_total, nullif(direct + grass, 0)), 4) AS lobbying,
  round(CASE WHEN total IS NOT NULL AND total <> 0 THEN total ELSE direct END, 4) AS truthy FROM amounts"""
)
def amount_fallback_chain(spark: SparkSession, d: str) -> DataFrame:
    """The first amount that is reported; and the first that isn't zero, where zero counts as missing."""
    first = F.coalesce("total", "group_total", F.nullif(F.col("direct") + F.col("grass"), F.lit(0.0)))
    truthy = F.when(F.col("total").isNotNull() & (F.col("total") != 0), F.col("total")).otherwise(F.col("direct"))
    return amounts(spark, d).select("filing_id", F.round(first, 4).alias("lobbying"), F.round(truthy, 4).alias("truthy"))


@query(with_(RETURNS) + "SELECT filing_id, ein, tax_year FROM returns WHERE ein IN (1, 5, 8, 13, 77, 100) OR (tax_year BETWEEN 1996 AND 1997 AND ein IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7))")
def in_list_year_state(spark: SparkSession, d: str) -> DataFrame:
    there = table(spark, d, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("ein"), F.lit(True).alias("there")).distinct()
    both = returns(spark, d).join(there, "ein", "left")
    return both.where(F.col("ein").isin(1, 5, 8, 13, 77, 100) | (F.col("tax_year").between(1996, 1997) & F.col("there"))).select("filing_id", "ein", "tax_year")


@query(with_(GRANTS, PARTS_OF) + "SELECT filing_id FROM amounts WHERE coalesce(total >= 90000, false) OR coalesce(group_total >= 90000, false) OR direct >= 9000 OR grass >= 9000")
def any_amount_threshold(spark: SparkSession, d: str) -> DataFrame:
    a = amounts(spark, d)
    return a.where(aggs.any_at_least(["total", "group_total"], 90000) | aggs.any_at_least(["direct", "grass"], 9000)).select("filing_id")


CANDIDATES = "candidates AS (SELECT filing_id, recipient, max(cash) / 1000 AS cs FROM grants GROUP BY filing_id, recipient)"
RANKED = """ranked AS (SELECT *, row_number() OVER w AS rank, lead(cs) OVER w AS next_score, count(*) OVER (PARTITION BY filing_id) AS candidate_count
  FROM candidates WINDOW w AS (PARTITION BY filing_id ORDER BY cs DESC, recipient))"""


def ranked_candidates(spark: SparkSession, d: str) -> DataFrame:
    scored = grants(spark, d).groupBy("filing_id", "recipient").agg((F.max("cash") / 1000).alias("cs"))
    return windows.rank_gap(scored, ["filing_id"], "cs", [F.col("recipient")])


@query(with_(GRANTS, CANDIDATES, RANKED) + "SELECT filing_id, recipient, cs, CAST(rank AS INTEGER) AS rank, candidate_count, cs - coalesce(next_score, 0) AS score_gap FROM ranked")
def candidate_rank_gap(spark: SparkSession, d: str) -> DataFrame:
    return ranked_candidates(spark, d).select("filing_id", "recipient", "cs", "rank", "candidate_count", "score_gap")


EVIDENCE = {
    "n": "candidate_count", "gap": "cs - coalesce(next_score, 0)", "ns": "CAST((recipient % 40 + 60) AS DOUBLE) / 100", "addr_score": "CAST((filing_id % 50 + 50) AS DOUBLE) / 100",
    "exact_name": "CAST(recipient % 3 = 0 AS INTEGER)", "exact_address": "CAST(filing_id % 4 = 0 AS INTEGER)", "zip_match": "CAST(filing_id % 3 = 0 AS INTEGER)", "city_state": "CAST(recipient % 2 = 0 AS INTEGER)",
    "state_match": "CAST(recipient % 5 <> 0 AS INTEGER)", "reported": "CAST(recipient % 11 = 0 AS INTEGER)", "distinctive": "CAST(recipient % 13 <> 0 AS INTEGER)",
}


@query(
    with_(GRANTS, CANDIDATES, RANKED, f"best AS (SELECT filing_id, recipient, cs, {', '.join(f'{v} AS {k}' for k, v in EVIDENCE.items())} FROM ranked WHERE rank = 1)")
    + f"""SELECT filing_id, rule, CASE rule {" ".join(f"WHEN '{r}' THEN {c}" for r, _, c in rules.CANDIDATE_RULES)} ELSE 0 END::DOUBLE AS rule_confidence
FROM (SELECT filing_id, CASE {" ".join(f"WHEN {condition} THEN '{r}'" for r, condition, _ in rules.CANDIDATE_RULES)} ELSE 'needs_ai_or_review' END AS rule FROM best)"""
)
def candidate_rule_bucket(spark: SparkSession, d: str) -> DataFrame:
    best = ranked_candidates(spark, d).where("rank = 1").select("filing_id", "recipient", "cs", *(F.expr(v).alias(k) for k, v in EVIDENCE.items()))
    return rules.accept(best).select("filing_id", "rule", "rule_confidence")


TIERS = (("name_type_size", ("p_name", "p_type", "p_size"), 0.985), ("name_type", ("p_name", "p_type"), 0.97), ("type_size", ("p_type", "p_size"), 0.94), ("name", ("p_name",), 0.88))


@query(
    "WITH "
    + ",\n".join(f"t{i} AS (SELECT {', '.join(k)}, min(p_brand) AS b FROM part WHERE {' AND '.join(f'{c} IS NOT NULL' for c in k)} GROUP BY {', '.join(k)} HAVING count(DISTINCT p_brand) = 1)" for i, (_, k, _) in enumerate(TIERS))
    + "\nSELECT p_partkey, coalesce(t0.b, t1.b, t2.b, t3.b) AS match, CASE "
    + " ".join(f"WHEN t{i}.b IS NOT NULL THEN '{n}'" for i, (n, _, _) in enumerate(TIERS))
    + " ELSE 'unresolved' END AS method, CASE "
    + " ".join(f"WHEN t{i}.b IS NOT NULL THEN {c}" for i, (_, _, c) in enumerate(TIERS))
    + " ELSE 0 END::DOUBLE AS confidence FROM part p "
    + " ".join(f"LEFT JOIN t{i} ON {' AND '.join(f't{i}.{c} = p.{c}' for c in k)}" for i, (_, k, _) in enumerate(TIERS))
)
def tiered_exact_resolution(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return joins.tiered_lookup(part.select("p_partkey", "p_name", "p_type", "p_size"), part, TIERS, "p_brand").select("p_partkey", "match", "method", "confidence")


@query(
    with_(GRANTS, PAIRS, "g AS (SELECT *, filing_id * 100000 + recipient AS grant_id, (filing_id % 100) / 100.0::DOUBLE AS confidence FROM pairs)")
    + """SELECT recipient, count(*) AS grant_count, round(sum(amount), 2) AS total_amount, min(confidence) AS min_confidence, max(confidence) AS max_confidence,
  round(avg(confidence), 6) AS avg_confidence, min(grant_id) AS first_grant_id, max(grant_id) AS last_grant_id, arg_min(filing_id, grant_id) AS sample FROM g GROUP BY recipient"""
)
def signature_rollup(spark: SparkSession, d: str) -> DataFrame:
    g = grant_pairs(spark, d).withColumn("grant_id", F.col("filing_id") * 100000 + F.col("recipient")).withColumn("confidence", (F.col("filing_id") % 100) / 100.0).withColumn("sample", F.col("filing_id"))
    return aggs.signature_rollup(g, "recipient").withColumn("total_amount", F.round("total_amount", 2)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(
    with_(RETURNS, GRANTS, FLOWS, "totals AS (SELECT tax_year, recipient, round(sum(amount), 2) AS amount FROM flows GROUP BY tax_year, recipient)")
    + "SELECT tax_year, recipient, amount, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY tax_year ORDER BY amount DESC, recipient) AS rank FROM totals) WHERE rank <= 5"
)
def top5_per_year(spark: SparkSession, d: str) -> DataFrame:
    totals = flows(spark, d).groupBy("tax_year", "recipient").agg(F.round(F.sum("amount"), 2).alias("amount"))
    return windows.top_k_per_group(totals, ["tax_year"], [F.desc("amount"), F.col("recipient")], 5, rank="rank")


@query(
    with_(RETURNS, "y AS (SELECT ein, tax_year, round(sum(total), 2) AS total FROM returns GROUP BY ein, tax_year)", "p AS (SELECT *, lag(total) OVER (PARTITION BY ein ORDER BY tax_year) AS previous FROM y)")
    + "SELECT ein, tax_year, total, previous, coalesce(total >= 1 AND previous >= 1 AND (total / previous >= 2 OR total / previous <= 0.5), false) AS large_change FROM p"
)
def yoy_change_flags(spark: SparkSession, d: str) -> DataFrame:
    yearly = returns(spark, d).groupBy("ein", "tax_year").agg(F.round(F.sum("total"), 2).alias("total"))
    return windows.year_over_year(yearly, "ein", "tax_year", "total")


@query(
    with_(RETURNS, "y AS (SELECT DISTINCT ein, tax_year FROM returns)", "n AS (SELECT *, lead(tax_year) OVER (PARTITION BY ein ORDER BY tax_year) AS nxt FROM y)")
    + "SELECT ein, unnest(generate_series(tax_year + 1, nxt - 1)) AS tax_year FROM n WHERE nxt > tax_year + 1"
)
def missing_period_gaps(spark: SparkSession, d: str) -> DataFrame:
    return windows.missing_years(returns(spark, d), "ein", "tax_year")


@query(
    """WITH hits AS (
  SELECT 1 AS source_no, r_name AS name, CAST(r_regionkey AS BIGINT) AS id FROM region UNION ALL SELECT 2, n_name, n_nationkey FROM nation
  UNION ALL SELECT 3, s_name, s_suppkey FROM supplier UNION ALL SELECT 4, p_name, p_partkey FROM part)
SELECT name, id, source_no FROM hits WHERE name ILIKE '%i%' ORDER BY source_no, id LIMIT 200"""
)
def multi_source_search(spark: SparkSession, d: str) -> DataFrame:
    def hits(t: str, name: str, key: str) -> DataFrame:
        return table(spark, d, t).select(F.col(name).alias("name"), F.col(key).cast("long").alias("id")).where(F.col("name").ilike("%i%"))

    found = [(1, hits("region", "r_name", "r_regionkey")), (2, hits("nation", "n_name", "n_nationkey")), (3, hits("supplier", "s_name", "s_suppkey")), (4, hits("part", "p_name", "p_partkey"))]
    return sets.search_in_order(found, ["id"], 200)


@query(
    """SELECT 'region' AS branch, CAST(r_regionkey AS BIGINT) AS id, r_name AS name, NULL::BIGINT AS parent, NULL::DOUBLE AS amount FROM region
UNION ALL SELECT 'nation', n_nationkey, n_name, n_regionkey, NULL FROM nation UNION ALL SELECT 'customer', c_custkey, c_name, c_nationkey, c_acctbal FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT 'part', p_partkey, p_name, NULL, p_retailprice FROM part
UNION ALL SELECT 'orders', o_orderkey, o_orderpriority, o_custkey, o_totalprice FROM orders"""
)
def padded_union_six(spark: SparkSession, d: str) -> DataFrame:
    def branch(t: str, **columns: str) -> tuple[str, DataFrame]:
        kinds = {"id": "long", "name": "string", "parent": "long", "amount": "double"}
        return t, table(spark, d, t).select(*(F.col(c).cast(kinds[n]).alias(n) for n, c in columns.items()))

    return sets.union_padded(
        branch("customer", id="c_custkey", name="c_name", parent="c_nationkey", amount="c_acctbal"), branch("region", id="r_regionkey", name="r_name"),
        branch("nation", id="n_nationkey", name="n_name", parent="n_regionkey"), branch("supplier", id="s_suppkey", name="s_name", parent="s_nationkey", amount="s_acctbal"),
        branch("part", id="p_partkey", name="p_name", amount="p_retailprice"), branch("orders", id="o_orderkey", name="o_orderpriority", parent="o_custkey", amount="o_totalprice"),
    )


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows, count(DISTINCT (l_partkey, l_suppkey, l_quantity)) AS n_contents, CASE WHEN count(DISTINCT (l_partkey, l_suppkey, l_quantity)) = 1 THEN 'identical_keep_one' ELSE 'conflict_remove_all' END AS action FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_audit(spark: SparkSession, d: str) -> DataFrame:
    return sets.duplicate_audit(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], F.xxhash64("l_partkey", "l_suppkey", "l_quantity"))


@query(
    """WITH u AS (SELECT l_suppkey, l_quantity, 1 AS n FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_suppkey, l_quantity, -1 FROM lineitem WHERE l_returnflag = 'A')
SELECT l_suppkey, l_quantity, CAST(sum(n) AS BIGINT) AS surplus FROM u GROUP BY ALL HAVING sum(n) <> 0"""
)
def multiset_diff(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem")
    return sets.multiset_difference(*(items.where(F.col("l_returnflag") == f).select("l_suppkey", "l_quantity") for f in ("R", "A")))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F') GROUP BY l_orderkey")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    filed = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return joins.missing(table(spark, d, "lineitem"), filed, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(
    with_(RETURNS, GRANTS)
    + "SELECT filing_id, ein, CAST(max(p) AS INTEGER) AS is_primary FROM (SELECT filing_id, ein, 1 AS p FROM returns UNION ALL SELECT filing_id, recipient, 0 FROM grants) GROUP BY filing_id, ein"
)
def or_join_primary_additional(spark: SparkSession, d: str) -> DataFrame:
    return joins.either_key(returns(spark, d), grants(spark, d).withColumnRenamed("recipient", "ein"), "filing_id", "ein")


@query("SELECT p_name, p_size, min(p_brand) AS p_brand FROM part GROUP BY p_name, p_size HAVING count(DISTINCT p_brand) = 1")
def unique_match_having(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "part").withColumn("key", F.struct("p_name", "p_size"))
    return joins.unique_match(pairs, "key", "p_brand").select("key.p_name", "key.p_size", "p_brand")


@query(
    "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderstatus = 'F' AS INTEGER) DESC, o_totalprice DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1"
)
def accepted_match(spark: SparkSession, d: str) -> DataFrame:
    """One match per union: manual ones first, then by confidence."""
    order = [(F.col("o_orderstatus") == "F").cast("int").desc(), F.desc("o_totalprice"), F.desc("o_orderkey")]
    return windows.latest_per_key(table(spark, d, "orders"), ["o_custkey"], order).select("o_custkey", "o_orderkey", "o_orderstatus")


@query(with_(GRANTS, PAIRS) + "SELECT filing_id, substr(string_agg(CAST(recipient AS VARCHAR), ' || ' ORDER BY recipient), 1, 2000) AS joined FROM pairs GROUP BY filing_id")
def listagg_truncated(spark: SparkSession, d: str) -> DataFrame:
    return aggs.joined_text(grant_pairs(spark, d).withColumn("text", F.col("recipient").cast("string")), "filing_id", "text", "recipient")


@query(
    """WITH s AS (SELECT count(*) AS a, count(DISTINCT l_orderkey) AS b, count(*) FILTER (l_returnflag = 'R') AS c, min(l_quantity) AS e, max(l_quantity) AS f, round(avg(l_discount), 10) AS g FROM lineitem)
SELECT 'rows' AS stat, CAST(a AS DOUBLE) AS value FROM s UNION ALL SELECT 'orders', b FROM s UNION ALL SELECT 'returned', c FROM s
UNION ALL SELECT 'min_quantity', e FROM s UNION ALL SELECT 'max_quantity', f FROM s UNION ALL SELECT 'avg_discount', g FROM s"""
)
def stats_long(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    wanted = {"rows": F.count("*"), "orders": F.countDistinct("l_orderkey"), "returned": F.count_if(F.col("l_returnflag") == "R"), "min_quantity": F.min(q), "max_quantity": F.max(q), "avg_discount": F.round(F.avg("l_discount"), 10)}
    return aggs.long_stats(table(spark, d, "lineitem"), wanted)


@query(
    with_(RETURNS)
    + "SELECT tax_year, return_type, count(*) AS n, count(DISTINCT ein) AS n_filers, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY tax_year), 6) AS percent FROM returns GROUP BY tax_year, return_type"
)
def filing_stats(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    counted = returns(spark, d).groupBy("tax_year", "return_type").agg(F.count("*").alias("n"), F.countDistinct("ein").alias("n_filers"))
    return counted.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("tax_year")), 6))
