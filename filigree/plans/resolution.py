"""The resolver on the driver's tables. Names are one letter six times, so a similarity is 1 or 0 and SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators import resolve, retrieval
from filigree.plans.roles import table, with_

IDX = """idx AS (SELECT CAST(s_suppkey AS VARCHAR) AS ein, repeat(chr(CAST(65 + s_suppkey % 26 AS INTEGER)), 6) AS name, 'ADDR' || (s_suppkey % 13) AS address, 'C' || s_nationkey AS city, 'S' || (s_nationkey % 5) AS state, 'Z' || (s_suppkey % 17) AS zip5 FROM supplier)"""
ROW = """r AS (SELECT DISTINCT l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS grant_id, CASE l_partkey % 4 WHEN 0 THEN CAST(l_suppkey AS VARCHAR) WHEN 1 THEN 'x' || l_suppkey END AS reported,
  CASE WHEN l_partkey % 7 <> 0 THEN repeat(chr(CAST(65 + (l_suppkey + l_partkey % 3) % 26 AS INTEGER)), 6) END AS name, CASE WHEN l_partkey % 5 <> 0 THEN 'ADDR' || ((l_suppkey + l_partkey % 2) % 13) END AS address,
  CASE WHEN l_linenumber % 2 = 0 THEN 'C' || (l_partkey % 25) END AS city, CASE WHEN l_linenumber % 3 <> 0 THEN 'S' || (l_partkey % 5) END AS state, CASE WHEN l_orderkey % 3 <> 0 THEN 'Z' || ((l_suppkey + l_orderkey % 2) % 17) END AS zip5 FROM lineitem)"""


def unique(n: str, keys: str) -> str:
    return f"{n} AS (SELECT {keys}, min(ein) AS e FROM idx GROUP BY {keys} HAVING count(DISTINCT ein) = 1)"


def pool(n: str, keys: str) -> str:
    return f"{n} AS (SELECT {keys}, count(*) AS n, min(ein) AS e, list(name) AS names, list(ein) AS eins FROM idx GROUP BY {keys})"


def on(t: str, keys: str) -> str:
    return f"LEFT JOIN {t} ON " + " AND ".join(f"{t}.{k.strip()} = r.{k.strip()}" for k in keys.split(","))


TIERS = (("n1", "name, address, zip5"), ("n2", "name, address, city, state"), ("n3", "name, zip5"), ("n4", "name, city, state"), ("l1", "name, state"), ("l2", "name"))
POOLS = (("a1", "address, zip5", "address_zip", 0.9), ("a2", "address, city, state", "address_city_state", 0.875))


def address_sql(t: str, label: str, base: float) -> tuple[str, str, str, str]:
    """SQL for the organisation, method, confidence and status of one address pool."""
    alone = f"{t}.n = 1 AND (r.name IS NULL OR list_contains({t}.names, r.name))"
    one = f"{t}.n > 1 AND len(list_filter({t}.names, lambda x: x = r.name)) = 1"
    ein = f"CASE WHEN {alone} THEN {t}.e WHEN {one} THEN {t}.eins[list_position({t}.names, r.name)] END"
    method = f"CASE WHEN {t}.n = 1 THEN '{label}_unique' ELSE '{label}_name_within_address' END"
    confidence = f"CASE WHEN {t}.n > 1 THEN 0.95 WHEN r.name IS NULL THEN {base} ELSE {min(0.96, base + 0.05)} END"
    return ein, method, confidence, f"CASE WHEN {t}.n = 1 THEN 'address_unique' ELSE 'address_narrowed_name_match' END"


PARTS = [
    ("CASE WHEN k.ein IS NOT NULL AND (r.name IS NULL OR r.name = k.name) THEN k.ein END", "CASE WHEN r.name IS NULL THEN 'reported_ein_known_no_name_to_validate' ELSE 'reported_ein_known_name_agrees' END", "CASE WHEN r.name IS NULL THEN 0.92 ELSE 0.99 END", "'ein_exact'"),
    *((f"{t}.e", f"'{m}'", str(c), "'name_address_high_confidence'") for t, m, c in (("n1", "name_address_zip_exact", 0.985), ("n2", "name_address_city_state_exact", 0.975), ("n3", "name_zip_exact", 0.97), ("n4", "name_city_state_exact", 0.95))),
    *(address_sql(t, label, base) for t, _, label, base in POOLS),
    *((f"{t}.e", f"'{m}'", str(c), "'name_exact'") for t, m, c in (("l1", "name_state_exact", 0.94), ("l2", "name_unique_national_exact", 0.88))),
]
JOINED = "j AS (SELECT r.grant_id, r.reported, r.name, k.ein AS known, k.name AS known_name, " + ", ".join(f"{e} AS e{i}, {m} AS m{i}, {c} AS c{i}, {s} AS s{i}" for i, (e, m, c, s) in enumerate(PARTS))
JOINED += " FROM r LEFT JOIN idx k ON k.ein = r.reported " + " ".join(on(t, k) for t, k in TIERS) + " " + " ".join(on(t, k) for t, k, _, _ in POOLS) + ")"


def first(column: str, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN e{i} IS NOT NULL THEN {column}{i}" for i in range(len(PARTS))) + f" ELSE {otherwise} END"


SQL = (
    with_(IDX, ROW, *(unique(t, k) for t, k in TIERS), *(pool(t, k) for t, k, _, _ in POOLS), JOINED)
    + f""", o AS (SELECT *, {first('e', 'NULL')} AS resolved_ein, {first('m', "'none'")} AS method, {first('c', '0')}::DOUBLE AS confidence, {first('s', "'unresolved'")} AS s FROM j)
SELECT grant_id, resolved_ein, method, confidence, CASE WHEN resolved_ein IS NULL OR reported IS NULL OR resolved_ein = reported THEN s WHEN known IS NULL THEN 'reported_ein_not_found_name_matched'
  WHEN coalesce(name = known_name, FALSE) THEN 'conflicting_ein_match' ELSE 'possible_bad_ein_corrected' END AS status FROM o"""
)


def letters(n: Column) -> Column:
    return F.repeat(F.char(n % 26 + 65), 6)


def named(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), n.cast("string"))


def resolve_recipients(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    index = table(spark, d, "supplier").select(
        k.cast("string").alias("ein"), letters(k).alias("name"), named("ADDR", k % 13).alias("address"), named("C", n).alias("city"), named("S", n % 5).alias("state"), named("Z", k % 17).alias("zip5"),
        (k % 3 + 2000).cast("int").alias("tax_year"), named("f", k).alias("filing_id"),
    )
    s, p, o, i = (F.col(c) for c in ("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber"))
    rows = table(spark, d, "lineitem").select(
        F.expr("l_orderkey * 1000000000 + l_linenumber * 100000000L + l_partkey * 1000 + l_suppkey").alias("grant_id"), F.when(p % 4 == 0, s.cast("string")).when(p % 4 == 1, named("x", s)).alias("reported_ein"),
        F.when(p % 7 != 0, letters(s + p % 3)).alias("name"), F.when(p % 5 != 0, named("ADDR", (s + p % 2) % 13)).alias("address"), F.when(i % 2 == 0, named("C", p % 25)).alias("city"),
        F.when(i % 3 != 0, named("S", p % 5)).alias("state"), F.when(o % 3 != 0, named("Z", (s + o % 2) % 17)).alias("zip5"),
    ).dropDuplicates(["grant_id"])
    return resolve.resolve(rows, index).select("grant_id", "resolved_ein", "method", "confidence", "status")


IDENTITIES = """i AS (SELECT o_orderkey AS identity_id, CAST(o_custkey AS VARCHAR) AS ein, 'N' || (o_custkey % 97) AS name, CASE WHEN o_orderkey % 9 <> 0 THEN 'A' || (o_orderkey % 23) END AS address, 'C' || (o_custkey % 25) AS city,
  'S' || (o_custkey % 5) AS state, CASE WHEN o_orderkey % 8 <> 0 THEN 'Z' || (o_orderkey % 10) END AS zip5, o_orderkey % 4 AS source_rank, year(o_orderdate) AS tax_year, CAST(o_custkey AS VARCHAR) AS reported_ein FROM orders)"""
SIGNATURES = """s AS (SELECT p_partkey AS signature, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) END AS reported_ein, CASE WHEN p_partkey % 7 <> 0 THEN 'N' || (p_partkey % 101) END AS name, CASE WHEN p_partkey % 5 <> 0 THEN 'A' || (p_size % 23) END AS address,
  CASE WHEN p_partkey % 4 <> 0 THEN 'C' || (p_partkey % 25) END AS city, CASE WHEN p_partkey % 11 <> 0 THEN 'S' || (p_partkey % 5) END AS state, CASE WHEN p_size % 2 = 0 THEN 'Z' || (p_size % 10) END AS zip5 FROM part)"""


def lookup_sql(keys: tuple[str, ...], most: int) -> str:
    k = ", ".join(keys)
    return f"SELECT signature, identity_id FROM s JOIN (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY source_rank, tax_year DESC, identity_id) <= {most}) x USING ({k})"


NINE = (
    (("reported_ein",), 75), (("name", "address", "zip5"), 50), (("name", "address", "city", "state"), 50), (("name", "zip5"), 50), (("name", "city", "state"), 50), (("address", "zip5"), 100), (("address", "city", "state"), 100),
    (("name", "state"), 75), (("name",), 75),
)


def looked_up(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts as signatures and orders as identities, as in SIGNATURES and IDENTITIES."""
    o, c, p, z = (F.col(x) for x in ("o_orderkey", "o_custkey", "p_partkey", "p_size"))
    identities = table(spark, d, "orders").select(
        o.alias("identity_id"), c.cast("string").alias("ein"), named("N", c % 97).alias("name"), F.when(o % 9 != 0, named("A", o % 23)).otherwise("").alias("address"), named("C", c % 25).alias("city"), named("S", c % 5).alias("state"),
        F.when(o % 8 != 0, named("Z", o % 10)).alias("zip5"), (o % 4).alias("source_rank"), F.year("o_orderdate").alias("tax_year"),
    )
    signatures = table(spark, d, "part").select(
        p.alias("signature"), F.when(p % 3 == 0, p.cast("string")).alias("reported_ein"), F.when(p % 7 != 0, named("N", p % 101)).alias("name"), F.when(p % 5 != 0, named("A", z % 23)).otherwise("").alias("address"),
        F.when(p % 4 != 0, named("C", p % 25)).alias("city"), F.when(p % 11 != 0, named("S", p % 5)).alias("state"), F.when(z % 2 == 0, named("Z", z % 10)).alias("zip5"),
    )
    return signatures, identities


def candidate_lookups(spark: SparkSession, d: str) -> DataFrame:
    signatures, identities = looked_up(spark, d)
    keys = ["reported_ein", "name", "address", "city", "state", "zip5"]
    return resolve.lookups(resolve.blank_as_null(signatures, keys), resolve.blank_as_null(identities, keys))


def posting_sql(n: int, keys: tuple[str, ...]) -> str:
    k, given = f"concat_ws('\u241f', {', '.join(keys)})", " AND ".join(f"{c} IS NOT NULL" for c in keys)
    return f"SELECT 'signature' AS side, CAST(signature AS VARCHAR) AS id, {n} AS lookup, {k} AS key FROM s WHERE {given} UNION ALL SELECT 'identity', CAST(identity_id AS VARCHAR), {n}, {k} FROM i WHERE {given}"


def candidate_lookups_all(spark: SparkSession, d: str) -> DataFrame:
    """What candidate_lookups finds without its limits: signatures and identities by the keys they share, with the number of those on the other side."""
    signatures, identities = looked_up(spark, d)
    keys = ["reported_ein", "name", "address", "city", "state", "zip5"]
    return resolve.postings(resolve.blank_as_null(signatures, keys), resolve.blank_as_null(identities, keys))


# every name begins with one common word; places are sizes
WORDS_SQL = """WITH n AS (SELECT p_partkey AS k, p_size AS place, list_concat(['ALL'], string_split(upper(p_name), ' ')) AS w, p_partkey % 3 AS source_rank FROM part),
q AS (SELECT k, place, unnest(list_distinct(list_concat([w[len(w)]], w[1:3]))) AS t FROM n), e AS (SELECT k AS entry, place, source_rank, unnest(list_distinct(w)) AS t FROM n),
h AS (SELECT q.k AS query, entry, source_rank, count(*) AS hits FROM q JOIN e USING (place, t) GROUP BY q.k, entry, source_rank)
SELECT query, entry, CAST(hits AS INTEGER) AS hits, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hits DESC, source_rank, entry) AS r FROM h) WHERE r <= 20"""


def shared_words(spark: SparkSession, d: str) -> DataFrame:
    """The 20 parts of a size that share most words with each, by their last word and the first three."""
    w = F.concat(F.array(F.lit("ALL")), F.split(F.upper("p_name"), " "))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("entry"), F.col("p_partkey").alias("query"), F.col("p_size").alias("place"), w.alias("tokens"), (F.col("p_partkey") % 3).alias("source_rank"))
    asked = parts.select("query", "place", F.array_distinct(F.concat(F.array(F.element_at("tokens", -1)), F.slice("tokens", 1, 3))).alias("tokens"))
    return retrieval.shared_tokens(asked, parts, query="query", entry="entry", tokens="tokens", place="place", order=["source_rank", "entry"], k=20)


QUERIES = {"resolve_recipients": resolve_recipients, "candidate_lookups": candidate_lookups, "candidate_lookups_all": candidate_lookups_all, "shared_words": shared_words}
ALL_KEYS = f"p AS ({' UNION ALL '.join(posting_sql(n, keys) for n, (keys, _) in enumerate(NINE, 1))}), m AS (SELECT lookup, key, count(*) FILTER (side = 'signature') AS ns, count(*) FILTER (side = 'identity') AS ni FROM p GROUP BY lookup, key)"
ORACLES = {"candidate_lookups_all": with_(IDENTITIES, SIGNATURES, ALL_KEYS) + "SELECT side, id, lookup, key, CASE side WHEN 'signature' THEN ni ELSE ns END AS n FROM p JOIN m USING (lookup, key) WHERE ns > 0 AND ni > 0", "resolve_recipients": SQL, "candidate_lookups": with_(IDENTITIES, SIGNATURES) + "SELECT DISTINCT * FROM (" + " UNION ALL ".join(lookup_sql(*n) for n in NINE) + ")", "shared_words": WORDS_SQL}
