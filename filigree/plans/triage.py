"""Triage of reported numbers: orders are signatures, their line items candidates, customers the known identities.

Names are runs of two letters, whose ratio SQL can work out: twice the shorter run of the common letter by both lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators import triage
from filigree.sources import decision_files
from filigree.plans.roles import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def signatures(spark: SparkSession, d: str) -> DataFrame:
    k, e = F.col("o_orderkey"), (F.col("o_custkey") + 200_000_000).cast("string")
    own = F.concat(F.substring(e, 1, 2), F.lit("-"), F.substring(e, 3, 7))
    reported = F.when(k % 12 == 0, None).when(k % 12 == 1, "000000000").when(k % 12 == 2, " 12-34").when(k % 12 == 3, "See attached").otherwise(own)
    name = F.when(k % 12 == 4, "See  attached list").when(k % 24 == 5, "").otherwise(F.concat(F.repeat(F.lit("k"), (6 + k % 9).cast("int")), F.repeat(F.lit("V"), (k % 13 * 3).cast("int"))))
    flags = F.when(k % 17 == 0, "a;Reported_EIN_and_name_match_different_known_eins").when(k % 17 == 3, "multiple_eins_at_address")
    statuses = F.when(k % 17 == 1, '{"conflicting_ein_match": 2, "x": 1}').when(k % 17 == 2, '{"conflicting_ein_match": 0}').when(k % 17 == 4, "{broken")
    return table(spark, d, "orders").select(k.alias("signature"), reported.alias("reported_ein"), name.alias("recipient_name"), flags.alias("first_pass_warning_flags"), statuses.alias("first_pass_statuses_json"))


def identities(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    def known(source: str, rank: int, year: int | None, mark: str):
        return F.struct(F.lit(source).alias("source"), F.lit(rank).alias("rank"), F.lit(year).cast("int").alias("year"), F.lit(mark).alias("mark"))

    rows = (
        known("bmf_name", 20, None, "M"), F.when(c % 3 == 0, known("returns_org_name", 10, 2019, "E")), F.when(c % 3 == 0, known("returns_org_name", 10, 2021, "L")),
        F.when(c % 3 == 1, known("returns_dba_name", 12, 2021, "D")),
    )
    each = table(spark, d, "customer").where(c % 4 != 0).select(c, F.inline(F.array_compact(F.array(*rows))))
    norm = F.repeat(F.lit("K"), (5 + c % 11).cast("int"))
    return each.select(
        (c + 200_000_000).cast("string").alias("ein"), "source", F.col("rank").alias("source_rank"), F.col("year").alias("tax_year"), F.concat("mark", F.lit(" "), norm).alias("display_name"), norm.alias("name_norm"),
        F.concat("mark", c.cast("string")).alias("identity_key"),
    )


def candidates(spark: SparkSession, d: str) -> DataFrame:
    n, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    owner = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return table(spark, d, "lineitem").join(owner, "l_orderkey").select(
        F.col("l_orderkey").alias("signature"), F.concat_ws("-", F.lit("C"), n, p, s).alias("candidate_id"), n.alias("candidate_rank"), F.concat(F.lit(" Cand  "), n.cast("string")).alias("candidate_name"),
        F.when(p % 5 < 2, (F.col("o_custkey") + 200_000_000).cast("string")).otherwise("300000000").alias("ein"), F.when(s % 7 != 0, 1).alias("reported_ein_match"), (p % 2).alias("exact_address"),
        F.when(s % 2 == 0, 0.85).otherwise(0.8).alias("address_score"), (p % 3 == 0).cast("int").alias("zip_match"), (s % 3 == 0).cast("int").alias("city_state_match"),
    )


EVIDENCE = """sig AS (SELECT o_orderkey AS k, CAST(o_custkey + 200000000 AS VARCHAR) AS e, o_custkey AS c, o_orderkey % 12 AS v, o_orderkey % 17 AS w,
  CASE WHEN o_orderkey % 12 = 4 THEN 'see_schedule_or_attachment' WHEN o_orderkey % 24 = 5 THEN 'blank_recipient_name' ELSE '' END AS nobody, repeat('k', 6 + o_orderkey % 9) || repeat('V', o_orderkey % 13 * 3) AS nm FROM orders),
ident AS (SELECT c_custkey AS c, 5 + c_custkey % 11 AS size, CASE WHEN c_custkey % 3 = 0 THEN 'L ' ELSE 'M ' END || repeat('K', 5 + c_custkey % 11) AS display, CASE WHEN c_custkey % 3 = 0 THEN 'returns_org_name' ELSE 'bmf_name' END AS source FROM customer WHERE c_custkey % 4 <> 0),
own AS (SELECT l_orderkey AS k, 'C-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, 'Cand ' || l_linenumber AS cand, l_partkey % 2 = 1 AS exact, (l_partkey % 2 = 1 OR l_suppkey % 2 = 0) AND l_suppkey % 7 <> 0 AND (l_partkey % 3 = 0 OR l_suppkey % 3 = 0) AS placed FROM lineitem WHERE l_partkey % 5 < 2
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'C-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey) = 1),
ev AS (SELECT sig.*, size, display, source, id, cand, exact, coalesce(placed, false) AS placed, round(2.0 * least(6 + k % 9, size) / (6 + k % 9 + k % 13 * 3 + size), 4) AS score,
  CASE v WHEN 0 THEN 'reported_ein_blank' WHEN 1 THEN 'reported_ein_placeholder_value' WHEN 2 THEN 'reported_ein_invalid_length_4' WHEN 3 THEN 'reported_ein_blank' ELSE 'ok' END AS validity
  FROM sig LEFT JOIN ident USING (c) LEFT JOIN own USING (k))"""

#: What becomes of a signature, in order; numbers are the cases of both queries.
FATE = """CASE WHEN nobody <> '' THEN 1 WHEN v = 0 THEN 2 WHEN v <= 3 THEN 3 WHEN w <= 1 AND {held} THEN 4 WHEN size IS NULL THEN 5 WHEN score >= 0.72 THEN 6 WHEN score >= 0.35 THEN 7 WHEN placed THEN 8 ELSE 9 END AS fate"""
KNOWN = "concat_ws(',', 'reported_ein_present,reported_ein_found_in_org_identity', source, CASE WHEN w = 3 THEN 'reported_ein_soft_warning_not_treated_as_hard_conflict' END, CASE fate WHEN 6 THEN 'recipient_name_agrees' ELSE 'recipient_name_weakly_agrees' END, CASE WHEN id IS NOT NULL THEN 'reported_ein_candidate_present' END)"
NOBODY = "concat_ws(',', 'recipient_name_nonadjudicable', nobody, 'attachment_or_bulk_list_not_resolved,ollama_skipped', CASE WHEN v <> 0 THEN 'reported_ein_present' END, CASE WHEN v <> 0 THEN validity END)"
AT_PLACE = "'reported_ein_present,reported_ein_known_but_name_disagrees,reported_ein_candidate_present,reported_ein_address_location_match,recipient_name_may_be_alias_or_former_name,ollama_skipped_nonconflicting_reported_ein'"


def shown(decided: DataFrame) -> DataFrame:
    return decided.withColumn("reason_codes", F.array_join("reason_codes", ","))


@query(
    f"""WITH {EVIDENCE}, f AS (SELECT *, {FATE.format(held="true")} FROM ev)
SELECT k AS signature, CASE WHEN fate = 1 THEN 'NO_MATCH' WHEN fate IN (5, 6, 7, 8) THEN 'KEEP_REPORTED_EIN' WHEN fate = 9 THEN 'HUMAN_REVIEW' END AS decision,
  CASE WHEN fate IN (5, 6, 7, 8) THEN coalesce(id, 'REPORTED_EIN') WHEN fate IN (1, 9) THEN '' END AS candidate_id, CASE WHEN fate IN (5, 6, 7, 8) THEN e WHEN fate IN (1, 9) THEN '' END AS selected_ein,
  CASE WHEN fate = 5 THEN nm WHEN fate IN (6, 7) THEN display WHEN fate = 8 THEN cand WHEN fate IN (1, 9) THEN '' END AS selected_name,
  CASE fate WHEN 1 THEN 1.0 WHEN 5 THEN 0.935 WHEN 6 THEN 0.985 WHEN 7 THEN 0.94 WHEN 8 THEN CASE WHEN exact THEN 0.975 ELSE 0.965 END WHEN 9 THEN 0.0 END::DOUBLE AS confidence,
  CASE WHEN fate IN (1, 5, 6, 7, 8) THEN 'high' WHEN fate = 9 THEN 'none' END AS confidence_label,
  CASE fate WHEN 1 THEN {NOBODY} WHEN 5 THEN 'reported_ein_present,reported_ein_valid,reported_ein_not_in_org_identity,recipient_name_present,reported_ein_from_filing_unverified,ollama_skipped' WHEN 6 THEN {KNOWN} WHEN 7 THEN {KNOWN} WHEN 8 THEN {AT_PLACE}
    WHEN 9 THEN 'reported_ein_present,reported_ein_known_but_name_disagrees,ollama_skipped_nonconflicting_reported_ein' END AS reason_codes,
  CASE WHEN fate = 9 THEN 1 WHEN fate IN (1, 5, 6, 7, 8) THEN 0 END::INTEGER AS needs_human_review, CASE WHEN fate IN (1, 9) THEN 0 WHEN fate IN (5, 6, 7, 8) THEN 1 END::INTEGER AS auto_accept,
  CASE fate WHEN 1 THEN 'rule:nonadjudicable_recipient_no_ai' WHEN 5 THEN 'rule:reported_ein_from_filing_unverified' WHEN 6 THEN 'rule:reported_ein_identity_lookup' WHEN 7 THEN 'rule:reported_ein_identity_lookup' WHEN 8 THEN 'rule:reported_ein_address_location' WHEN 9 THEN 'rule:reported_ein_no_ai_review' END AS model_label,
  CASE fate WHEN 1 THEN 'nonadjudicable_recipient_' || nobody WHEN 2 THEN 'no_reported_ein' WHEN 3 THEN validity || '_allowed_to_ollama' WHEN 4 THEN 'reported_ein_contradiction_flagged' WHEN 5 THEN 'reported_ein_unknown_kept_unverified' WHEN 6 THEN 'shortcut_created' WHEN 7 THEN 'shortcut_created'
    WHEN 8 THEN 'reported_ein_known_name_disagrees_address_location_kept_no_ai' ELSE 'reported_ein_known_name_disagrees_human_review_no_ai' END AS outcome,
  CASE WHEN fate = 9 THEN coalesce(id, 'REPORTED_EIN') WHEN fate IN (1, 5, 6, 7, 8) THEN '' END AS evidence_candidate_id, CASE WHEN fate = 9 THEN e WHEN fate IN (1, 5, 6, 7, 8) THEN '' END AS evidence_ein, CASE WHEN fate = 9 THEN display WHEN fate IN (1, 5, 6, 7, 8) THEN '' END AS evidence_name FROM f"""
)
def reported_number_triage(spark: SparkSession, d: str) -> DataFrame:
    return shown(triage.triaged(signatures(spark, d), identities(spark, d), candidates(spark, d)))


@query(
    f"""WITH {EVIDENCE}, f AS (SELECT *, {FATE.format(held="false")} FROM ev),
o AS (SELECT CASE fate WHEN 1 THEN 'nonadjudicable_recipient_' || nobody WHEN 2 THEN 'no_reported_ein' WHEN 3 THEN validity || '_human_review_no_ai' WHEN 5 THEN 'reported_ein_unknown_human_review_no_ai' WHEN 6 THEN 'shortcut_created' WHEN 7 THEN 'shortcut_created'
    WHEN 8 THEN 'reported_ein_known_name_disagrees_address_location_kept_no_ai' ELSE 'recipient_name_disagrees_with_reported_ein_identity' END AS outcome,
  CASE fate WHEN 1 THEN 'rule:nonadjudicable_recipient_no_ai' WHEN 3 THEN 'rule:invalid_reported_ein_no_ai' WHEN 5 THEN 'rule:reported_ein_no_ai_review' WHEN 6 THEN 'rule:reported_ein_identity_lookup' WHEN 7 THEN 'rule:reported_ein_identity_lookup' WHEN 8 THEN 'rule:reported_ein_address_location' ELSE '' END AS model_label, fate IN (6, 7, 8) AS yes FROM f)
SELECT outcome, model_label, count(*) AS n, count(*) FILTER (yes) AS n_accepted FROM o GROUP BY outcome, model_label"""
)
def reported_number_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """With review wherever it may be asked for, contradictions allowed and disagreeing names passed on."""
    decided = triage.triaged(signatures(spark, d), identities(spark, d), candidates(spark, d), contradictions=True, placeholder="human_review", invalid="human_review", unsafe="ollama", unverified="human_review")
    return triage.outcomes(decided)


def records(spark: SparkSession, d: str) -> DataFrame:
    """Orders as answers from elsewhere: flat, wrapped as an object or as a text, with other names, or without a signature."""
    k = F.col("o_orderkey")
    sig, conf = F.concat(F.lit("S"), (k % 5000).cast("string")), (k % 11 / 10).cast("decimal(3,1)").cast("string")
    answer = F.concat(F.lit('{"decision": "SELECT_CANDIDATE", "candidate_id": "C'), (k % 4).cast("string"), F.lit('", "confidence": '), conf, F.lit(', "reason_codes": ["a", " ", "b c"], "needs_human_review": false}'))
    flat = F.create_map(F.lit("id"), sig, F.lit("decision"), F.lit(" NO_MATCH "), F.lit("confidence"), F.when(k % 2 == 0, "high").otherwise(conf), F.lit("reason_codes_json"), F.lit("x; y|,z"), F.lit("needs_human_review"), F.when(k % 3 == 0, "No").otherwise("perhaps"))
    none = F.create_map(F.lit("signature"), F.lit(" "), F.lit("decision"), F.lit("AMBIGUOUS"), F.lit("output"), F.lit("text"))
    wrapped = F.create_map(F.lit("signature_hash"), sig, F.lit("output"), answer, F.lit("decision"), F.lit("ignored"))
    return table(spark, d, "orders").select(k, F.when(k % 4 == 0, flat).when(k % 4 == 1, none).otherwise(wrapped).alias("record"))


@query(
    """WITH r AS (SELECT o_orderkey AS k, o_orderkey % 4 AS v, 'S' || (o_orderkey % 5000) AS s, CAST(o_orderkey % 11 / 10.0 AS DOUBLE) AS conf FROM orders),
o AS (SELECT CASE WHEN v = 1 THEN '' ELSE s END AS signature, CASE v WHEN 0 THEN 'NO_MATCH' WHEN 1 THEN 'AMBIGUOUS' ELSE 'SELECT_CANDIDATE' END AS decision, CASE WHEN v >= 2 THEN 'C' || (k % 4) ELSE '' END AS candidate_id,
  CASE WHEN v >= 2 THEN conf END AS confidence, CASE WHEN v = 0 THEN 'x,y,z' WHEN v = 1 THEN '' ELSE 'a,b c' END AS reason_codes, CASE WHEN v >= 2 OR (v = 0 AND k % 3 = 0) THEN 0 ELSE 1 END::INTEGER AS needs_human_review FROM r),
c AS (SELECT 'S' || c_custkey AS signature, 'C' || (c_custkey % 3) AS candidate_id, c_custkey + 200000000 AS ein FROM customer),
e AS (SELECT 'S' || s_suppkey AS signature FROM supplier)
SELECT o.signature, decision, o.candidate_id, confidence, reason_codes, needs_human_review, c.ein AS selected_ein,
  CASE WHEN o.signature = '' THEN 'missing_signature_hash' WHEN o.signature NOT IN (SELECT 'S' || c_custkey FROM customer) THEN 'signature_not_found' WHEN o.signature IN (SELECT signature FROM e) THEN 'skipped_existing' ELSE 'new' END AS import_status
FROM o LEFT JOIN c ON c.signature = o.signature AND c.candidate_id = o.candidate_id"""
)
def decisions_imported(spark: SparkSession, d: str) -> DataFrame:
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    known = table(spark, d, "customer").select(F.concat(F.lit("S"), c.cast("string")).alias("signature"), F.concat(F.lit("C"), (c % 3).cast("string")).alias("candidate_id"), (c + 200_000_000).alias("ein"))
    decided = table(spark, d, "supplier").select(F.concat(F.lit("S"), s.cast("string")).alias("signature"))
    out = decision_files.imported(decision_files.decisions(records(spark, d)), known, known, decided)
    return out.select("signature", "decision", "candidate_id", "confidence", F.array_join("reason_codes", ",").alias("reason_codes"), "needs_human_review", "selected_ein", "import_status")
