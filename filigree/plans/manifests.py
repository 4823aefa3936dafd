"""A manifest made from parts: two files an object, ten kinds of objects, some not loaded, some loaded without a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators import manifest
from filigree.plans.roles import table

#: By the object's last digit: status of the first file and of the second, '' where there is none.
STATUSES = (
    ("primary_duplicate_group", "exact_duplicate"), ("unique", "unique"), ("primary_duplicate_group", "exact_duplicate"), ("primary_duplicate_group", "primary_duplicate_group"),
    ("primary_duplicate_group", "exact_duplicate"), ("primary_duplicate_group", "exact_duplicate"), ("object_id_conflict", "object_id_conflict"), ("object_id_conflict", "object_id_conflict"), ("maybe", "unique"), ("unique", ""),
)
PROBLEMS = {
    1: "ambiguous_classification", 2: "different_or_unhashed_bytes", 3: "not_one_primary", 4: "incomplete_keep_path", 5: "inconsistent_keep_path", 8: "unresolved_duplicate_status",
}


def manifest_choice(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.expr("p_partkey div 2").alias("o"), (F.col("p_partkey") % 2).alias("second")).withColumn("s", F.col("o") % 10)
    status = F.coalesce(*(F.when((F.col("s") == s) & (F.col("second") == n), text) for s, pair in enumerate(STATUSES) for n, text in enumerate(pair)))
    folder = F.when(F.col("second") == 1, "z/").when(F.col("s") == 7, "y_old/").otherwise("y/")
    name = F.concat(F.col("o").cast("string"), F.lit("_public"))
    files = k.where("s < 9 OR second = 0").select(
        F.col("o").alias("object_id"), name.alias("filing_id"), F.concat(folder, name, F.lit(".xml")).alias("relative_path"), F.concat(F.lit("./"), folder, name, F.lit(".xml")).alias("source_file"),
        F.when((F.col("s") == 2) & (F.col("second") == 1), "b").otherwise("a").alias("sha256"), status.alias("duplicate_status"),
        F.when((F.col("s") == 4) & (F.col("second") == 1), " ").otherwise(F.concat(F.when(F.col("s") == 5, "x/").otherwise("y/"), name, F.lit(".xml"))).alias("keep_source_file"),
        F.when((F.col("s") == 9) & (F.col("o") % 3 == 0), "moved").alias("quarantine_status"),
    )
    objects = k.select("o", "s").distinct().where("o % 7 <> 3").select(F.col("o").cast("string").alias("object_id"), F.concat("o", F.lit("_public")).alias("filing_id"), F.concat(F.lit("C:\\In\\Y\\"), "o", F.lit("_PUBLIC.xml")).alias("source_file"))
    lost = k.where("k % 11 = 0").select(F.concat(F.lit("lost"), "k").alias("object_id"), F.lit("f").alias("filing_id"), F.lit("p").alias("source_file"))
    return manifest.choose(files, objects.unionByName(lost))


QUERIES = {"manifest_choice": manifest_choice}
ORACLES = {
    "manifest_choice": f"""WITH o AS (SELECT p_partkey // 2 AS o, p_partkey // 2 % 10 AS s, count(*) AS n FROM part GROUP BY ALL),
v AS (SELECT o, s, CASE WHEN o % 7 = 3 THEN 'not_loaded' WHEN n = 1 AND s = 0 THEN 'stale_single_classification' WHEN s = 9 AND o % 3 = 0 THEN 'quarantined' {" ".join(f"WHEN s = {s} THEN '{p}'" for s, p in PROBLEMS.items())} END AS problem FROM o)
SELECT CAST(o AS VARCHAR) AS object_id, CASE WHEN problem IS NULL THEN CASE WHEN s = 7 THEN 'y_old/' ELSE 'y/' END || o || '_public.xml' END AS relative_path,
  CASE WHEN problem IS NULL THEN CASE s WHEN 0 THEN 'exact_duplicate_primary' WHEN 6 THEN 'loaded_path' WHEN 7 THEN 'loaded_path_normalized_old' WHEN 9 THEN 'unique' END END AS strategy, problem FROM v
UNION ALL SELECT 'lost' || p_partkey, NULL, NULL, 'no_source' FROM part WHERE p_partkey % 11 = 0""",
}
