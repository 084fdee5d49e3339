"""The driver's tables as the engine's relations.

Two snapshots of documents stand for two versions of a code base: ten documents make a file, doc_id is the order in it, the language is
the kind. In the new one a quarter of the files has moved, a fifth of the bodies is edited, and a tenth of the symbols is another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources.stage import spread

PARAMETERS = "array<struct<name:string,type_annotation:string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(df: DataFrame, path: Column, qualified: Column, body: Column, visibility: Column) -> DataFrame:
    norm = text.normalize_body(body)
    return df.select(
        F.col("doc_id").alias("sym_id"), F.col("lang").alias("kind"), F.concat(F.lit("d"), F.col("doc_id") % 50, F.lit("_"), F.floor(F.col("doc_id") / 500)).alias("name"), qualified.alias("qualified_name"), path.alias("file_path"),
        ((F.col("doc_id") % 10) * 10 + 1).cast("int").alias("line_start"), ((F.col("doc_id") % 10) * 10 + 9).cast("int").alias("line_end"), F.lit("").alias("signature"), body.alias("body_text"), norm.alias("normalized_body"),
        F.lit(None).cast("string").alias("parent"), visibility.alias("visibility"), F.expr(f"cast(array() AS {PARAMETERS})").alias("parameters"), F.lit(None).cast("string").alias("return_type"), F.expr("cast(array() AS array<bigint>)").alias("ast_fingerprint"),
    ).withColumn("body_hash", text.body_hash("normalized_body"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    path = F.concat(F.lit("pkg/f"), F.floor(F.col("doc_id") / 10).cast("string"), F.lit(".rs"))
    qualified = F.concat(F.lit("d"), F.col("doc_id"))
    old = symbols(d, path, qualified, F.col("text"), F.lit("Public"))
    other, moved, edited = F.col("doc_id") % 10 == 7, F.floor(F.col("doc_id") / 10) % 4 == 0, F.col("doc_id") % 5 == 0
    body = F.when(other, F.reverse("text")).when(edited, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    new = symbols(d, F.when(moved, F.concat(F.lit("moved/"), path)).otherwise(path), F.when(other, F.concat(F.lit("n"), F.col("doc_id"))).otherwise(qualified), body, F.when(F.col("doc_id") % 7 == 0, "Private").otherwise("Public"))
    return old, new


#: The same snapshots in DuckDB: columns o_*/n_* as in snapshots(); q marks where normalised bodies are needed.
NORMALIZE = (
    r"trim(replace(replace(regexp_replace(regexp_replace(replace({0}, chr(10), chr(1) || chr(10)), "
    r"'//[^\n]*?(?:(\x01)\n|\z)|/\*(?:.|\n)*?(?:\*/|\z)|\x01(\n)', '\1\2', 'g'), "
    r"'[\s\x{{0B}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'), chr(1) || ' ', chr(1)), chr(1), ' '))"
)
SNAPSHOT_SQL = f"""
base AS (SELECT doc_id, lang AS kind, 'd' || (doc_id % 50) || '_' || (doc_id // 500) AS name, 'pkg/f' || (doc_id // 10) || '.rs' AS path, text FROM documents),
o AS (SELECT doc_id AS sym_id, kind, name, 'd' || doc_id AS qualified_name, path AS file_path, {NORMALIZE.format("text")} AS norm, 'Public' AS visibility, text AS body FROM base),
n0 AS (SELECT doc_id, kind, name, CASE WHEN doc_id % 10 = 7 THEN 'n' ELSE 'd' END || doc_id AS qualified_name, CASE WHEN (doc_id // 10) % 4 = 0 THEN 'moved/' || path ELSE path END AS file_path,
  CASE WHEN doc_id % 10 = 7 THEN reverse(text) WHEN doc_id % 5 = 0 THEN text || ' edited' ELSE text END AS body, CASE WHEN doc_id % 7 = 0 THEN 'Private' ELSE 'Public' END AS visibility FROM base),
n AS (SELECT doc_id AS sym_id, kind, name, qualified_name, file_path, {NORMALIZE.format("body")} AS norm, visibility, body FROM n0)
"""
MATCH_SQL = (
    SNAPSHOT_SQL
    + """,
o1 AS (SELECT *, row_number() OVER (PARTITION BY file_path, qualified_name ORDER BY sym_id) AS rn FROM o),
n1 AS (SELECT *, row_number() OVER (PARTITION BY file_path, qualified_name ORDER BY sym_id) AS rn FROM n),
m1 AS (SELECT o1.sym_id AS old_id, n1.sym_id AS new_id, CASE WHEN o1.norm = n1.norm THEN 1.0 ELSE 0.95 END::DOUBLE AS confidence FROM o1 JOIN n1 USING (file_path, qualified_name, rn)),
ou1 AS (SELECT * FROM o WHERE sym_id NOT IN (SELECT old_id FROM m1)), nu1 AS (SELECT * FROM n WHERE sym_id NOT IN (SELECT new_id FROM m1)),
o2 AS (SELECT *, row_number() OVER (PARTITION BY file_path, norm, kind ORDER BY sym_id) AS rn FROM ou1),
n2 AS (SELECT *, row_number() OVER (PARTITION BY file_path, norm, kind ORDER BY sym_id) AS rn FROM nu1),
m2 AS (SELECT o2.sym_id AS old_id, n2.sym_id AS new_id, 0.9::DOUBLE AS confidence FROM o2 JOIN n2 USING (file_path, norm, kind, rn)),
ou AS (SELECT * FROM ou1 WHERE sym_id NOT IN (SELECT old_id FROM m2)), nu AS (SELECT * FROM nu1 WHERE sym_id NOT IN (SELECT new_id FROM m2)),
o3 AS (SELECT *, row_number() OVER (PARTITION BY norm, kind ORDER BY sym_id) AS rn FROM ou),
n3 AS (SELECT *, row_number() OVER (PARTITION BY norm, kind ORDER BY sym_id) AS rn FROM nu),
m3 AS (SELECT o3.sym_id AS old_id, n3.sym_id AS new_id, 0.95::DOUBLE AS confidence FROM o3 JOIN n3 USING (norm, kind, rn)),
ou3 AS (SELECT * FROM ou WHERE sym_id NOT IN (SELECT old_id FROM m3)), nu3 AS (SELECT * FROM nu WHERE sym_id NOT IN (SELECT new_id FROM m3))
"""
)
