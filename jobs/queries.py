"""The jobs as registered queries: each runs its job twice into one new folder and returns what stands there."""

from __future__ import annotations

import uuid

from codestrata.plans.bindings import NORMALIZE
from codestrata.plans.queries import _SIGNATURES
from codestrata.sources.stage import shared_dir
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import body_index, clone_report
from jobs.common import config_of


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def job1_clone_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "clone_report")
    for _ in range(2):
        report = clone_report.run(spark, f"{sf_dir}/documents.parquet", out, config_of("clone_report"))
    return report


def job2_body_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index with its arrays as text: the number of shingles and the unsigned minima."""
    out = _folder(spark, "body_index")
    for _ in range(2):
        index = body_index.run(spark, f"{sf_dir}/documents.parquet", f"{out}/index", f"{out}/checkpoint", config_of("body_index"))
    plain = F.array_join(F.transform("minhash", lambda m: F.when(m < 0, m.cast("decimal(20,0)") + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(m.cast("decimal(20,0)")).cast("string")), ",")
    return index.select("body_hash", "body_bytes", F.size("shingles").cast("long").alias("n_shingles"), plain.alias("minhash"), "copies", "first_doc")


QUERIES = {f.__name__: f for f in (job1_clone_report, job2_body_index)}

_BODY = NORMALIZE.format("coalesce(text, '')")
_CONFIG = config_of("clone_report")
SQL = {
    "job1_clone_report": (
        f"WITH b AS (SELECT doc_id, lang, source, {_BODY} AS body FROM documents), c AS (SELECT body, min(doc_id) AS class_id, count(*) AS copies, count(DISTINCT source) AS sources FROM b GROUP BY body) "
        "SELECT doc_id, source, class_id, copies, sources, strlen(body)::BIGINT AS body_bytes, doc_id IS NOT DISTINCT FROM class_id AS original, lang, coalesce(nullif(lang, ''), 'none') AS lang_part "
        f"FROM b JOIN c USING (body) WHERE copies >= {_CONFIG['least_copies']} AND strlen(body) >= {_CONFIG['least_bytes']}"
    ),
    "job2_body_index": (
        f"WITH RECURSIVE {_SIGNATURES}, h AS (SELECT norm, min(doc_id) AS first_doc, count(*) AS copies FROM t GROUP BY norm), v AS (SELECT doc_id, string_agg(value, ',' ORDER BY position) AS minhash FROM sig GROUP BY doc_id) "
        "SELECT sha256(norm) AS body_hash, strlen(norm)::BIGINT AS body_bytes, len(grams)::BIGINT AS n_shingles, minhash, copies, first_doc FROM h JOIN v ON v.doc_id = first_doc JOIN s ON s.doc_id = first_doc"
    ),
}
