"""Clone report: which bodies of a code base stand in several places, so that a change of one has to be carried to the others.

Reads the documents table (doc_id, text, lang, source), normalises the bodies and writes each one that has copies with its class: the least
doc_id of the class, the number of copies and of sources they stand in, and whether it is the one that the others repeat. One row a document; no pairs are made, so a body that is
copied everywhere costs no more than others. The output is partitioned by language and replaced as a whole, so a rerun ends with the same result.

Defined cases: a null text is an empty body, which least_bytes leaves out; a null or empty language goes to the partition `none`; a null source counts for no source; repeated rows
are copies; an empty table gives an empty report; other columns are ignored.

    python -m jobs.clone_report DOCUMENTS OUT [--config FILE]
"""

from __future__ import annotations

import logging

from codestrata.functions import text
from codestrata.operators import similar
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common

SCHEMA = "doc_id long, source string, class_id long, copies long, sources long, body_bytes long, original boolean, lang string, lang_part string"
_log = logging.getLogger("jobs.clone_report")


def read(spark: SparkSession, out: str) -> DataFrame:
    """The report as it stands."""
    return spark.read.schema(SCHEMA).parquet(out)


def run(spark: SparkSession, documents: str, out: str, config: dict) -> DataFrame:
    """Writes the documents whose normalised body has copies, with their classes, partitioned by language."""
    body = text.normalize_body(F.coalesce("text", F.lit("")))
    bodies = spark.read.parquet(documents).select(F.col("doc_id").cast("long").alias("key"), "lang", "source", body.alias("body")).select("key", "lang", "source", F.octet_length("body").cast("long").alias("body_bytes"), text.body_hash("body").alias("body_hash"))
    classes = similar.exact_classes(bodies, sources=F.count_distinct("source"))
    kept = classes.where((F.col("copies") >= config["least_copies"]) & (F.col("body_bytes") >= config["least_bytes"]))
    report = kept.select(
        F.col("key").alias("doc_id"), "source", F.col("class_key").alias("class_id"), "copies", "sources", "body_bytes", F.col("key").eqNullSafe(F.col("class_key")).alias("original"),
        "lang", F.coalesce(F.nullif("lang", F.lit("")), F.lit("none")).alias("lang_part"),
    )
    report.write.mode("overwrite").option("maxRecordsPerFile", config["records_per_file"]).partitionBy("lang_part").parquet(out)
    written = read(spark, out)
    n, n_classes = written.agg(F.count("*"), F.count_distinct("class_id")).first()
    _log.info("read %d documents from %s, wrote %d in %d classes to %s", spark.read.parquet(documents).count(), documents, n, n_classes, out)
    return written


if __name__ == "__main__":
    common.main("clone_report", run, {"documents": "Parquet of doc_id, text, lang, source", "out": "folder of the report"})
