"""Body index: keeps the features by which similar code is searched up to date while files of documents arrive.

A file stream takes only files that it hasn't taken yet (its checkpoint knows them) and ends when none is left. The index is content-addressed: features are computed for bodies only that
no earlier batch had, so copies and reruns cost a look-up. OUT/bodies holds one row for each distinct normalised body, OUT/members one for each
document, both partitioned by batch, members by language too. A batch that failed is taken again under its number and replaces what it had
written, and looks at earlier batches only, so the result is the same. The checkpoint and OUT belong together: with a new checkpoint, take a new OUT.

Defined cases: a null text is an empty body; a null or empty language goes to the partition `none`; a null doc_id is carried; repeated rows are members each; no new file, no batch; other columns are
ignored, missing ones are null.

    python -m jobs.body_index DOCUMENTS OUT CHECKPOINT [--config FILE]
"""

from __future__ import annotations

import logging

from codestrata.functions import features, text
from codestrata.sources.stage import stage
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common

DOCUMENTS = "doc_id long, text string, lang string"
BODIES = "body_hash string, body_bytes long, shingles array<long>, minhash array<long>, batch long"
MEMBERS = "doc_id long, body_hash string, lang string, batch long, lang_part string"
_log = logging.getLogger("jobs.body_index")


def table(spark: SparkSession, out: str, name: str) -> DataFrame:
    """bodies or members as they stand."""
    return spark.read.schema({"bodies": BODIES, "members": MEMBERS}[name]).parquet(f"{out}/{name}")


def read(spark: SparkSession, out: str) -> DataFrame:
    """The index: each body with its features, its first document and the number of its copies."""
    of = table(spark, out, "members").groupBy("body_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    return table(spark, out, "bodies").drop("batch").join(of, "body_hash")


def _write(df: DataFrame, path: str, config: dict, number: int, *by: str) -> None:
    """Replaces the partitions of this batch only; the stream gives a batch that is taken again the same files, so they are the same partitions."""
    marked = df.withColumn("batch", F.lit(number).cast("long"))
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", config["records_per_file"]).partitionBy("batch", *by).parquet(path)


def add(batch: DataFrame, number: int, out: str, config: dict) -> None:
    """Adds one batch of documents to the index, in place of what it may have left there before."""
    spark = batch.sparkSession
    body = text.normalize_body(F.coalesce("text", F.lit("")))
    rows = stage(batch.select("doc_id", "lang", body.alias("body")).withColumn("body_hash", text.body_hash("body")), "arrived")
    known = table(spark, out, "bodies").where(F.col("batch") < number).select("body_hash")
    fresh = rows.select("body_hash", "body").dropDuplicates(["body_hash"]).join(known, "body_hash", "left_anti")
    found = fresh.select("body_hash", F.octet_length("body").cast("long").alias("body_bytes"), features.shingle_hashes("body").alias("shingles"), features.minhash("body").alias("minhash"))
    _write(found, f"{out}/bodies", config, number)
    _write(rows.select("doc_id", "body_hash", "lang", F.coalesce(F.nullif("lang", F.lit("")), F.lit("none")).alias("lang_part")), f"{out}/members", config, number, "lang_part")
    wrote = {t: table(spark, out, t).where(F.col("batch") == number).count() for t in ("bodies", "members")}
    _log.info("batch %d: read %d documents, wrote %d new bodies and %d members to %s", number, rows.count(), wrote["bodies"], wrote["members"], out)


def _pattern(path: str) -> str:
    """Streams watch folders and patterns, no single file; as a pattern that only it meets, a path may be of either."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]" if path[-1:].isalnum() else path


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict) -> DataFrame:
    """Adds the documents of all files that are new since the last run to the index."""
    for name, schema, by in (("bodies", BODIES, ["batch"]), ("members", MEMBERS, ["batch", "lang_part"])):  # no rows: so that the first batch finds tables
        spark.createDataFrame([], schema).write.mode("append").partitionBy(*by).parquet(f"{out}/{name}")
    arriving = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(_pattern(documents))
    started = arriving.writeStream.foreachBatch(lambda batch, number: add(batch, number, out, config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()
    index = read(spark, out)
    _log.info("the index at %s holds %d bodies after the files of %s", out, table(spark, out, "bodies").count(), documents)
    return index


if __name__ == "__main__":
    common.main("body_index", run, {"documents": "folder, pattern or file of documents, in Parquet", "out": "folder of the index", "checkpoint": "folder of the stream's checkpoint"})
