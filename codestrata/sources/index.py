"""The index of revisions: symbols with their similarity features, and calls, as Parquet.

It is content-addressed: a file is parsed once for each path and content (blob), whatever the number of commits that hold it. The tables are
partitioned by the commit at whose indexing their files were parsed; of each commit, `files` says which (path, blob) it holds and where that was
parsed, and which paths of the commit indexed before went (state `gone`). `meta` is written last and marks a commit as complete, so an indexing that
broke off is done again, with the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features
from ..operators.extract import extract_calls, extract_symbols
from .stage import stage

TABLES = ("symbols", "calls", "files", "meta")


def with_features(symbols: DataFrame) -> DataFrame:
    """The symbols with key, shingles (hashes), minhash and stems, by which similar code is searched."""
    return symbols.withColumns({
        "key": F.concat_ws(":", "file_path", "qualified_name"), "shingles": features.shingle_hashes("normalized_body"),
        "minhash": features.minhash("normalized_body"), "stems": features.stems("name"),
    })


def similarity_features(symbols: DataFrame) -> DataFrame:
    """key, body_hash, shingles, minhash, stems of each symbol."""
    return with_features(symbols).select("key", "body_hash", "shingles", "minhash", "stems")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _table(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A table over all commits that are complete; None before the first."""
    if not _exists(spark, f"{path}/meta"):
        return None
    t = spark.read.option("recursiveFileLookup", "false").parquet(f"{path}/{name}").withColumn("commit", F.col("commit").cast("string"))
    return t if name == "meta" else t.join(F.broadcast(_table(spark, path, "meta").select("commit")), "commit", "left_semi")  # a row a commit


def save(source: DataFrame, path: str, commit: str) -> dict[str, int]:
    """Indexes the files (path, content) of a commit. Parses only those that no other indexed commit holds under the same path. Returns counts: files, parsed, gone, symbols."""
    spark = source.sparkSession
    now = stage(source.select("path", "content", F.sha2(F.col("content").cast("binary"), 256).alias("blob")), "source")
    own = now.select("path", "blob").distinct()
    held, meta = _table(spark, path, "files"), _table(spark, path, "meta")
    last = None
    if held is not None:
        held = held.where(F.col("commit") != commit)
        last = meta.where(F.col("commit") != commit).orderBy(F.desc("built"), "commit").select("commit").first()
    if last:
        parsed = held.where("state <> 'gone' AND parsed_in <> " + f"'{commit}'").groupBy("path", "blob").agg(F.min("parsed_in").alias("parsed_in"))
        here = own.join(parsed, ["path", "blob"], "left")
        gone = held.where((F.col("commit") == last["commit"]) & (F.col("state") != "gone")).select("path", "blob", "parsed_in").join(own, "path", "left_anti")
    else:
        here = own.withColumn("parsed_in", F.lit(None).cast("string"))
        gone = here.limit(0)
    state = F.when(F.col("parsed_in").isNull(), "parsed").otherwise("kept")
    files = stage(here.select("path", "blob", F.coalesce("parsed_in", F.lit(commit)).alias("parsed_in"), state.alias("state")).unionByName(gone.withColumn("state", F.lit("gone"))), "files")
    fresh = now.join(files.where("state = 'parsed'").select("path", "blob"), ["path", "blob"], "left_semi")
    of = fresh.select(F.col("path").alias("file_path"), "blob")
    symbols = with_features(extract_symbols(fresh)).join(of, "file_path")
    calls = extract_calls(fresh).join(of, "file_path")
    for name, df in (("symbols", symbols), ("calls", calls), ("files", files)):
        df.write.mode("overwrite").parquet(f"{path}/{name}/commit={commit}")
    count = {r["state"]: r["count"] for r in files.groupBy("state").count().collect()}
    there = files.where("state <> 'gone'").select(F.col("path").alias("file_path"), "blob", F.col("parsed_in").alias("commit"))
    n = spark.read.parquet(f"{path}/symbols").withColumn("commit", F.col("commit").cast("string")).join(there, ["file_path", "blob", "commit"], "left_semi").count()
    of_all = {"file_count": count.get("parsed", 0) + count.get("kept", 0), "parsed_count": count.get("parsed", 0), "symbol_count": n}
    spark.range(1).select(*(F.lit(v).cast("long").alias(k) for k, v in of_all.items()), F.current_timestamp().alias("built")).write.mode("overwrite").parquet(f"{path}/meta/commit={commit}")
    return {"files": of_all["file_count"], "parsed": of_all["parsed_count"], "gone": count.get("gone", 0), "symbols": n}


def load(spark: SparkSession, path: str, commit: str) -> dict[str, DataFrame] | None:
    """symbols (with their features), calls, files and meta of a commit; None if it isn't indexed."""
    if not _exists(spark, f"{path}/meta/commit={commit}"):
        return None
    files = _table(spark, path, "files").where(F.col("commit") == commit).drop("commit")
    there = files.where("state <> 'gone'").select(F.col("path").alias("file_path"), "blob", F.col("parsed_in").alias("commit"))
    symbols, calls = (_table(spark, path, t).join(there, ["file_path", "blob", "commit"], "left_semi").drop("blob", "commit") for t in ("symbols", "calls"))
    # numbers of their own, in each file's order: those given when files were parsed may clash between commits
    numbered = symbols.drop("sym_id").repartition("file_path").sortWithinPartitions("file_path", "ord").withColumn("sym_id", F.monotonically_increasing_id())
    return {"symbols": stage(numbered, "symbols"), "calls": calls, "files": files, "meta": _table(spark, path, "meta").where(F.col("commit") == commit)}


def symbols_of(index: dict[str, DataFrame], paths: DataFrame) -> DataFrame:
    """The indexed symbols of some files (path)."""
    return index["symbols"].join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")
