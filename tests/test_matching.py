"""Matching by bodies' hashes, which are costly to make: once each, by all cores."""

import hashlib
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from codestrata.functions import text
from codestrata.operators import matching
from codestrata.plans.bindings import NORMALIZE
from codestrata.sources.stage import spread
from pyspark.sql import functions as F


@pytest.mark.parametrize("match, confidence", [(matching.by_hash, 0.9), (matching.moved_exact, 0.95)])
def test_a_hash_is_made_once(spark, match, confidence):
    made = spark.sparkContext.accumulator(0)

    def digest(body):
        made.add(1)
        return None if body is None else hashlib.sha256(body.encode()).hexdigest()

    def symbols(path, rows):
        df = spark.createDataFrame([(i, kind, path, body) for i, kind, body in rows], "sym_id long, kind string, file_path string, normalized_body string")
        return df.withColumn("body_hash", F.udf(digest, "string")("normalized_body"))

    copies = [(i, "f", "same") for i in (2, 65537, 131073)]  # three blocks of ranks
    old = [(1, "f", "a"), *copies, (3, "g", "same"), (4, None, "b"), (5, "f", None)]
    new = [(11, "f", "a"), (12, "f", "same"), (65550, "f", "same"), (13, "g", "other"), (14, None, "b"), (15, "f", None)]
    found = match(symbols("x", old), symbols("x" if match is matching.by_hash else "y", new)).collect()
    assert sorted((r.old_id, r.new_id, r.confidence) for r in found) == [(1, 11, confidence), (2, 12, confidence), (65537, 65550, confidence)]
    assert made.value == len(old) + len(new)


def test_bodies_are_normalised_as_in_sql(spark):
    """With comments and without, where none is searched for; a body's own mark, white space beyond ASCII."""
    rng = random.Random(30)
    bodies = [None, "", "/", "a / b * c", "//", "/*", "\x01\n\x01", "a//b", "a /* b */ c // d\n e", "http://x y\nz"]
    bodies += ["".join(rng.choice(letters) for _ in range(rng.randrange(25))) for letters in ("a \n\x01", "a \n\t\u00a0\u2003é日", "/*a \n", "/*a\n\x01\u2028 ") for _ in range(200)]
    rows = list(enumerate(bodies))
    got = dict(spark.createDataFrame(rows, "id long, body string").select("id", text.normalize_body("body")).collect())
    duck = duckdb.connect()
    duck.execute("CREATE TABLE t (id BIGINT, body VARCHAR)")
    duck.executemany("INSERT INTO t VALUES (?, ?)", rows)
    assert got == dict(duck.execute(f"SELECT id, {NORMALIZE.format('body')} FROM t").fetchall())
    assert sum("//" in (b or "") or "/*" in (b or "") for b in bodies) > 100


def test_a_large_row_group_is_spread(spark, tmp_path):
    """A file's splits are many, but its rows stand in one of them."""
    rng = random.Random(31)
    rows = pa.table({"doc_id": range(2000), "text": [rng.randbytes(50).hex() for _ in range(2000)]})
    pq.write_table(rows, tmp_path / "one.parquet", row_group_size=2000)
    pq.write_table(rows, tmp_path / "many.parquet", row_group_size=100)
    cores = spark.sparkContext.defaultParallelism
    small = {"spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "1"}
    was = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        one, many = (spark.read.parquet(str(tmp_path / f"{name}.parquet")) for name in ("one", "many"))
        assert one.rdd.getNumPartitions() >= cores and many.rdd.getNumPartitions() >= cores
        dealt = spread(one, "doc_id")
        assert dealt.select(F.spark_partition_id()).distinct().count() >= cores
        assert sorted(r.doc_id for r in dealt.select("doc_id").collect()) == list(range(2000))
        assert spread(many, "doc_id") is many
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
