"""The jobs: against their SQL, over growing input, after a failed batch, and from the command line's settings."""

import json

import duckdb
import pytest
from jobs import body_index, clone_report, common, queries
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, copies string"


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_sql_says_the_same(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = con.sql(queries.SQL[name])
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df) == sorted((tuple(r[rel.columns.index(c)] for c in sorted(df.columns)) for r in rel.fetchall()), key=str)


def put(spark, folder, rows, name):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{folder}/{name}")


def at(folder):
    return f"{folder}/*"


def index_of(spark, out):
    return {r.body_hash: (r.first_doc, r.copies, r.body_bytes, r.shingles, r.minhash) for r in body_index.read(spark, out).collect()}


FIRST = [(1, "fn a() { one }", "rust", "x", ""), (2, "fn a()  {  one } // note", "rust", "y", ""), (3, None, None, None, ""), (4, "", "", "z", "")]
SECOND = [(5, "fn a() { one }", "go", "x", ""), (6, "fn b() { two }", "go", "x", ""), (6, "fn b() { two }", "go", "x", ""), (None, "fn c() { three }", None, "x", "")]


def test_index_takes_only_what_is_new(spark, tmp_path):
    docs, out, mark = (str(tmp_path / x) for x in ("docs", "out", "mark"))
    config = common.config_of("body_index")
    put(spark, docs, FIRST, "1")
    body_index.run(spark, at(docs), out, mark, config)
    assert body_index.table(spark, out, "bodies").count() == 2 and body_index.table(spark, out, "members").count() == 4
    before = rows_of(body_index.table(spark, out, "bodies"))
    body_index.run(spark, at(docs), out, mark, config)  # nothing new
    assert rows_of(body_index.table(spark, out, "bodies")) == before
    put(spark, docs, SECOND, "2")
    body_index.run(spark, at(docs), out, mark, config)
    added = body_index.table(spark, out, "bodies").where("batch = 1")
    assert added.count() == 2  # the bodies of 6 and of the row without an id; that of 5 was there
    assert body_index.table(spark, out, "members").where("batch = 1").count() == 4
    assert [r.lang_part for r in body_index.table(spark, out, "members").where("batch = 1 AND doc_id IS NULL").collect()] == ["none"]
    put(spark, str(tmp_path / "whole"), FIRST + SECOND, "1")
    body_index.run(spark, at(tmp_path / "whole"), f"{out}2", f"{mark}2", config)
    assert index_of(spark, out) == index_of(spark, f"{out}2")
    assert {v[:2] for v in index_of(spark, out).values()} == {(1, 3), (3, 2), (6, 2), (None, 1)}


def test_small_batches_give_the_same_index(spark, tmp_path):
    docs = str(tmp_path / "docs")
    for i, r in enumerate(FIRST + SECOND):
        put(spark, docs, [r], str(i))
    body_index.run(spark, at(docs), str(tmp_path / "a"), str(tmp_path / "ma"), common.config_of("body_index") | {"files_per_batch": 3})
    body_index.run(spark, at(docs), str(tmp_path / "b"), str(tmp_path / "mb"), common.config_of("body_index"))
    assert body_index.table(spark, str(tmp_path / "a"), "members").select("batch").distinct().count() == 3
    assert index_of(spark, str(tmp_path / "a")) == index_of(spark, str(tmp_path / "b"))


def test_a_failed_batch_is_taken_again(spark, tmp_path, monkeypatch):
    docs, out, mark = (str(tmp_path / x) for x in ("docs", "out", "mark"))
    config = common.config_of("body_index")
    put(spark, docs, FIRST, "1")
    write = body_index._write

    def failing(df, path, *rest):
        if path.endswith("members"):
            raise RuntimeError("the driver is lost here")
        write(df, path, *rest)

    monkeypatch.setattr(body_index, "_write", failing)
    with pytest.raises(Exception, match="lost here"):
        body_index.run(spark, at(docs), out, mark, config)
    assert body_index.table(spark, out, "bodies").count() == 2 and body_index.table(spark, out, "members").count() == 0
    monkeypatch.undo()
    put(spark, docs, SECOND, "2")
    body_index.run(spark, at(docs), out, mark, config)
    put(spark, str(tmp_path / "whole"), FIRST + SECOND, "1")
    body_index.run(spark, at(tmp_path / "whole"), f"{out}2", f"{mark}2", config)
    assert index_of(spark, out) == index_of(spark, f"{out}2")


def test_clone_report_and_its_rerun(spark, tmp_path):
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    put(spark, docs, [*FIRST, *SECOND, (9, "a body of twenty bytes or more", "", None, ""), (8, "a body of  twenty bytes or more", None, "s", "")], "1")
    config = common.config_of("clone_report") | {"least_bytes": 10}
    report = clone_report.run(spark, at(docs), out, config)
    want = {(1, 1, 3, 2, True, "rust"), (2, 1, 3, 2, False, "rust"), (5, 1, 3, 2, False, "go"), (6, 6, 2, 1, True, "go"), (9, 8, 2, 1, False, "none"), (8, 8, 2, 1, True, "none")}
    for _ in range(2):
        got = report.select("doc_id", "class_id", "copies", "sources", "original", "lang_part").collect()
        assert {tuple(r) for r in got} == want and len(got) == 7  # document 6 twice
        report = clone_report.run(spark, at(docs), out, config)
    empty = str(tmp_path / "none")
    spark.createDataFrame([], DOCS).write.parquet(empty)
    assert clone_report.run(spark, empty, str(tmp_path / "out2"), config).count() == 0


def test_a_body_copied_everywhere_makes_no_pairs(spark, tmp_path):
    spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same licence header everywhere").otherwise(F.concat(F.lit("body number "), F.col("id") % 9000)).alias("text"), F.lit("go").alias("lang"), (F.col("id") % 7).cast("string").alias("source")).write.parquet(str(tmp_path / "docs"))
    report = clone_report.run(spark, str(tmp_path / "docs"), str(tmp_path / "out"), common.config_of("clone_report") | {"least_bytes": 1})
    head = report.where("class_id = 0").agg(F.count("*"), F.min("copies"), F.max("sources")).first()
    assert tuple(head) == (10_000, 10_000, 7)


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "c.json").write_text(json.dumps({"least_copies": 5}))
    assert common.config_of("clone_report", str(tmp_path / "c.json"))["least_copies"] == 5
    (tmp_path / "d.json").write_text(json.dumps({"least": 5}))
    with pytest.raises(ValueError, match="least"):
        common.config_of("clone_report", str(tmp_path / "d.json"))
    seen = []

    class Session:
        builder = type("B", (), {"appName": lambda self, n: self, "getOrCreate": lambda self: Session()})()

        def stop(self):
            seen.append("stopped")

    monkeypatch.setattr(common, "SparkSession", Session)
    common.main("clone_report", lambda spark, *rest: seen.append(rest), {"documents": "", "out": ""}, ["in", "there", "--config", str(tmp_path / "c.json")])
    assert seen == [("in", "there", {"least_copies": 5, "least_bytes": 20, "records_per_file": 1000000}), "stopped"]
