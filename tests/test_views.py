"""Interval operators against plain Python."""

import random

from codestrata.plans import views
from pyspark.sql import functions as F

SPANS = "file_path string, id long, line_start int, line_end int"


def made(rng, n, most):
    out = []
    for i in range(n):
        s = rng.randrange(1, most)
        out.append((rng.choice("ab"), i, s, s + rng.choice([0, 1, 2, 7, 8, most // 3, most])))
    return out


def test_covering_equals_plain_python(spark):
    for seed, n, most in ((1, 60, 40), (2, 40, 1000), (3, 1, 5)):
        spans = made(random.Random(seed), n, most)
        df = spark.createDataFrame(spans, SPANS)
        got = views.region_lines(df).collect()
        want = {}
        for f, i, s, e in spans:
            for line in range(s, e + 1):
                want.setdefault((f, line), []).append((s - e, i))
        assert len(got) == len(want) and {(r.file_path, r.line): list(r.regions) for r in got} == {k: [i for _, i in sorted(v)] for k, v in want.items()}
        points = spark.createDataFrame([(f, p) for f in "abc" for p in range(0, 2 * most + 3, 3)], "file_path string, line int")
        small = {(r.file_path, r.line): r.id for r in views.innermost(points, df).collect()}
        assert small == {k: min((-neg, i) for neg, i in v)[1] for k, v in want.items() if k[1] % 3 == 0}


def test_no_spans(spark):
    none = spark.createDataFrame([], SPANS)
    assert views.region_lines(none).count() == 0 and views.innermost(spark.createDataFrame([("a", 1)], "file_path string, line int"), none).count() == 0


def test_rows_grow_with_spans_not_with_lines(spark):
    spans = spark.range(50).select(F.lit("a").alias("file_path"), "id", F.lit(1).alias("line_start"), (F.col("id") * 1_000_000 + 5_000_000).cast("int").alias("line_end"))
    points = spans.select("file_path", F.col("line_end").alias("line"))
    met = views.covering(points, spans)
    assert met.count() == 50 * 51 // 2


def test_nesting_of_many_small_files_makes_no_groups(spark):
    """Depths as a stack of each file has them, read as one sorted stream whatever the number of files, in batches that cut files."""
    rng = random.Random(9)
    spans = [(f"f{rng.randrange(60)}", i, s, s + rng.choice([0, 1, 5, 20])) for i in range(400) for s in [rng.randrange(30)]]
    want, stacks = {}, {}
    for f, i, s, e in sorted(spans, key=lambda r: (r[0], r[2], -r[3], r[1])):
        stack = stacks.setdefault(f, [])
        while stack and s > stack[-1][0]:
            stack.pop()
        want[f, i] = stack[-1][1] + 1 if stack else 0
        stack.append((e, want[f, i]))
    found = views.nesting_depth(spark.createDataFrame(spans, SPANS))
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert {(r.file_path, r.id): r.depth for r in found.collect()} == want and max(want.values()) > 3
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_regions_are_read_as_a_stream(spark, monkeypatch):
    """Files, equal spans, spans without lines and nulls, against a count line by line; no task gathers rows by line."""
    rng = random.Random(9)
    monkeypatch.setattr(views, "STRETCHES", 3)
    rows = [(rng.choice("abc"), rng.randrange(40), rng.choice([0, 1, 2, 5, 30]), rng.choice([None, *range(9)])) for _ in range(80)]
    rows = [(f, s, s + n, i) for f, s, n, i in rows] + [(None, 1, 2, 1), ("a", None, 3, 1), ("a", 4, None, 1), ("a", 9, 8, 1), ("e", 7, 7, 5), ("e", 7, 7, 5)]
    got = views.region_lines(spark.createDataFrame(rows, "file_path string, line_start int, line_end int, id long"))
    assert "collect_list" not in got._jdf.queryExecution().toString()
    want = {}
    for f, s, e, i in rows:
        if None not in (f, s, e):
            for line in range(s, e + 1):
                want.setdefault((f, line), []).append((s - e, i is not None, i or 0, i))
    assert {(r.file_path, r.line): r.regions for r in got.collect()} == {k: [x[3] for x in sorted(v, key=lambda x: x[:3])] for k, v in want.items()}
    assert got.count() == len(want)
