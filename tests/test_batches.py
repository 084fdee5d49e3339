"""What is made of a batch of rows is handed on in parts, over all cores."""

import pandas as pd
from codestrata.functions import features
from codestrata.operators import extract, linediff


def test_files_of_one_partition_are_parsed_by_all_cores_in_parts(spark):
    files = spark.createDataFrame([(f"p/{k}.py", f"def f{k}():\n    return g{k}()\n") for k in range(1000)], "path string, content string").coalesce(1)
    assert extract._sources(files).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    parts = [len(p) for p in extract._parts(iter([pd.DataFrame({"path": ["a.py"] * 600, "content": [""] * 600, "language": ["python"] * 600})]))]
    assert parts == [256, 256, 88]
    assert {(r.caller, r.callee) for r in extract.extract_calls(files).collect()} == {(f"f{k}", f"g{k}") for k in range(1000)}


def test_results_are_handed_on_by_size_of_texts(spark):
    texts = pd.Series(["x" * 1000, None, "", "y" * 300_000, *(["abcd " * 100] * 2000)])
    parts = [p[0] for p in features.slices(texts)]
    assert len(parts) == 5 and pd.concat(parts).equals(texts) and max(p.str.len().sum() for p in parts) <= features.SLICE + 300_000
    assert list(features.slices(pd.Series([], dtype=object))) == []
    rows = [(k, "a b\n" * (k % 7), "a c\n" * (k % 5)) for k in range(50)]
    df = spark.createDataFrame(rows, "k long, a string, b string").coalesce(1)
    got = df.select("k", features.minhash("a").alias("m"), features.shingle_hashes("b").alias("s"), linediff.body_diff("a", "b").alias("d")).collect()
    assert [r.k for r in got] == list(range(50))
    for r, (_, a, b) in zip(got, rows, strict=True):
        assert r.m == features._signature(features._hash_grams(a)).tolist() and r.s == features._hash_grams(b).view("int64").tolist()
        assert [(x.tag, [tuple(s) for s in x.spans]) for x in r.d] == linediff.diff_lines(a, b)
