import re

import corpus_pipeline as cp
from codestrata.llm import decontam, packing
from test_decontam import brute as leaking
from test_neardup import brute as groups
from test_packing import ids_of
from test_spans import PII
from test_spans import base as spans


def redacted(text):
    out, at = [], 0
    for s, _, e, kind in spans(text, PII):
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def test_stages_against_plain_python(spark, sf):
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    before = set(rows)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        after = {r.doc_id: r for r in out.collect()}
        if name == "language_id":
            assert {i for i in before if re.search(r"[^\W\d_]", rows[i].text or "")} == set(after)
        elif name == "near_dedup":
            assert set(after) == {i for i, x in groups([(i, rows[i].text) for i in before], cp.NEAR_PERCENT).items() if x[2]}
        elif name == "decontamination":
            bad = leaking([(i, rows[i].text) for i in before], items)
            assert set(after) == {i for i in before if not bad[i]}
        else:
            assert {i: r.text for i, r in after.items()} == {i: redacted(rows[i].text) for i in before}
        assert all(after[i].source == rows[i].source and (name == "pii" or after[i].text == rows[i].text) for i in after)
        docs, rows, before = out, after, set(after)
    got = cp.STAGES[-1][1](spark, docs, sf).collect()
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {i: len(ids_of(r.text)) for i, r in rows.items()}
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, cp.run(spark, sf).collect())) == sorted(map(key, got))


def test_empty_and_null_rows(spark, tmp_path):
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in ([], [(1, None, None, None, None), (2, "ja und nein", "de", "s", 11), (2, "ja und nein", "de", "s", 11), (None, "words here", None, None, None)]):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        got = cp.run(spark, str(tmp_path)).collect()
        assert sorted(r.doc_id or 0 for r in got) == ([0, 2, 2] if rows else [])
    assert decontam.edits(35, 0.8) == 7 and packing.SEQ_LEN == 1024


def test_clashing_columns_long_texts_and_shared_ids(spark, tmp_path):
    """Every stage carries columns named like those it makes, and takes texts of any length; rows that share a doc_id have fates of their own."""
    names = ["n_email", "spans_list", "_id", "_row", "_gone", "tag", "hits", "kept", "component_id", "_t", "bucket", "score", "held_out"]
    long = " ".join(f"the and {chr(97 + i % 7)}x word of a@b.co" for i in range(30_000))
    words = [f"the {chr(97 + i % 20)}{chr(97 + i // 20)}o" for i in range(80)]
    texts = [(1, "and the of a word here"), (1, " ".join(words)), (2, " ".join([*words, "tail"])), (3, long), (None, "the word"), (4, None), (5, "the of and " * 40 + "call +49 30 1234567 now"), (6, "x"), (6, "x"), (7, "the word" + " " * 1_200_000 + "and of the")]
    rows = [(i, t, "en" if k % 2 else None, "s", k, *(f"{n}{k}" for n in names)) for k, (i, t) in enumerate(texts)]
    ddl = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{n} string" for n in names)
    spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, ddl).repartition(2)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), ddl)
    got = {r.n_chars: r for r in docs.collect()}
    assert set(got) == {0, 1, 3, 4, 6, 7, 8, 9}
    assert all(got[k][n] == f"{n}{k}" for k in got for n in names)
    assert got[3].text == long.replace("a@b.co", "[email]") and got[6].text.endswith("call [phone] now")
    assert sum(r.doc_id == 6 for r in cp.STAGES[-1][1](spark, docs, "").collect()) == 2
