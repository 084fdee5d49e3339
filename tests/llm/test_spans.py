import hashlib
import random
import re
import time

import numpy as np
import pytest
from codestrata.llm import native, pii, secrets
from pyspark.sql import functions as F

PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
SECRET = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def sound(kind, m):
    d = re.sub("[^0-9]", "", m[0])
    if kind == "ip":
        return all(int(p) <= 255 for p in m[0].split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(d) <= 15
    if kind == "assign":
        return len(m[2]) >= 6
    return {"access": 20, "hex": 24}.get(kind, 0) <= len(m[0])


def base(text, patterns):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(patterns.items()) for m in p.finditer(text or "") if sound(k, m)]
    return sorted(found)


def text_of(found):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)


def fuzz(rng, n):
    bits = ["a", "b@", "c.d", "@", ".", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "9", "-", " ", "  ", "+49 (30) 1234-5678", "+1", "é", "😀", "\n", "token", "SECRET", "secret:", "=", '"', "'", "password = hunter22", "api_key", "ApiKey:", "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef01234567", "%", "_", "x@y.z_d@e.f", "+", "(", ")"]
    return "".join(rng.choice(bits) for _ in range(n))


EDGE = [None, "", "1" * 30000, "a." * 20000, "a@" * 5000, "+1" + "(" * 20000, "4111111111111111 " * 300, "token=" * 2000 + "abcdef", "A" * 5000 + "@b.c", "token\x1c= abcdef", "toKen=abcdef"]


def test_base_spans_of_both_operators(spark, sf):
    rng = random.Random(7)
    texts = EDGE + [fuzz(rng, rng.randrange(1, 25)) for _ in range(1500)] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(8)
    got = {r.doc_id: r for r in pii.detect(df).collect()}
    for i, t in enumerate(texts):
        want = base(t, PII)
        assert got[i].base_sha256 == hashlib.sha256(text_of(want).encode()).hexdigest(), (t, want, got[i].spans)
        assert [got[i][f"n_{k}"] for k in PII] == [sum(x[3] == k for x in want) for k in PII]
        assert set(text_of(want).split(",")) - {""} <= set(got[i].spans.split(","))
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    for i, t in enumerate(texts):
        want = base(t, SECRET)
        assert got[i].base_sha256 == hashlib.sha256(text_of(want).encode()).hexdigest(), (t, want, got[i].spans)
        assert [got[i][f"n_{k}"] for k in SECRET] == [sum(x[3] == k for x in want) for k in SECRET]


def test_boosted_candidates(spark):
    rows = {
        "mail: jane.doe [at] example [dot] org now": "email:6:37",
        "call 0301-2345678 today": "phone:5:17",
        "years 1999-2004 and on": "",
        "card 4111.1111.1111.1111 ok": "card:5:24",
        "invoice 4111.11.11.111112 ok": "",
        "server 10[.]20[.]3[.]4 up": "ip:7:22",
        "plain words of a clean text 12 34": "",
        "### 4785380592391138$$$ de": "",
    }
    got = {r.doc_id: r.spans for r in pii.detect(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == list(rows.values())


def test_redact_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "en", "x a@b.co y 1.2.3.4 z"), (2, None, "clean é"), (None, "de", None), (4, "x", "4111 1111 1111 1111@x.yz")], "doc_id long, lang string, text string")
    out = pii.redact(df)
    assert out.columns == df.columns
    assert [(r.doc_id, r.lang, r.text) for r in out.orderBy("lang").collect()] == [(2, None, "clean é"), (None, "de", None), (1, "en", "x [email] y [ip] z"), (4, "x", "[card]")]


@pytest.mark.parametrize("op", [pii.detect, secrets.scan])
def test_empty_repeated_null_and_native(spark, op):
    assert op(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a@b.co token=abcdef1"), (1, "a@b.co token=abcdef1"), (None, None)], "doc_id long, text string")
    assert op(df).count() == 3
    plan = op(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_ledger_scans_only_what_is_new(spark, tmp_path, monkeypatch):
    df = lambda *t: spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    path = f"file://{tmp_path}/ledger"
    secrets.scan(df("token=abcdef1", "token=abcdef1", "b"), secrets.Ledger(spark, path)).collect()
    count = lambda: spark.read.option("recursiveFileLookup", True).parquet(path).count()
    assert count() == 2
    rows = secrets.scan(df("b", "token=abcdef1", "secret: new_value"), secrets.Ledger(spark, path)).orderBy("doc_id").collect()
    assert [r.n_assign for r in rows] == [0, 1, 1] and count() == 3
    secrets.scan(df("b"), secrets.Ledger(spark, path, rules="2")).collect()
    assert count() == 4


def test_places_are_code_points(spark):
    row = spark.range(1).select(native.matches(F.lit("😀é ab 😀ab"), "ab").alias("m")).first()
    assert [(x.start, x.end) for x in row.m] == [(3, 5), (7, 9)]


def test_ledger_with_a_second_writer_and_a_failed_scan(spark, tmp_path):
    df = spark.createDataFrame([(0, "token=abcdef1"), (1, "b"), (None, "token=abcdef1")], "doc_id long, text string")
    path = f"file://{tmp_path}/ledger"
    want = sorted((r.doc_id or 0, r.spans) for r in secrets.scan(df, secrets.Ledger(spark, path)).collect())
    # a second writer that read the ledger before the first one wrote
    versions = df.selectExpr("unhex(sha2(text, 256)) AS blob", "text")
    versions.dropDuplicates().select("blob", F.lit("1").alias("rules"), secrets.findings(F.col("text")).alias("findings")).write.parquet(f"{path}/scan-other")
    assert sorted((r.doc_id or 0, r.spans) for r in secrets.scan(df, secrets.Ledger(spark, path)).collect()) == want == [(0, "assign:0:13"), (0, "assign:0:13"), (1, "")]
    versions.limit(1).select("blob", F.lit("1").alias("rules"), F.expr(f"cast(array() AS {secrets.FINDINGS})").alias("findings")).write.parquet(f"{path}/scan-broken")
    (tmp_path / "ledger" / "scan-broken" / "_SUCCESS").unlink()
    assert sorted((r.doc_id or 0, r.spans) for r in secrets.scan(df, secrets.Ledger(spark, path)).collect()) == want


def test_many_matches_take_linear_time(spark):
    """Time per match doesn't grow with the matches of a text; the places are right to the last."""
    card, hexes = "4111 1111 1111 1111 x ", "0123456789abcdef01234567 "
    took = {}
    for n in (2000, 10_000, 40_000):
        df = spark.createDataFrame([(1, card * n), (2, hexes * n)], "doc_id long, text string")
        began = time.monotonic()
        row = df.where("doc_id = 1").select(native.matches(F.col("text"), pii.BASE["card"]).alias("m")).first()
        assert [(x.start, x.end) for x in row.m] == [(i * len(card), i * len(card) + 19) for i in range(n)]
        row = df.where("doc_id = 2").select(F.explode(F.slice(secrets.findings(F.col("text")), -1, 1)).alias("s")).first()
        assert (row.s.start, row.s.end) == ((n - 1) * len(hexes), n * len(hexes) - 1)
        out = pii.redact(df.where("doc_id = 1"), pii.Trees(np.zeros((0, 16)), np.zeros(0))).first()
        assert out.text == "[card] x " * n
        took[n] = time.monotonic() - began
    assert took[40_000] < 8 * took[10_000]


def test_overlapping_proposals_leave_the_best(spark):
    made = "array(named_struct('start', {0}, 'cand', 1, 'end', {1}, 'order', {2}, 'score', {3}D))"
    items = [(0, 10, 2, 1.0), (5, 15, 3, 3.0), (8, 20, 1, 3.0), (20, 25, 1, 0.5), (30, 40, 3, 2.0), (31, 35, 0, 9.0), (50, 60, 3, 5.0), (70, 80, 3, 5.0), (85, 95, 2, 1.0)]
    picked = F.concat(*(F.expr(made.format(*x)).cast(f"array<{pii.PICKED}>") for x in items))
    base = F.expr("array(named_struct('start', 55, 'order', 0, 'end', 58, 'kind', 'email'), named_struct('start', 64, 'order', 0, 'end', 71, 'kind', 'email'), named_struct('start', 95, 'order', 0, 'end', 99, 'kind', 'email'))")
    got = spark.range(1).select(pii._apart(base, picked).alias("p")).first().p
    assert [(x.start, x.end) for x in got] == [(5, 15), (20, 25), (31, 35), (85, 95)]


def test_model_scores_alike_in_sql_and_here(spark):
    model = pii.fit(spark, 4096)
    made = pii.examples(spark, 600).where("kind = 'phone'").select(F.explode(pii.described(pii.candidates(F.col("text"), 7), 7)).alias("c"))
    rows = made.select("c.x", model.column(F.col("c.x")).alias("s")).collect()
    assert len(rows) > 50 and np.allclose([r.s for r in rows], model.scores(np.array([r.x for r in rows])))


def test_held_out_examples(spark):
    """Examples that the model hasn't seen, drawn with other numbers: few false redactions, most of the personal data."""
    model = pii.fit(spark)
    rows = pii.examples(spark, 40_000).where("id >= 20000").selectExpr("id AS doc_id", "text", "label", "kind")
    got = pii.detect(rows, model).join(rows.withColumnRenamed("doc_id", "id"), F.col("doc_id") == F.col("id")).collect()
    more = [len(r.spans_list) > r.n_email + r.n_ip + r.n_card + r.n_phone for r in got]
    hit = [r.label for r, m in zip(got, more, strict=True) if m]
    good = [bool(r.spans) for r in got if r.label]
    assert len(hit) > 2000 and np.mean(hit) >= 0.97 and np.mean(good) >= 0.95, (np.mean(hit), np.mean(good))


def test_redact_carries_columns_of_any_name(spark):
    rows = [(1, "x a@b.co y", 7, "s", 1, "r", "b"), (None, None, None, None, None, None, None), (2, "", 3, "t", 0, "q", "c")]
    names = ["doc_id", "text", "n_email", "spans_list", "_id", "_row", "spans.x"]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_email int, spans_list string, _id int, _row string, `spans.x` string")
    out = pii.redact(df)
    assert out.columns == names and sorted(map(tuple, out.collect()), key=str) == sorted([(1, "x [email] y", *rows[0][2:]), rows[1], rows[2]], key=str)
