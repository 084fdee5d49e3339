import random
import re

from codestrata.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = sorted((i, label) for label, p in licenses.PHRASES.items() for v in [p.split()] for i in range(len(w) - len(v) + 1) if w[i : i + len(v)] == v)
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def key(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_base_places(spark, sf):
    rng = random.Random(3)
    bits = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "GNU General Public License", "Apache-License", "x", "é", "\n", "CC BY", "cc-by", "MIT License,", "gnu"]
    texts = [None, "", "mit", "mit license", "cc by " * 20000, "MİT license", "apache\x00license"] + [" ".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)], "doc_id long, text string, label string").repartition(4)
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert key(got[i]) == base(t), t
        assert set(got[i].base_labels.split(",")) <= set(got[i].labels.split(",")) or not got[i].base_labels


def test_notices_with_changed_words(spark):
    w = licenses.NOTICES["mit"].split()
    w[7:7] = ["really", "and", "fully"]
    w[20] = "widget"
    rows = spark.createDataFrame([(1, "intro words " + " ".join(w) + " the end"), (2, "permission is hereby granted to a person"), (3, licenses.NOTICES["bsd"].upper())], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.base_labels) for r in licenses.scan(rows).collect()}
    assert got == {1: ("mit", ""), 2: ("", ""), 3: ("bsd", "")}


def test_repeated_rows_null_ids_and_empty(spark):
    rows = [(1, "mit license"), (1, "mit license"), (1, "cc by"), (None, "apache license"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.base_labels, r.n_base, r.score) for r in licenses.scan(df).collect())
    assert got == [(0, "", 0, 0.0), (0, "apache", 1, 1.0), (1, "cc-by", 1, 1.0), (1, "mit", 1, 1.0), (1, "mit", 1, 1.0)]
    assert licenses.scan(df.limit(0)).count() == 0
