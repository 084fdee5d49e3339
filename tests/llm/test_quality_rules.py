import math
import random
import re
from collections import Counter

from codestrata.llm import quality_rules as q
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(g)
    covered = {p for i, x in enumerate(g) if n[x] > 1 for p in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), failed


def key(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_base_counts_on_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in q.quality_rules(df).collect()}
    for r in df.collect():
        assert key(got[r.doc_id]) == base(r.text), r.doc_id
        assert not (got[r.doc_id].kept and got[r.doc_id].base_failed)


def test_edge_cases(spark):
    rng = random.Random(0)
    texts = [None, "", " \t\n", "a\x0bb\x0cc\rd", "a a a a a", "x y z x y z\nx y z\n\n x y z\nx y z", "日本 語😀 #*$%&|<>", "é e  x\x85y \x1c", "w " * 40000]
    texts += [" ".join(rng.choice("abc") for _ in range(n)) for n in (2, 3, 4, 7, 60, 200)]
    df = spark.createDataFrame([(i, t, None if i % 2 else "en", 5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int")
    got = {r.doc_id: r for r in q.quality_rules(df.union(df.where("doc_id = 5"))).collect()}
    assert q.quality_rules(df.union(df)).count() == 2 * len(texts)
    for i, t in enumerate(texts):
        assert key(got[i]) == base(t), t
    assert q.quality_rules(df.limit(0)).count() == 0


def test_distance_is_jensen_shannon(spark):
    p, r = [0.5, 0.25, 0.25], [0.1, 0.1, 0.8]
    m = [(a + b) / 2 for a, b in zip(p, r, strict=True)]
    want = math.sqrt(sum(a * math.log2(a / c) + b * math.log2(b / c) for a, b, c in zip(p, r, m, strict=True)) / 2)
    got = spark.range(1).select(q.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, r))).alias("d")).first().d
    assert abs(got - want) < 1e-12


def test_strange_documents_go_and_clean_ones_stay(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["the", "of", "and", "to"] + [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]) for _ in range(n))
    rows = [(i, say(150) + ".", "en") for i in range(40)] + [(100, "".join(w + rng.choice(["###", "$$$", "&&&"]) + " " for w in say(150).split()), "en")]
    got = {r.doc_id: r.kept for r in q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got.pop(100) and all(got.values())
