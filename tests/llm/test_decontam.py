import random
import time

import numpy as np
from codestrata.llm import decontam, words


def levenshtein_in(item, doc):
    row = [0] * (len(doc) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(doc, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def brute(docs, items):
    out = {}
    for d, t in docs:
        w = decontam.content_words(t)
        out[d] = [i for i, x in items if (v := decontam.content_words(x)) and levenshtein_in(v, w) <= decontam.edits(len(v), 0.8)]
    return out


def mutate(rng, w, n):
    w = list(w)
    for _ in range(n):
        at, kind = rng.randrange(len(w)), rng.randrange(3)
        if kind == 0:
            w[at] = f"q{rng.randrange(10**6)}"
        elif kind == 1:
            w.insert(at, f"q{rng.randrange(10**6)}")
        else:
            del w[at]
    return w


def test_recall_at_the_largest_distance_and_no_false_leak(spark):
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(60)] + [f"r{i}" for i in range(3000)]
    say = lambda n: [vocab[min(int(rng.expovariate(1 / 80)), len(vocab) - 1)] for _ in range(n)]
    items = [(i, say(n)) for i, n in enumerate([1, 2, 4, 5, 9, 10, 14, 20, 25, 30, 35, 40, 50, 60] * 6)]
    docs, planted = [], 0
    for i, w in items:
        k = decontam.edits(len(w), 0.8)
        body = say(40) + mutate(rng, w, k) + say(30)
        docs.append((i, " ".join(body)))
        docs.append((1000 + i, " ".join(say(60))))
    texts = [(i, " ".join(w).upper() + "!") for i, w in items]
    long_items = [x for x in texts if len(x[1].split()) >= 5]
    want = brute(docs, long_items)
    df = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(long_items, "item_id long, text string")
    got = {r.doc_id: list(r.item_ids) for r in decontam.decontaminate(df, bench).collect()}
    planted = sum(map(len, want.values()))
    found = sum(len(set(got[d]) & set(w)) for d, w in want.items())
    assert all(set(got[d]) <= set(w) for d, w in want.items()) and planted > 60 and found >= 0.99 * planted
    blocks = decontam.leaks(df, bench, block_bytes=4000).collect()
    assert {r.doc_id: sorted(h.item_id for h in r.hits) for r in blocks} == got


def test_blocks_agree_on_null_and_repeated_ids(spark):
    bench = spark.createDataFrame([(i, f"item{i} has some words of number{i} own{i}") for i in range(20)], "item_id long, text string")
    rows = [(None, "x item3 has some words of number3 own3 y"), (None, "clean words"), (7, "clean too"), (7, "item4 has some words of number4 own4"), (7, "item4 has some words of number4 own4"), (7, None), (8, "item5 has some words of number5 own5 item6 has some words of number6 own6")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda df: sorted((str(r.doc_id), [tuple(h) for h in r.hits]) for r in df.collect())
    one = key(decontam.leaks(docs, bench))
    assert [(i, [h[0] for h in hits]) for i, hits in one] == [("7", []), ("7", []), ("7", [4]), ("7", [4]), ("8", [5, 6]), ("None", []), ("None", [3])]
    assert key(decontam.leaks(docs, bench, block_bytes=120)) == one
    assert decontam.clean(docs, bench).count() == 3


def test_what_is_found_comes_from_the_tables():
    index = decontam.Index([(1, "one two three four five six seven eight")])
    assert [h[0] for h in index.find(["zero one two three four five six seven nine"])[0]] == [1]
    index.tables = {n: (k[:0], s[:0]) for n, (k, s) in index.tables.items()}
    assert index.find(["zero one two three four five six seven eight"]) == [[]]


def test_a_long_repetitive_text_takes_linear_time():
    item = "the river we saw at dawn was the river we had seen before the war"
    index = decontam.Index([(1, item), (2, "the river " * 12)])
    took = {}
    for n in (4000, 16_000):
        began = time.monotonic()
        hits = index.find([(item + " we saw the river ") * n, None])
        took[n] = time.monotonic() - began
        assert [h[:4] for h in hits[0]][:1] == [(1, 0, 15, 0)] and hits[1] == []
    assert took[16_000] < 8 * took[4000] and took[16_000] < 60


def test_best_stretch_equals_plain_dynamic_programming():
    rng = random.Random(2)
    for _ in range(200):
        a = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 9))], np.uint64)
        b = np.array([rng.randrange(4) for _ in range(rng.randrange(0, 14))], np.uint64)
        d, s, e = decontam.best_stretch(a, b)
        assert d == levenshtein_in(a.tolist(), b.tolist())
        row = list(range(e - s + 1))
        for i, w in enumerate(a.tolist(), 1):
            new = [i]
            for j, x in enumerate(b[s:e].tolist(), 1):
                new.append(min(row[j - 1] + (w != x), row[j] + 1, new[j - 1] + 1))
            row = new
        assert row[-1] == d


def test_edge_cases(spark):
    bench = spark.createDataFrame([(1, "Alpha beta, gamma delta epsilon"), (2, None), (3, ""), (4, "alpha BETA gamma delta epsilon"), (5, "solo"), (None, "x")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x alpha*** beta&&& gamma!! delta epsilon"), (4, "alpha"), (5, "gamma delta"), (None, "so solo"), (3, "solo"), (6, "z " * 50000 + "alpha beta gamma DELTA epsilon")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, list(r.item_ids), r.contaminated) for r in decontam.decontaminate(docs, bench).collect())
    assert got == [(0, [5], True), (1, [], False), (2, [], False), (3, [1, 4], True), (3, [5], True), (4, [], False), (5, [], False), (6, [1, 4], True)]
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontam.decontaminate(docs, bench.limit(0)).collect())


def test_whole_table_finds_every_verbatim_item(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {r.doc_id: set(r.item_ids) for r in decontam.decontaminate(docs, bench).collect()}
    for r in docs.collect():
        for b in bench.collect():
            if b.text in r.text:
                assert b.item_id in got[r.doc_id]
    assert words.grams(np.arange(2, dtype=np.uint64), 3).size == 0


def shared_phrase(n, own, filler):
    phrase = "which of the following is true about "
    items = [(i, phrase + " ".join(f"u{i}x{k}" for k in range(own))) for i in range(n)]
    return items, " ".join(phrase + " ".join(f"f{j}y{k}" for k in range(filler)) for j in range(n))


def test_a_phrase_that_many_items_share_takes_linear_time():
    took = {}
    for n in (2000, 8000):
        items, text = shared_phrase(n, 14, 20)
        index = decontam.Index(items)
        began = time.monotonic()
        assert index.find([text]) == [[]]
        took[n] = time.monotonic() - began
    assert took[8000] < 3


def test_shared_phrases_equal_brute_force():
    for own in (3, 6, 9, 14):
        items, text = shared_phrase(40, own, 8)
        texts = [text, f"x y {items[3][1]} {text} {items[30][1]}", " ".join(t for _, t in items[5:9]), items[7][1].rsplit(" ", 1)[0] + " " + text]
        want = brute(list(enumerate(texts)), items)
        got = decontam.Index(items).find(texts)
        assert [{h[0] for h in hits} for hits in got] == [set(want[i]) for i in range(len(texts))]
