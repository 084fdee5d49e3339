import hashlib
import random

import numpy as np
import pytest
from codestrata.llm import substring_dedup as sd


def brute(docs):
    least = {}
    for i, t in docs:
        t = (t or "").encode()
        for s in range(len(t) - 49):
            w = t[s : s + 50]
            if i is not None and least.get(w, i) >= i:
                least[w] = i
    out = []
    for i, t in docs:
        t = (t or "").encode()
        gone = bytearray(len(t))
        for s in range(len(t) - 49):
            if i is not None and least[t[s : s + 50]] < i:
                gone[s : s + 50] = b"\x01" * 50
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.dedup_digests(df).collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_fuzz(spark, small, monkeypatch):
    if small:
        monkeypatch.setattr(sd, "DOC_BYTES", 1500)
        monkeypatch.setattr(sd, "HASH_BYTES", 4000)
        monkeypatch.setattr(sd, "_PIECE", 301)
        monkeypatch.setattr(sd, "_BLOCK", 900)
    rng = random.Random(11)
    bits = ["".join(rng.choice("ab é\x00") for _ in range(rng.randrange(10, 90))) for _ in range(25)]
    docs = [(rng.randrange(200), "".join(rng.choice(bits) for _ in range(rng.randrange(0, 9)))) for _ in range(120)]
    docs += [(300, None), (301, ""), (302, "x" * 49), (303, "x" * 50), (304, "x" * 400), (305, "y" * 400), (306, "x" * 49 + "y" * 60), (None, bits[0] * 5), (None, None)]
    docs += [(400 + i, bits[1] + bits[2] + bits[3]) for i in range(12)] + docs[:5]
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, n_bytes string").repartition(5)
    assert got(df) == brute(docs)
    assert got(df.limit(0)) == []


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(df) == brute([(r.doc_id, r.text) for r in df.collect()])


@pytest.mark.parametrize("hot", [20, 4096])
def test_a_short_phrase_in_every_document(spark, hot, monkeypatch):
    """A phrase under 50 bytes with other surroundings each time is one anchor of all documents; longer ones and repeats within a text beside it."""
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "DOC_BYTES", 20_000)
    monkeypatch.setattr(sd, "HASH_BYTES", 60_000)
    rng = random.Random(12)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrases = [some(49), some(40), some(30)]
    ends = [some(3) for _ in range(6)]
    docs = []
    for i in range(700):
        t = "".join(some(rng.randrange(20, 60)) + rng.choice(ends) + p + rng.choice(ends) for p in rng.choices(phrases, k=4))
        docs.append((rng.randrange(5000), t))
    docs += [(6000, ("xy" + phrases[0]) * 300), (6001, ("xy" + phrases[0]) * 200), (6002, "z" * 9000), (6003, "z" * 700 + phrases[1] * 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert got(df) == brute(docs)


def test_a_very_long_text(spark):
    rng = random.Random(13)
    line = "".join(rng.choice("abcdefgh \n") for _ in range(900))
    long = "".join(line if i % 3 else "".join(rng.choice("abcdefgh \n") for _ in range(700)) for i in range(1500))
    docs = [(1, line), (2, long), (3, long[500_000:600_000]), (4, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(df) == brute(docs)


def test_loser_tree_orders_and_counts_prefixes():
    rng = random.Random(0)
    for _ in range(60):
        runs, every = [], []
        for n in range(rng.randrange(0, 9)):
            own = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(24, 51))) for _ in range(rng.randrange(0, 12)))
            shared = [0] + [sd.common(x, y) for x, y in zip(own, own[1:], strict=False)]
            runs.append(iter([(x, s, rng.randrange(9), n, 0, 0, 0, b"") for x, s in zip(own, shared, strict=False)]))
            every += own
        merged = list(sd.merge(runs))
        assert [x[0] for x, _ in merged] == sorted(every)
        assert all(n == sd.common(a[0], b[0]) for (a, _), (b, n) in zip(merged, merged[1:], strict=False))


def test_touching_spans_are_one():
    row, start, end = (np.array(x) for x in ([1, 0, 1, 1, 0], [50, 0, 0, 300, 0], [100, 50, 50, 350, 60]))
    assert [x.tolist() for x in sd.united(row, start, end)] == [[0, 1, 1], [0, 0, 300], [60, 100, 350]]
