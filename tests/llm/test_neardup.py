import random

import numpy as np
from codestrata.llm import neardup, words
from codestrata.llm.components import components


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs, percent=85):
    s = {i: sets(t) for i, t in docs}
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(s)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s[i]), find(i), find(i) == i) for i in ids}


def test_matches_brute_force_on_the_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = neardup.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(docs)


def test_chains_and_edge_cases(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    docs = []
    for i in range(60):  # each copy changes two words of the one before, so that the ends of the chain aren't linked
        docs.append((100 - i, " ".join(base)))
        for _ in range(1 + i % 2):
            base[rng.randrange(len(base))] = f"x{rng.randrange(10**6)}"
    docs += [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "ONE\ttwo"), (205, "a b c d e"), (206, "A b c d e "), (207, "ünï Ünï"), (208, "y " * 30000)]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == brute(docs)
    assert got[204][1] == 203 and got[206][1] == 205 and got[201] == (0, 201, True)


def test_empty_null_ids_and_repeated_rows(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = neardup.near_duplicates(spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "a b c")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_rows_that_share_a_doc_id_keep_their_links(spark):
    a, b = ([f"{x}{i}" for i in range(60)] for x in "ab")
    rows = [(5, " ".join(a)), (5, " ".join(b)), (6, " ".join([*a, "tail"])), (7, " ".join([*b, "tail"])), (8, " ".join([*b, "tail", "end"])), (9, "alone in the end now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect())
    assert got == [(5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False), (8, 5, False), (9, 9, True)]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = x[:2000], x[500:2500]
    ra, rb = neardup.registers(a, 4096), neardup.registers(b, 4096)
    assert (np.maximum(ra, rb) == neardup.registers(np.union1d(a, b), 4096)).all()
    n = np.array([2000.0])
    assert abs(neardup.likely_jaccard(ra[None], rb[None], n, n)[0] - 1500 / 2500) < 0.03


def test_words_in_blocks(monkeypatch):
    w = [f"w{i % 977}".encode() for i in range(5000)]
    whole = words.hash_words(w)
    monkeypatch.setattr(words, "_BLOCK", 1000)
    assert (words.hash_words(w) == whole).all() and len(set(whole.tolist())) == 977


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}
    for _ in range(200):
        for a, b in links:
            m = min(root.get(a, a), root.get(b, b))
            root[a] = root[b] = m
    assert got == {k: v for k, v in root.items() if k != 500}


def test_clusters_around_the_threshold_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 16)
    rng = random.Random(9)
    docs = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(150)]
        for i in range(70):
            w = list(base)
            for _ in range(rng.choice([1, 2, 2, 3])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            docs.append((g * 100 + i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert 3 < len({c for _, c, _ in want.values()}) < 150
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()} == want
