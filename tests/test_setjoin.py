"""The set-similarity join against all pairs, and renames across files by fingerprints."""

import random

import pyarrow as pa
import pytest
from codestrata.operators import matching, setjoin

SETS = "id long, `group` string, tokens array<bigint>"
SYMBOLS = "sym_id long, kind string, name string, qualified_name string, file_path string, body_hash string, normalized_body string, ast_fingerprint array<bigint>"


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("least", [0.5, 0.7, 0.9])
def test_equals_all_pairs(spark, least):
    rng = random.Random(5)
    pool = [[rng.randrange(60) for _ in range(rng.randrange(1, 14))] for _ in range(12)]

    def made(start):
        out = []
        for i in range(70):
            tokens = list(rng.choice(pool))
            for _ in range(rng.randrange(3)):
                tokens[rng.randrange(len(tokens))] = rng.randrange(60)
            out.append((start + i, rng.choice(["a", "b", None]), tokens if i % 9 else []))
        return out + [(start + 100 + i, "a", list(range(10))) for i in range(20)]  # copies

    left, right = made(0), made(1000)
    got = setjoin.similar_sets(spark.createDataFrame(left, SETS), spark.createDataFrame(right, SETS), least).collect()
    want = {(i, k): jaccard(x, y) for i, g, x in left for k, h, y in right if x and y and g == h and g is not None and jaccard(x, y) > least}
    assert len(got) == len(want) and {(r.l_id, r.r_id) for r in got} == set(want)
    assert all(r.similarity == pytest.approx(want[r.l_id, r.r_id]) for r in got)


def test_one_to_one_pairs_are_read_as_a_stream(spark):
    """Small files come many to a batch and a file may span batches; none is a group of its own."""
    rng = random.Random(2)
    rows = [(f"f{rng.randrange(60)}" if i % 40 else None, rng.randrange(12), rng.randrange(12), rng.randrange(5) / 4) for i in range(900)]
    candidates = spark.createDataFrame(rows, "path string, old_id long, new_id long, score double")
    got = matching.greedy_assignment(candidates, "path")
    assert "InPandas" not in got._jdf.queryExecution().toString()
    want = []
    for path in {r[0] for r in rows}:
        olds, news = set(), set()
        for _, o, n, s in sorted((r for r in rows if r[0] == path), key=lambda r: (-r[3], r[1], r[2])):
            if o not in olds and n not in news:
                olds.add(o)
                news.add(n)
                want.append((o, n, s))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    ordered = [("a", 1, 1), ("a", 1, 2), ("a", 2, 1), ("a", 2, 2), ("b", 1, 1), (None, 1, 1)]
    batch = lambda part: pa.RecordBatch.from_pylist([{"group": g, "old_id": o, "new_id": n, "score": 1.0} for g, o, n in part])
    out = [tuple(r.values())[:2] for rb in matching._best_free(batch(ordered[k : k + 2]) for k in (0, 2, 4)) for r in rb.to_pylist()]
    assert out == [(1, 1), (2, 2), (1, 1), (1, 1)]


def test_empty_sides(spark):
    none, one = spark.createDataFrame([], SETS), spark.createDataFrame([(1, "a", [1, 2]), (2, "a", None)], SETS)
    assert setjoin.similar_sets(none, one, 0.7).count() == setjoin.similar_sets(one, none, 0.7).count() == 0
    assert [tuple(r) for r in setjoin.similar_sets(one, one, 0.7).collect()] == [(1, 1, 1.0)]


def symbol(i, name, path, body, prints, kind="Function"):
    return (i, kind, name, f"m::{name}", path, str(hash(body)), body, prints)


def test_fingerprints_are_compared_whatever_the_bodies_lengths(spark):
    prints = list(range(40))
    for size in (105, 400, 4000):
        old = spark.createDataFrame([symbol(1, "f", "a.rs", "x" * 100, prints)], SYMBOLS)
        new = spark.createDataFrame([symbol(2, "g", "b.rs", "y" * size, prints)], SYMBOLS)
        assert [tuple(r)[:2] for r in matching.match_across(old, new).collect()] == [(1, 2)]


def test_candidates_of_all_sorts(spark):
    rng = random.Random(8)
    words = ["let", "x", "return", "sum", "match", "self", "0", "item", "é"]
    rows = {"o": [], "n": []}
    for side in rows:
        for i in range(45):
            body = " ".join(rng.choice(words) for _ in range(rng.choice([0, 2, 5, 6])))
            prints = [] if i % 3 == 0 else [rng.randrange(6) for _ in range(rng.randrange(1, 5))]
            rows[side].append(symbol(i, f"{side}{i}", rng.choice("ab"), body * (200 if i == 7 else 1), prints, rng.choice(["F", "M"])))
    got = {(r.old_id, r.new_id): r.score for r in matching.similar_candidates(*(spark.createDataFrame(rows[s], SYMBOLS) for s in "on")).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
            row = new
        return row[-1]

    want = {}
    for o in rows["o"]:
        for n in rows["n"]:
            if o[1] != n[1] or o[4] == n[4]:
                continue
            a, b = o[6].encode(), n[6].encode()
            if a == b:
                s = 1.0
            elif o[7] and n[7]:
                s = jaccard(o[7], n[7])
            elif min(len(a), len(b)) < 0.7 * max(len(a), len(b)):
                s = 0.0
            else:
                a, b = (x[:1000].decode("utf-8", "ignore").encode() if max(len(a), len(b)) > 1000 else x for x in (a, b))
                s = 1 - distance(a, b) / max(len(a), len(b), 1)
            if s > 0.7:
                want[o[0], n[0]] = s
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_a_name_that_stands_everywhere_is_assigned_in_order(spark):
    """Each old symbol in order takes the best free new one, of equals the first; as plain Python does it over all pairs."""
    rng = random.Random(11)
    pool = [[rng.randrange(50) for _ in range(12)] for _ in range(25)]

    def made(n):
        out = []
        for i in range(n):
            prints = list(rng.choice(pool))
            for _ in range(rng.randrange(4)):
                prints[rng.randrange(12)] = rng.randrange(50)
            out.append(symbol(i, rng.choice(["new", "new", "new", "main"]), f"{rng.randrange(40)}.rs", f"body {rng.randrange(10**9)}", prints))
        return out

    old, new = made(300), made(280)
    want, used = {}, set()
    for o in old:
        best = max(((s, -n[0]) for n in new if n[2] == o[2] and n[4] != o[4] and n[0] not in used and (s := jaccard(o[7], n[7])) > 0.5), default=None)
        if best:
            want[o[0]] = -best[1]
            used.add(-best[1])
    got = matching.moved_by_name(*(spark.createDataFrame(x, SYMBOLS) for x in (old, new))).collect()
    assert len(want) > 150 and {r.old_id: r.new_id for r in got} == want


def near_copies(rng, n, start):
    """Texts of few words with a number each: they share most tokens, and differ in rare ones."""
    return [(start + i, sorted(set(rng.choice([range(20), range(20, 40), range(40, 60)])) | {100 + rng.randrange(40) for _ in range(rng.randrange(1, 6))})) for i in range(n)]


@pytest.mark.parametrize("bits", [64, 8192])
def test_blocks_equal_all_pairs(monkeypatch, bits):
    monkeypatch.setattr(setjoin, "BITS", bits)
    monkeypatch.setattr(setjoin, "COMMON_BITS", 64)
    rng = random.Random(3)
    for least in (0.5, 0.7, 0.85):
        left, right = ([(i, [t for k in x for t in (k, k + 1000)]) for i, x in near_copies(rng, 150, s)] for s in (0, 1000))
        table = lambda rows: pa.table({"set_id": pa.array([i for i, _ in rows], pa.int64()), "tokens": pa.array([x for _, x in rows], pa.list_(pa.int64()))})
        got = setjoin._compared(least)(table(left), table(right)).to_pylist()
        want = {(i, k): jaccard(x, y) for i, x in left for k, y in right if jaccard(x, y) > least}
        assert len(got) == len(want) > 0 and {(r["l_set"], r["r_set"]): r["similarity"] for r in got} == want


def test_groups_of_near_copies_meet_in_blocks(spark, monkeypatch):
    """All of them share rare-first prefixes; as pairs of these they would be made by the million."""
    monkeypatch.setattr(setjoin, "BLOCK", 64)
    asked = []
    prefixes = setjoin._by_prefixes
    monkeypatch.setattr(setjoin, "_by_prefixes", lambda *a: asked.append(1) or prefixes(*a))
    rng = random.Random(4)
    left, right = ([(i, "a", x) for i, x in near_copies(rng, 150, s)] for s in (0, 1000))
    spread = [(2000 + i, "b", [rng.randrange(10**6) for _ in range(9)]) for i in range(400)]
    for extra, by_prefixes in ((0, []), (1, [1])):
        a, b = (rows + extra * [(i + at, g, x) for i, g, x in spread] for rows, at in ((left, 0), (right, 1000)))
        got = setjoin.similar_sets(spark.createDataFrame(a, SETS), spark.createDataFrame(b, SETS), 0.7).collect()
        want = {(i, k): jaccard(x, y) for i, g, x in a for k, h, y in b if g == h and jaccard(x, y) > 0.7}
        assert asked == by_prefixes and {(r.l_id, r.r_id): r.similarity for r in got} == want
