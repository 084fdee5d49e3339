"""Every query with SQL against DuckDB on the smallest tables; the others must run with stable columns."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(v[i] for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", [k for k in entry.oracle_sql() if not k.startswith("op") and k != "pipeline"])
def test_query_equals_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    got = rows(df.columns, df.collect())
    r = duck.execute(entry.oracle_sql()[name])
    want = rows([d[0] for d in r.description], r.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", [k for k in entry.queries() if k not in entry.oracle_sql() and not k.startswith("op") and k != "pipeline"])
def test_query_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_greedy_pairs_in_rounds_equal_one_pass(spark, monkeypatch):
    import random

    from codestrata.operators import matching

    rng = random.Random(3)
    rows = list({(o, n): (o, n, rng.randrange(20) / 20) for o, n in ((rng.randrange(60), 100 + rng.randrange(60)) for _ in range(900))}.values())
    df = spark.createDataFrame(rows, "old_id long, new_id long, score double")
    want, old, new = [], set(), set()
    for o, n, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if o not in old and n not in new:
            want.append((o, n, s))
            old.add(o)
            new.add(n)
    for limit in (0, 40, 10**6):
        monkeypatch.setattr(matching, "GREEDY_ROWS", limit)
        assert sorted(map(tuple, matching.greedy_pairs(df).collect())) == sorted(want)


def test_numbers_of_changes_have_no_gaps(spark, sf, monkeypatch):
    from codestrata.plans import diff
    from codestrata.plans import queries as plain

    every = plain._changes(spark, sf)
    monkeypatch.setattr(plain, "_changes", lambda *_: every)
    changes = diff.numbered(every).collect()
    rows = sorted((r.id, r.phase, (r.new or r.old).file_path, (r.new or r.old).line_start) for r in changes)
    assert [r[0] for r in rows] == list(range(len(rows))) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)
    kinds = {k: sum((r.kind == k) for r in changes) for k in ("Deleted", "Added")}
    counts = entry.queries()["change_summary"](spark, sf).first()
    assert (counts.deleted, counts.added) == (kinds["Deleted"], kinds["Added"]) and counts.total_changes == len(rows)
    old = {r.sym_id for r in entry.queries()["deleted"](spark, sf).collect()}
    left = {r.sym_id for r in entry.queries()["unmatched_old_after_moves"](spark, sf).collect()}
    assert old < left and len(old) == counts.deleted
