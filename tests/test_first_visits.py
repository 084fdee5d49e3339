"""Depth-first reachability against a search of all edges of each start."""

import random

from codestrata.operators import graph


def visits(starts, edges, depth):
    rows = set()
    for start in starts:
        seen, stack = set(), [(start, 0)]
        while stack:
            node, d = stack.pop()
            if d > depth or node in seen:
                continue
            seen.add(node)
            for caller, callee, path, line in sorted(edges, key=lambda e: (e[3] is None, e[3] or 0, e[0], e[2])):
                if callee == node:
                    if d > 0 or caller != start:
                        rows.add((start, node, caller, path, line, d))
                    if d < depth:
                        stack.append((caller, d + 1))
    return rows


def test_groups_hold_called_names_only(spark, monkeypatch):
    """Hubs with many callers that nobody calls, cycles, edges of a pair in several files and places, a line that is not known."""
    rng, held = random.Random(7), {}
    edges = {(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}", f"f{rng.randrange(2)}", rng.choice([1, 2, 3, 5, 8, None])) for _ in range(40)}
    edges |= {(f"leaf{k}", f"n{k % 9}", "f", k % 4) for k in range(900)}
    stage = graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, tag="stage": held.setdefault(tag, stage(df, tag)) if tag in ("inner", "visits") else stage(df, tag))
    starts = [f"n{k}" for k in range(9)] + ["leaf1"]
    calls = spark.createDataFrame(sorted(edges, key=str), "caller string, callee string, file_path string, line long")
    for depth in (1, 2, 3):
        held.clear()
        got = graph.transitive_callers_dfs(spark.createDataFrame([(s,) for s in starts], "name string"), calls, depth).collect()
        assert len(got) == len(set(got)) and set(map(tuple, got)) == visits(starts, edges, depth)
        assert held["inner"].count() <= 81 and held["visits"].count() <= 81
