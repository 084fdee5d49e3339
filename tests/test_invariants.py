"""What must hold of the queries that SQL can't express."""

import json

import __spark_entry__ as entry
from codestrata.plans import queries as plain
from codestrata.plans.bindings import snapshots, table
from pyspark.sql import functions as F


def run(spark, sf, name):
    return entry.queries()[name](spark, sf).collect()


def test_matches_across_files_are_one_to_one(spark, sf):
    o, n = ({r.sym_id: r for r in x.collect()} for x in snapshots(spark, sf))
    left_old, left_new = ({r.sym_id for r in run(spark, sf, f"unmatched_{x}")} for x in ("old", "new"))
    rows = run(spark, sf, "cross_file_matches")
    assert rows and all(r.old_id in left_old and r.new_id in left_new for r in rows)
    moved = [r for r in rows if r.match_type in ("ExactBody", "NameAndBody", "SimilarBody")]
    assert len({r.old_id for r in moved}) == len({r.new_id for r in moved}) == len(moved)
    for r in rows:
        a, b = o[r.old_id], n[r.new_id]
        if r.match_type == "ExactBody":
            assert a.body_hash == b.body_hash and a.kind == b.kind and a.file_path != b.file_path and r.confidence == 0.95
        elif r.match_type == "NameAndBody":
            assert a.name == b.name and a.kind == b.kind and 0.45 < r.confidence <= 0.9
        elif r.match_type == "SimilarBody":
            assert a.kind == b.kind and a.file_path != b.file_path and 0.7 * 0.85 < r.confidence <= 0.85
        elif r.match_type == "Extracted":
            assert b.normalized_body in a.normalized_body and r.confidence == 0.7
        else:
            assert r.match_type == "Inlined" and a.normalized_body in b.normalized_body and r.confidence == 0.65


def test_moved_by_name_takes_the_best_free(spark, sf):
    rows = run(spark, sf, "moved_by_name")
    scores = {(r.old_id, r.new_id): r.score for r in run(spark, sf, "moved_by_name_candidates")}
    taken = {}
    for o in sorted({o for o, _ in scores}):
        free = [(-s, n) for (x, n), s in scores.items() if x == o and n not in taken.values()]
        if free:
            taken[o] = min(free)[1]
    got = {r.old_id: r.new_id for r in rows}
    assert set(got) == set(taken) and all(abs(r.confidence - 0.9 * scores[r.old_id, r.new_id]) < 1e-5 for r in rows)
    assert all(got[o] == n or scores[o, got[o]] == scores[o, n] for o, n in taken.items())


def test_aligned_rows_hold_both_bodies(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    by = {}
    for r in run(spark, sf, "aligned_rows"):
        by.setdefault(r.id, []).append(r)
    assert by
    for i, rows in by.items():
        rows.sort(key=lambda r: r.pos)
        assert [r.pos for r in rows] == list(range(len(rows)))
        old, new = [r for r in rows if r.tag != "Insert"], [r for r in rows if r.tag != "Delete"]
        assert [r.old_line for r in old] == list(range(1, len(old) + 1)) and [r.new_line for r in new] == list(range(1, len(new) + 1))
        assert "\n".join(r.text for r in old) == texts[i].removesuffix("\n") and "\n".join(r.text for r in new) == texts[i] + " edited"


def test_depth_first_callers_lie_within_the_breadth_first_ones(spark, sf):
    edge = lambda r: (r.name, r.callee, r.caller, r.file_path, r.line)
    least = {edge(r): r.depth for r in run(spark, sf, "transitive_callers")}
    rows = run(spark, sf, "transitive_callers_dfs")
    assert rows and all(r.depth <= 2 for r in rows)
    assert all(least.get(edge(r), 0 if r.caller == r.name else 9) <= r.depth for r in rows)
    assert {edge(r) for r in rows if r.depth == 0} == {e for e, d in least.items() if d == 0}


def test_reports_name_every_change(spark, sf, monkeypatch):
    details = plain._details(spark, sf).cache()
    monkeypatch.setattr(plain, "_details", lambda *_: details)
    primary = {r.id: r for r in run(spark, sf, "intent_primary")}
    assert sorted(primary) == list(range(len(primary))) and all(r.primary and 0 <= r.intent_confidence <= 1 for r in primary.values())
    entries = {r.id: r for r in run(spark, sf, "text_report")}
    docs = {r.id: json.loads(r.json) for r in run(spark, sf, "json_report")}
    prompts = {r.id: r.prompt for r in run(spark, sf, "review_prompt")}
    assert set(entries) == set(docs) == set(prompts) == set(primary)
    for i, r in primary.items():
        kind = docs[i]["kind"] if isinstance(docs[i]["kind"], str) else next(iter(docs[i]["kind"]))
        assert kind == r.kind and docs[i]["intent"]["primary"] == r.primary and r.name in entries[i].entry
        assert "## Change Type: " in prompts[i] and len(prompts[i].split("### Body Diff")[-1].encode()) < 3000 + 1500
    summary = run(spark, sf, "summary_prompt")
    assert len(summary) == 1 and f"- Total changes: {len(primary)}\n" in summary[0].prompt and summary[0].prompt.count("\n- [") == min(50, len(primary))


def test_greedy_assignment_is_one_to_one_by_score(spark, sf):
    scores = {(r.old_id, r.new_id): r.score for r in run(spark, sf, "within_fuzzy_candidates")}
    rows = run(spark, sf, "greedy_assignment")
    olds, news = {r.old_id: r.score for r in rows}, {r.new_id: r.score for r in rows}
    assert len(olds) == len(news) == len(rows) > 0
    assert all(max(olds.get(o, -1), news.get(n, -1)) >= s - 1e-6 for (o, n), s in scores.items())
    assert entry.entry(spark).select(F.col("total_changes")).first()[0] > 0


def test_contained_bodies_equal_brute_force(spark):
    import random

    from codestrata.operators import matching

    rng = random.Random(6)
    some = lambda n, letters="abcd ": "".join(rng.choice(letters) for _ in range(n))
    outer = [(i, some(rng.randrange(30, 400))) for i in range(60)] + [(100 + i, some(rng.randrange(10, 60), "日本語é")) for i in range(40)] + [(200, "x" * 300)]
    inner = []
    for k, (_, t) in enumerate(outer):
        for j in range(4):
            n = rng.choice([5, 7, 9, 12, 20, 21, 40, 90])
            at = rng.randrange(max(1, len(t) - n))
            inner.append((1000 + 10 * k + j, t[at : at + n] + ("z" if j == 3 else "")))
    size = lambda x: len(x.encode())
    want = sorted((o, i) for o, x in outer for i, y in inner if size(x) >= 50 and size(y) >= 20 and y in x and size(y) / size(x) > 0.15)
    frame = lambda rows: spark.createDataFrame(rows, "sym_id long, normalized_body string")
    got = sorted((r.outer_id, r.inner_id) for r in matching._contained(frame(outer), frame(inner)).collect())
    assert got == want and len(want) > 60
