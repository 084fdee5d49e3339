import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from codestrata import cli
from codestrata.plans import diff, impact, report, views
from codestrata.operators import similar
from codestrata.operators.extract import extract_calls, extract_symbols
from codestrata.sources import files, gitsource, index

OLD = {"a.rs": "pub fn area(w: i32) -> i32 {\n    let x = w * w;\n    x\n}\nfn gone(q: u8) -> u8 { q + 41 + 17 }\n", "b.py": "def use():\n    return area(3)\n", "c.go": "package m\nfunc Moved(a int) int { return a*a + 7 }\n"}
NEW = {"a.rs": "pub fn area(w: i32, h: i32) -> i32 {\n    let x = w * h;\n    x\n}\n", "b.py": "def use():\n    return area(3)\n", "d/c2.go": "package m\nfunc Moved(a int) int { return a*a + 7 }\n", "target/skip.rs": "fn skip() {}", "note.txt": "x"}


def write(root, tree):
    for p, t in tree.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)


def git(root, *a):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)


def kinds(df):
    return sorted((r.kind, r.name) for r in df.collect())


WANT = [("Deleted", "gone"), ("Moved", "Moved"), ("SignatureChanged", "area")]


def test_directories(spark, tmp_path):
    write(tmp_path / "old", OLD)
    write(tmp_path / "new", NEW)
    assert files.collect_files(str(tmp_path / "new")) == ["a.rs", "b.py", "d/c2.go", "note.txt"]
    o, n = (files.read_directory(spark, str(tmp_path / x)) for x in ("old", "new"))
    d = diff.diff(extract_symbols(o), extract_symbols(n))
    assert kinds(d) == WANT
    row = d.where("kind = 'SignatureChanged'").first()
    assert row.description == "+1params" and row.primary == "Feature" and row["lines"][0].tag == "Delete"
    found = impact.analyze_files(d, n)
    assert [(r.caller_symbol, r.changed_callee, r.risk) for r in found["affected_callers"].collect()] == [("use", "area", "High")]
    assert found["risk_summary"].first().high_risk_count == 1


def test_git_index_and_command_line(spark, tmp_path, monkeypatch):
    root = tmp_path / "repo"
    write(root, OLD)
    git(tmp_path, "init", "-q", "repo")
    git(root, "add", "-A")
    git(root, "commit", "-qm", "one")
    for p in OLD:
        (root / p).unlink()
    write(root, NEW)
    git(root, "add", "-A")
    git(root, "commit", "-qm", "two")
    assert files.parse_git_range("develop") == ("develop", "HEAD") and files.parse_git_range("a..b") == ("a", "b")
    o, n = files.range_snapshots(spark, str(root), "HEAD~1..HEAD")
    assert kinds(diff.diff(extract_symbols(o), extract_symbols(n))) == sorted([*WANT, ("Added", "skip")])  # only directories are filtered
    source = files.read_revision(spark, str(root), "HEAD")
    index.save(source, str(tmp_path / "ix"), "abc")
    got = index.load(spark, str(tmp_path / "ix"), "abc")
    assert got["symbols"].count() == extract_symbols(source).count() and index.load(spark, str(tmp_path / "ix"), "other") is None
    assert len(got["symbols"].first()["minhash"]) == 64
    text = cli.main(["HEAD~1..HEAD", "--repo", str(root), "--exclude", "*c2.go"])
    assert "[SIG] area" in text and "Moved (" not in text
    assert cli.main(["symbols", str(root / "a.rs")]).startswith("Function area 1-4")
    none = json.loads(cli.main(["--dirs", str(root), str(root), "--output", "json"]))
    assert none["diff"]["changes"] == [] and none["diff"]["summary"]["total_changes"] == 0 and "repo_analysis" not in none
    # the index of a commit, and the working tree against it
    ix = str(tmp_path / "index")
    assert cli.main(["index", "--repo", str(root), "--index-dir", ix]).startswith("indexed ")
    monkeypatch.setattr(files, "read_revision", lambda *a: pytest.fail("the index should have been used"))
    monkeypatch.setattr(similar.features, "shingle_hashes", lambda *a: pytest.fail("shingles should have been read"))
    (root / "a.rs").write_text(OLD["a.rs"])
    (root / "b.py").unlink()
    options = ["--repo", str(root), "--repo-analysis", "--index-dir", ix]
    text = cli.main(options)
    assert "[SIG] area" in text and "[DEL] use" in text and "[ADD] gone" in text
    assert "=== Repo-Wide Impact Analysis ===\nScanned: 4 symbols, 1 call edges\n\nRisk: 1 high, 0 medium, 0 low\n\n--- Affected Callers (1) ---\n  [HIGH] use @ b.py:2\n       calls 'area' which was: signature changed" in text
    got = json.loads(cli.main([*options, "--output", "json"]))
    assert {json.dumps(c["kind"])[:19] for c in got["diff"]["changes"]} >= {'"Deleted"', '"Added"'} and got["repo_analysis"]["total_repo_symbols"] == 4
    assert [c["caller_symbol"] for c in got["repo_analysis"]["impact"]["affected_callers"]] == ["use"] and got["repo_analysis"]["impact"]["risk_summary"]["high_risk_count"] == 1
    monkeypatch.undo()
    o, n = files.working_snapshots(spark, str(root))
    d = diff.diff(extract_symbols(o), extract_symbols(n))
    assert sorted((r.side, r.path) for r in views.preload(d, o, n).collect()) == [("new", "a.rs"), ("old", "a.rs"), ("old", "b.py")]


def plain(df):
    return sorted((tuple(str(r[c]) for c in sorted(df.columns) if c != "sym_id") for r in df.collect()), key=str)


def test_an_index_parses_only_what_is_new(spark, tmp_path, monkeypatch):
    ix, more = str(tmp_path / "ix"), str(tmp_path / "other")
    source = lambda tree: spark.createDataFrame([(p, t.encode()) for p, t in tree.items()], files.FILES)
    parsed = []
    extract = index.extract_symbols
    monkeypatch.setattr(index, "extract_symbols", lambda df: parsed.append(sorted(r.path for r in df.select("path").collect())) or extract(df))
    one = {**OLD, "e.go": "package m\nfunc Same(a int) int { return a }\n"}
    two = {**one, "a.rs": NEW["a.rs"], "f/e.go": one["e.go"]}
    del two["b.py"]
    assert index.save(source(one), ix, "c1") == {"files": 4, "parsed": 4, "gone": 0, "symbols": 5}
    assert index.save(source(two), ix, "c2") == {"files": 4, "parsed": 2, "gone": 1, "symbols": 4}
    assert index.save(source(one), ix, "c3") == {"files": 4, "parsed": 0, "gone": 1, "symbols": 5}  # back again
    assert parsed == [["a.rs", "b.py", "c.go", "e.go"], ["a.rs", "f/e.go"], []]
    assert index.save(source(two), ix, "c2")["parsed"] == 2  # done again: the same
    for commit, tree in (("c1", one), ("c2", two), ("c3", one)):
        index.save(source(tree), f"{more}{commit}", commit)
        got, want = index.load(spark, ix, commit), index.load(spark, f"{more}{commit}", commit)
        assert plain(got["symbols"]) == plain(want["symbols"]) and plain(got["calls"]) == plain(want["calls"])
        ids = [r.sym_id for r in got["symbols"].collect()]
        assert len(ids) == len(set(ids))
        lines = [(r.file_path, r.line_start) for r in got["symbols"].orderBy("sym_id").collect()]
        assert all(a[1] <= b[1] for a, b in zip(lines, lines[1:]) if a[0] == b[0])
    assert {(r.path, r.state) for r in index.load(spark, ix, "c2")["files"].collect()} == {("a.rs", "parsed"), ("f/e.go", "parsed"), ("c.go", "kept"), ("e.go", "kept"), ("b.py", "gone")}
    assert index.load(spark, ix, "c9") is None


def test_symbols_of_one_key(spark):
    """Of two symbols of a key the last stands for it; the body of the other is still found as a duplicate."""
    rust = "#[cfg(a)]\nfn twice(x: i32) -> i32 { let y = x + 1; y * 2 }\n#[cfg(b)]\nfn twice(x: i32) -> i32 { x }\n"
    source = spark.createDataFrame([("a.rs", rust.encode()), ("b.rs", b"fn other(x: i32) -> i32 { let y = x + 1; y * 2 }\n")], files.FILES)
    symbols = impact.keyed(extract_symbols(source))
    known = impact.standing(symbols)
    assert [(r.key, r.line_start) for r in known.where("name = 'twice'").collect()] == [("a.rs:twice", 4)]
    body = {r.name: r.body_hash for r in symbols.where("line_start <> 4").collect()}
    same = symbols.withColumn("body_hash", F.when(F.col("line_start") == 4, F.col("body_hash")).otherwise(F.lit(body["other"])))
    found = similar.find_similar(impact.standing(same).where("name = 'other'"), impact.standing(same), every=same).where("kind = 'ExactDuplicate'").collect()
    assert [(r.changed_symbol, r.similar_symbol, r.line_start) for r in found] == [("other", "twice", 4)]


def test_impact_entries(spark):
    place = "file_path string, line_start int, line_end int, similarity double"
    found = {
        "affected_callers": spark.createDataFrame([("g", "b.rs", 7, "f", "renamed f -> h", "Medium", 1), ("e", "a.rs", 3, "f", "renamed f -> h", "High", 0)], "caller_symbol string, caller_file string, caller_line int, changed_callee string, change_description string, risk string, depth int"),
        "similar_code": spark.createDataFrame([("f", "k", "c.rs", 1, 4, 0.755, "StructurallySimilar"), ("f", "l", "c.rs", 5, 9, 1.0, "ExactDuplicate")], f"changed_symbol string, similar_symbol string, {place}, kind string"),
        "pattern_warnings": spark.createDataFrame([("Exact duplicate of 'f' exists but was not changed", "f", "l", "c.rs", 5, 9, 1.0)], f"message string, changed_symbol string, related_symbol string, {place}"),
        "risk_summary": spark.createDataFrame([(2, 1, 1, 0, 2, 1)], "total_affected_callers int, high_risk_count int, medium_risk_count int, low_risk_count int, total_similar_code int, total_pattern_warnings int"),
        "scanned": spark.createDataFrame([(9, 4)], "total_repo_symbols int, call_graph_edges int"),
    }
    assert report.impact_report(found).split("\n")[2:] == [
        "Scanned: 9 symbols, 4 call edges", "", "Risk: 1 high, 1 medium, 0 low", "", "--- Affected Callers (2) ---",
        "  [HIGH] e @ a.rs:3", "       calls 'f' which was: renamed f -> h", "  [MED ] g @ b.rs:7 (depth 1)", "       calls 'f' which was: renamed f -> h", "",
        "--- Similar Code (2) ---", "  [EXACT] l @ c.rs:L5-9  (100% similar to f)", "  [SIMILAR] k @ c.rs:L1-4  (76% similar to f)", "",
        "--- Pattern Warnings (1) ---", "  [WARN] Exact duplicate of 'f' exists but was not changed", "         @ c.rs:L5-9", "",
    ]
    none = {k: df.limit(0) for k, df in found.items()} | {"scanned": found["scanned"], "risk_summary": spark.createDataFrame([(0, 0, 0, 0, 0, 0)], found["risk_summary"].schema)}
    assert report.impact_report(none).endswith("\n\nNo impact detected.")


def test_a_commit_is_read_in_parts(spark, tmp_path):
    root = tmp_path / "repo"
    tree = {"a\nb.py": "x = 1\n", "ü ö.rs": "fn f() {}\n", "big.go": "package p\n" + "// filler\n" * 200_000, "n.txt": "no", "e.py": "", **{f"d/{i}.ts": f"let a{i} = {i};\n" * 2000 for i in range(30)}}
    write(root, tree)
    (root / "d/c.js").write_bytes(b"\xff\x00\n")
    git(tmp_path, "init", "-q", "repo")
    git(root, "add", "-A")
    git(root, "commit", "-qm", "one")
    want = {p: t.encode() for p, t in tree.items() if p != "n.txt"} | {"d/c.js": b"\xff\x00\n"}
    got = files.read_revision(spark, str(root), "HEAD")
    assert {r.path: bytes(r.content) for r in got.collect()} == want
    some = spark.createDataFrame([("a\nb.py",), ("n.txt",), ("gone.py",), ("e.py",)], "path string")
    assert {r.path for r in files.read_revision(spark, str(root), "HEAD", some).collect()} == {"a\nb.py", "e.py"}
    listed = [f for f in gitsource.tree(str(root), "HEAD") if gitsource.supported(f[0])]
    parts = gitsource.plan(listed, 100_000)
    assert [f for p in parts for f in p.files] == [f[:2] for f in listed] and len(parts) > 8
    sizes = {f[0]: f[2] for f in listed}
    assert all(sum(sizes[f] for f, _ in p.files) <= 100_000 or len(p.files) == 1 for p in parts)
    reader = gitsource.Reader({"repo": str(root), "commit": "HEAD"})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == len(want)
    with pytest.raises(ValueError, match="ls-tree"):
        gitsource.tree(str(root), "nothing")


def test_worker_memory_is_bounded(tmp_path):
    """300 MB of blobs through one partition."""
    root = tmp_path / "repo"
    write(root, {f"f{i}.rs": f"// {i}\n" + "x" * 3_000_000 for i in range(100)})
    git(tmp_path, "init", "-q", "repo")
    git(root, "add", "-A")
    git(root, "commit", "-qm", "one")
    code = f"""
import resource
from codestrata.sources.gitsource import Reader
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
r = Reader({{"repo": {str(root)!r}, "commit": "HEAD", "partitionBytes": "1000000000"}})
parts = r.partitions()
assert len(parts) == 1 and sum(b.num_rows for b in r.read(parts[0])) == 100
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert int(out.stdout.split()[-1]) < 80
