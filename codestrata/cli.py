"""Command line: python -m codestrata.cli [RANGE] [--dirs OLD NEW] ..., index, symbols."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .functions.text import excluded
from .operators.extract import extract_symbols
from .plans import diff, impact, report
from .sources import files, index
from .sources.stage import stage


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codestrata")
    p.add_argument("range", nargs="?", help="old..new, or a ref to compare with HEAD; without one, the working tree with HEAD; `index` and `symbols FILE` are commands")
    p.add_argument("file", nargs="?")
    p.add_argument("--dirs", nargs=2, metavar=("OLD", "NEW"))
    p.add_argument("--repo", default=".")
    p.add_argument("--repo-analysis", action="store_true")
    p.add_argument("--impact-depth", type=int, default=2)
    p.add_argument("--output", choices=("text", "json"), default="text")
    p.add_argument("--mode", choices=("compat", "full"), default="full")
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--ref", "--git-ref", default="HEAD")
    p.add_argument("--index-dir", default=".codestrata-index")
    return p


def main(argv: list[str] | None = None) -> str:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("codestrata").getOrCreate()
    if a.range == "symbols":
        s = extract_symbols(files.read_directory(spark, a.file)).orderBy("ord")
        return "\n".join(f"{r.kind} {r.qualified_name} {r.line_start}-{r.line_end} ({len(r.body_text.encode())} bytes)" for r in s.toLocalIterator())
    if a.range == "index":
        root = files.find_repo_root(a.repo)
        commit = files.validate_ref(root, a.ref)
        source = stage(files.read_revision(spark, root, commit))
        n = index.save(source, a.index_dir, commit)
        return f"indexed {n['symbols']} symbols of {commit} ({n['parsed']} of {n['files']} files parsed)"
    if a.dirs:
        after = files.read_directory(spark, a.dirs[1])
        sides = extract_symbols(files.read_directory(spark, a.dirs[0])), extract_symbols(after)
    else:
        root = files.find_repo_root(a.repo)
        sides = impact.range_symbols(spark, root, a.range, a.index_dir)
    details = stage(diff.diff(*(stage(s) for s in sides), a.mode))
    shown = details.where(~excluded("file_info", a.exclude)) if a.exclude else details
    found = None
    if a.repo_analysis:
        options = {"depth": a.impact_depth, "mode": a.mode}
        if a.dirs:
            found = impact.analyze_files(details, after, **options)
        else:
            new = files.parse_git_range(a.range)[1] if a.range else "HEAD"
            found = impact.analyze(details, *impact.code_base(spark, root, new, a.index_dir), **options)
    if a.output == "json":
        return report.json_document(shown, found)
    return report.text_report(shown) + (report.impact_report(found) if found else "")


if __name__ == "__main__":
    print(main())
