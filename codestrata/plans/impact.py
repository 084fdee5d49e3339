"""Impact of changes on the rest of a code base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import classify, graph, similar
from ..operators.extract import extract_calls, extract_symbols
from ..sources import files, index
from ..sources.stage import stage


def keyed(symbols: DataFrame) -> DataFrame:
    return symbols.withColumn("key", F.concat_ws(":", "file_path", "qualified_name"))


def standing(symbols: DataFrame) -> DataFrame:
    """One symbol of each key: the last in its file, which stands for all of the key (as in overloads and conditional variants)."""
    last = Window.partitionBy("key").orderBy(F.desc("sym_id"))
    return symbols.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def analyze(changes: DataFrame, symbols: DataFrame, calls: DataFrame, depth: int = 2, min_similarity: float = 0.6, mode: str = "full") -> dict[str, DataFrame]:
    """changes: kind, old, new of plans.diff; symbols and calls: of the whole code base. Similarity features are computed where symbols don't have them (sources.index).

    Returns affected_callers, similar_code, pattern_warnings, risk_summary and scanned (total_repo_symbols, call_graph_edges)."""
    said, level = classify.risk(F.col("kind"), F.col("old"), F.col("new"))
    named = changes.select(classify.symbol_name(F.col("old"), F.col("new")).alias("name"), said.alias("description"), level.alias("risk"))
    callers = stage(graph.affected_callers(named, calls, depth))
    own = F.coalesce("new", "old")
    touched = changes.select(F.concat_ws(":", own["file_path"], own["qualified_name"]).alias("key")).distinct()
    every = keyed(symbols)
    known = stage(standing(every))
    found = stage(similar.find_similar(known.join(touched, "key", "left_semi"), known, min_similarity, mode, every))
    warnings = stage(graph.pattern_warnings(found))
    return {"affected_callers": callers, "similar_code": found, "pattern_warnings": warnings, "risk_summary": graph.risk_summary(callers, found, warnings), "scanned": graph.scanned(symbols, calls)}


def code_base(spark: SparkSession, repo: str, ref: str, index_dir: str | None = None) -> tuple[DataFrame, DataFrame]:
    """symbols and calls of a commit: from the saved index if it has the commit, else from its files."""
    commit = files.validate_ref(repo, ref)
    saved = index.load(spark, index_dir, commit) if index_dir else None
    if saved:
        return saved["symbols"], saved["calls"]
    source = stage(files.read_revision(spark, repo, commit))
    return stage(extract_symbols(source)), stage(extract_calls(source))


def symbols_at(spark: SparkSession, repo: str, ref: str, paths: DataFrame, index_dir: str | None = None) -> DataFrame:
    """The symbols of some files (path) at a commit, from the saved index if it has the commit, else parsed."""
    commit = files.validate_ref(repo, ref)
    saved = index.load(spark, index_dir, commit) if index_dir else None
    return index.symbols_of(saved, paths) if saved else extract_symbols(files.read_revision(spark, repo, commit, paths))


def range_symbols(spark: SparkSession, repo: str, spec: str | None, index_dir: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The symbols of the files that a range changes, before and after; without one, of those that the working tree changes."""
    old, new = files.parse_git_range(spec) if spec else ("HEAD", None)
    before, after = files.changed_paths(spark, repo, old, new)
    then = symbols_at(spark, repo, old, before, index_dir)
    return then, symbols_at(spark, repo, new, after, index_dir) if new else extract_symbols(files.read_directory(spark, repo, after))


def analyze_files(changes: DataFrame, source: DataFrame, **options) -> dict[str, DataFrame]:
    """The same over source files (path, content)."""
    return analyze(changes, extract_symbols(source), stage(extract_calls(source)), **options)
