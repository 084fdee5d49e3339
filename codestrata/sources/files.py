"""Source files of a directory or of a git revision as (path, content) rows.

Paths are listed on the driver (names only); contents are read by the executors.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.text import language
from .gitsource import GitFiles, run_git, tree

# Directories that are never entered, besides those that start with a dot.
SKIPPED = ("target", "vendor", "node_modules")
FILES = "path string, content binary"


def collect_files(root: str) -> list[str]:
    """Sorted paths under a directory, relative to it; of a file, its name."""
    if os.path.isfile(root):
        return [os.path.basename(root)]
    found = []
    for top, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if not d.startswith(".") and d not in SKIPPED]
        found += [os.path.relpath(os.path.join(top, n), root) for n in names]
    return sorted(found)


def _paths(spark: SparkSession, paths: list[str], per_task: int = 256) -> DataFrame:
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return df.where(language("path").isNotNull()).repartition(max(1, -(-len(paths) // per_task)))


def read_directory(spark: SparkSession, root: str, paths: DataFrame | None = None) -> DataFrame:
    """path, content of all supported files, or of some (path). The directory must be one that all executors see."""
    base = os.path.abspath(root)
    base = os.path.dirname(base) if os.path.isfile(base) else base

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                try:
                    with open(os.path.join(base, p), "rb") as f:
                        rows.append((p, f.read()))
                except OSError:  # unreadable files are left out
                    continue
            yield pd.DataFrame(rows, columns=["path", "content"])

    wanted = paths.select("path").where(language("path").isNotNull()) if paths is not None else _paths(spark, collect_files(root))
    return wanted.mapInPandas(load, FILES)


def _git(repo: str, *args: str) -> str:
    return run_git(repo, *args).decode(errors="replace")


def find_repo_root(start: str) -> str:
    return _git(start, "rev-parse", "--show-toplevel").strip()


def current_branch(repo: str) -> str:
    return _git(repo, "rev-parse", "--abbrev-ref", "HEAD").strip()


def validate_ref(repo: str, ref: str) -> str:
    """The commit of a ref."""
    return _git(repo, "rev-parse", "--verify", f"{ref}^{{commit}}").strip()


def parse_git_range(spec: str) -> tuple[str, str]:
    """old..new; a single ref is compared with HEAD. Three dots are an error."""
    if "..." in spec:
        raise ValueError(f"{spec}: write a range with two dots")
    old, dots, new = spec.partition("..")
    return (old, new) if dots else (spec, "HEAD")


def list_files(repo: str, ref: str) -> list[str]:
    return [path for path, _, _ in tree(repo, ref)]


def changed_files(spark: SparkSession, repo: str, old: str, new: str | None) -> DataFrame:
    """path, status (A, M, D, R), old_path (of renames); other kinds of change are left out. Without new, up to the working tree."""
    parts = _git(repo, "diff", "--name-status", "-M", "-z", f"{old}..{new}" if new else old).split("\0")
    rows, i = [], 0
    while i < len(parts) - 1:
        s = parts[i]
        if re.match("[RC]", s):
            if s[0] == "R":
                rows.append((parts[i + 2], "R", parts[i + 1]))
            i += 3
        else:
            if s in ("A", "M", "D"):
                rows.append((parts[i + 1], s, None))
            i += 2
    return spark.createDataFrame(rows, "path string, status string, old_path string")


def read_revision(spark: SparkSession, repo: str, ref: str, paths: DataFrame | None = None) -> DataFrame:
    """path, content of the supported files of a commit, or of some (path; names that git told the driver). Missing files are left out."""
    spark.dataSource.register(GitFiles)
    options = {"repo": os.path.abspath(repo), "commit": validate_ref(repo, ref)}
    if paths is not None:
        options["paths"] = json.dumps([r.path for r in paths.select("path").collect()])
    return spark.read.format("gitfiles").options(**options).load()


def changed_paths(spark: SparkSession, repo: str, old: str, new: str | None) -> tuple[DataFrame, DataFrame]:
    """The paths (path) that changed between two commits, or up to the working tree, before and after: a rename has its old path before, additions come only after."""
    changed = changed_files(spark, repo, validate_ref(repo, old), validate_ref(repo, new) if new else None)
    return changed.where("status <> 'A'").selectExpr("coalesce(old_path, path) AS path"), changed.where("status <> 'D'").select("path")


def working_snapshots(spark: SparkSession, repo: str) -> tuple[DataFrame, DataFrame]:
    """The tracked files that the working tree changes, at HEAD and as they stand."""
    before, after = changed_paths(spark, repo, "HEAD", None)
    return read_revision(spark, repo, "HEAD", before), read_directory(spark, repo, after)


def range_snapshots(spark: SparkSession, repo: str, spec: str) -> tuple[DataFrame, DataFrame]:
    """The files that a range changes, before and after: a rename is read at its old path before, additions only after."""
    old, new = parse_git_range(spec)
    before, after = changed_paths(spark, repo, old, new)
    return read_revision(spark, repo, old, before), read_revision(spark, repo, new, after)
