"""A Spark data source of the files of a git commit: path, content.

The tree is listed when the scan is planned (names, blob ids and sizes), and dealt to partitions of about PARTITION_BYTES. A partition asks one
`git cat-file --batch` for its blobs by their ids, so that any path can be read, and reads the answers as a stream: a worker holds one Arrow batch of BATCH_BYTES and one
file at a time. The repository must be one that all executors see."""

from __future__ import annotations

import json
import subprocess
import threading
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PARTITION_BYTES, BATCH_BYTES = 16 << 20, 4 << 20
# The extensions of the languages that are read.
EXTENSIONS = ("rs", "go", "ts", "tsx", "svelte", "js", "mjs", "cjs", "py")


def run_git(repo: str, *args: str) -> bytes:
    r = subprocess.run(["git", "-C", repo, *args], capture_output=True, check=False)
    if r.returncode:
        raise ValueError(f"git {args[0]}: {r.stderr.decode(errors='replace').strip()}")
    return r.stdout


def tree(repo: str, commit: str) -> list[tuple[str, str, int]]:
    """Path, blob id and size of every file of a commit."""
    out = []
    for entry in run_git(repo, "ls-tree", "-r", "-l", "-z", commit).decode("utf-8", "replace").split("\0"):
        if entry:
            head, path = entry.split("\t", 1)
            _, kind, blob, size = head.split()
            if kind == "blob":  # not a submodule
                out.append((path, blob, int(size)))
    return out


def supported(path: str) -> bool:
    name, dot, ext = path.rpartition("/")[2].rpartition(".")
    return bool(dot) and ext in EXTENSIONS


@dataclass
class Blobs(InputPartition):
    files: list[tuple[str, str]]


def plan(files: list[tuple[str, str, int]], most: int) -> list[Blobs]:
    """Partitions of about `most` bytes, in the tree's order; a larger file is one of its own."""
    out, held, size = [], [], 0
    for path, blob, n in files:
        if held and size + n > most:
            out.append(Blobs(held))
            held, size = [], 0
        held.append((path, blob))
        size += n
    return [*out, Blobs(held)] if held else out


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.commit = options["repo"], options["commit"]
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.only = set(json.loads(options["paths"])) if "paths" in options else None

    def partitions(self) -> list[Blobs]:
        wanted = [f for f in tree(self.repo, self.commit) if supported(f[0]) and (self.only is None or f[0] in self.only)]
        return plan(wanted, self.most) or [Blobs([])]

    def read(self, partition: Blobs) -> Iterator[pa.RecordBatch]:
        if not partition.files:
            return
        git = subprocess.Popen(["git", "-C", self.repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

        def ask() -> None:  # beside the reading, or both pipes could fill up
            with git.stdin:
                for _, blob in partition.files:
                    git.stdin.write(f"{blob}\n".encode())

        asking = threading.Thread(target=ask, daemon=True)
        asking.start()
        paths, contents, size = [], [], 0
        try:
            for path, blob in partition.files:
                head = git.stdout.readline().split()
                if len(head) != 3:
                    raise ValueError(f"git cat-file: {path} ({blob}) can't be read")
                contents.append(git.stdout.read(int(head[2])))
                git.stdout.read(1)
                paths.append(path)
                size += len(contents[-1])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], names=["path", "content"])
                    paths, contents, size = [], [], 0
            if paths:
                yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], names=["path", "content"])
            asking.join()
        finally:
            git.kill()
            git.wait()


class GitFiles(DataSource):
    """spark.read.format("gitfiles").options(repo=..., commit=...).load(); paths: a JSON list of those wanted."""

    @classmethod
    def name(cls) -> str:
        return "gitfiles"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema) -> Reader:
        return Reader(self.options)
