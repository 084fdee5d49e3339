"""Relations behind a side-by-side view: order, groups, nesting and regions of changes.

changes: id, kind, file_info, file_path, line_start, line_end.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions import text

#: Stretches of lines that are handed on at once.
STRETCHES = 4096


def nav_order(changes: DataFrame) -> DataFrame:
    """id, file_info, place: by path, start line and id. Places run within a file, files are ordered by path_key."""
    w = Window.partitionBy("file_info").orderBy("line_start", "id")
    return changes.select("id", "file_info", "line_start", text.path_key("file_info").alias("path_key"), F.row_number().over(w).alias("place"))


def file_groups(changes: DataFrame) -> DataFrame:
    """file_info, changes, only_added, only_deleted (one column is enough to show the file)."""
    return changes.groupBy("file_info").agg(F.count("*").alias("changes"), F.bool_and(F.col("kind") == "Added").alias("only_added"), F.bool_and(F.col("kind") == "Deleted").alias("only_deleted"))


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Depths of spans that come sorted by file_path, line_start, the last line_end first, and id. Holds the stack of one file."""
    file, stack = (), []
    for rb in batches:
        depths = []
        for path, start, end in zip(*(rb.column(c).to_pylist() for c in ("file_path", "line_start", "line_end")), strict=True):
            if (path,) != file:
                file, stack = (path,), []
            while stack and None not in (start, stack[-1][0]) and start > stack[-1][0]:
                stack.pop()
            depths.append(stack[-1][1] + 1 if stack else 0)
            stack.append((end, depths[-1]))
        yield pa.RecordBatch.from_arrays([rb.column("file_path"), rb.column("id"), pa.array(depths, pa.int32())], names=["file_path", "id", "depth"])


def nesting_depth(spans: DataFrame) -> DataFrame:
    """spans: file_path, id, line_start, line_end. The depth of each in a stack of spans that haven't ended before it starts.

    The stack is replayed over sorted spans, many files in a batch, however small or large these are; it also gives the depth of spans that overlap without nesting."""
    own = spans.select("file_path", F.col("id").cast("long").alias("id"), "line_start", "line_end")
    dealt = own.repartition("file_path").sortWithinPartitions("file_path", F.asc_nulls_last("line_start"), F.desc_nulls_last("line_end"), F.asc_nulls_last("id"))
    return dealt.mapInArrow(_replayed, "file_path string, id long, depth int")


def _levels(spans: DataFrame) -> int:
    """The highest level of blocks (of 2 ** level lines) that a span can hold whole."""
    longest = spans.agg(F.max(F.col("line_end") - F.col("line_start") + 1)).first()[0]
    return max(longest or 1, 1).bit_length() - 1


def covering(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points (file_path, line) with each span that covers it: file_path, line, line_start, line_end, id.

    A range join by equality: a span is cut into the largest aligned blocks of 2 ** level lines, two a level at most, and a point has one block a
    level. So rows grow with spans and the logarithm of their length, not with lines."""
    top = _levels(spans)

    def blocks(k: Column) -> Column:
        size = F.pow(F.lit(2), k).cast("long")
        first, end = F.floor((F.col("line_start") + size - 1) / size), F.floor((F.col("line_end") + 1) / size)
        # whole blocks whose parent is not whole: an odd first one, an even last one
        edges = F.array(F.when(first % 2 == 1, first), F.when(end % 2 == 1, end - 1))
        own = F.when(k == top, F.array(first)).otherwise(F.array_compact(edges))
        return F.transform(F.when(first < end, own).otherwise(F.array().cast("array<bigint>")), lambda i: F.struct(k.alias("level"), i.alias("block")))

    cut = spans.where("line_start <= line_end").withColumn("b", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(top)), blocks))))
    cut = cut.select("file_path", "line_start", "line_end", "id", "b.level", "b.block")
    at = points.withColumn("b", F.explode(F.transform(F.sequence(F.lit(0), F.lit(top)), lambda k: F.struct(k.alias("level"), F.floor(F.col("line") / F.pow(F.lit(2), k).cast("long")).alias("block")))))
    return at.select("file_path", "line", "b.level", "b.block").join(cut, ["file_path", "level", "block"]).drop("level", "block")


def _stretches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Of spans that come sorted by file_path and line_start, the lines from one turn to the next with the ids that cover them. Holds what is open in one file."""
    file, at, held, ends, out = None, 0, [], [], []

    def until(line: int | None) -> None:
        """Closes what ends before line, or all."""
        nonlocal at
        while ends and (line is None or at < line):
            turn = ends[0][0] + 1 if line is None else min(ends[0][0] + 1, line)
            if turn > at:
                out.append((file, at, turn - 1, [x[2] for x in held]))
            at = turn
            while ends and ends[0][0] < at:
                span = heapq.heappop(ends)[1]
                del held[bisect.bisect_left(held, span)]

    for rb in batches:
        for path, start, end, key in zip(*(rb.column(c).to_pylist() for c in ("file_path", "line_start", "line_end", "id")), strict=True):
            if path != file:
                until(None)
                file = path
            until(start)
            span = (start - end, key is not None, key)  # the largest first, then by id
            at = start
            bisect.insort(held, span)
            heapq.heappush(ends, (end, span))
            if len(out) >= STRETCHES:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
                out.clear()
    until(None)
    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)


def region_lines(spans: DataFrame) -> DataFrame:
    """file_path, line, regions: the ids of the spans that cover each line, the largest first, then by id.

    What covers a line changes only where spans start or have ended: sorted spans are read as a stream; lines in between are written out last."""
    own = spans.select("file_path", "line_start", (F.col("line_end") + 0).alias("line_end"), "id").where("file_path IS NOT NULL AND line_start <= line_end")
    path, line, key = (own.schema[c].dataType for c in ("file_path", "line_end", "id"))
    made = T.StructType([T.StructField("file_path", path), T.StructField("line", line), T.StructField("until", line), T.StructField("regions", T.ArrayType(key))])
    arrow = to_arrow_schema(made)
    held = own.repartition("file_path").sortWithinPartitions("file_path", "line_start").mapInArrow(lambda batches: _stretches(batches, arrow), made)
    return held.select("file_path", F.explode(F.sequence("line", "until")).alias("line"), "regions")


def starting_and_ending(spans: DataFrame) -> DataFrame:
    """file_path, line, starting, ending: ids of the spans that start and end at a line."""
    at = spans.select("file_path", F.col("line_start").alias("line"), F.col("id").alias("s"), F.lit(None).cast("long").alias("e")).unionByName(spans.select("file_path", F.col("line_end").alias("line"), F.lit(None).cast("long").alias("s"), F.col("id").alias("e")))
    return at.groupBy("file_path", "line").agg(F.sort_array(F.collect_list("s")).alias("starting"), F.sort_array(F.collect_list("e")).alias("ending"))


def innermost(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points: file_path, line. The id of the smallest span that covers each point, of equal ones the least."""
    held = covering(points.select("file_path", "line").distinct(), spans)
    return held.groupBy("file_path", "line").agg(F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("size"), "id"))["id"].alias("id"))


def preload(changes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """side, path, content of the files on either side that hold a changed symbol. before, after: path, content."""

    def touched(files: DataFrame, side: str) -> DataFrame:
        paths = changes.select(F.col(f"{side}.file_path").alias("path")).where("path IS NOT NULL").distinct()
        return files.join(paths, "path", "left_semi").select(F.lit(side).alias("side"), "path", "content")

    return touched(before, "old").unionByName(touched(after, "new"))


def impact_lines(callers: DataFrame, warnings: DataFrame, name: str, fallback: int = 5) -> tuple[DataFrame, DataFrame]:
    """Callers of a changed name, and its warnings; without any, the first few of all."""
    own = warnings.where(F.col("changed_symbol") == name)
    if not own.limit(1).count():
        own = warnings.orderBy(F.desc("similarity"), "message").limit(fallback)
    return callers.where(F.col("changed_callee") == name), own
