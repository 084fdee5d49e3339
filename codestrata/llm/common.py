"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stage import new_path
from ..sources.stage import stage as materialize

__all__ = ["WHITE", "materialize", "new_path", "release", "table", "text_or_empty"]

#: ASCII white space as the contracts define it: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Gives a Python worker's freed memory back, so that workers that are kept for the next stage stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(Exception):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("string")
