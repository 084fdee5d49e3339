"""Similarity features: character shingles, 64-bit hashes, MinHash signatures and name stems."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import ColumnOrName, bound, col

SHINGLE = 4
SIGNATURE = 64
#: Characters of texts whose results are handed on together.
SLICE = 1 << 18
_OFFSET, _PRIME = 0xCBF29CE484222325, 0x100000001B3
# Start, factor and step of the generator of the signature's multipliers.
_START, _FACTOR, _STEP = 0x517CC1B727220A95, 6364136223846793005, 1442695040888963407


def slices(*columns: pd.Series) -> Iterator[tuple[pd.Series, ...]]:
    """Rows of columns of texts, about SLICE characters at a time. What is made of them is handed on before the next are taken, so that memory doesn't grow with a batch's rows."""
    sizes = sum(c.str.len().fillna(0).to_numpy(np.int64) for c in columns)
    part = np.cumsum(sizes) // SLICE if len(sizes) else sizes
    for at in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(part)) + 1):
        if len(at):
            yield tuple(c.iloc[at[0] : at[-1] + 1] for c in columns)


def each(texts: Iterator[pd.Series], f: Callable[[str], np.ndarray]) -> Iterator[pd.Series]:
    """f of each text, the empty one for null, slice by slice."""
    for batch in texts:
        for (part,) in slices(batch):
            yield pd.Series([f(t or "") for t in part])


def shingles(c: ColumnOrName, n: int = SHINGLE) -> Column:
    """Distinct character n-grams as strings; none for shorter texts."""
    def grams(chars: Column) -> Column:
        last = F.greatest(F.size(chars) - n, F.lit(0))
        return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(*(F.get(chars, i + k) for k in range(n)))))

    return F.when(F.length(col(c)) < n, F.array().cast("array<string>")).otherwise(bound(F.split(col(c), ""), grams))


def multipliers(n: int = SIGNATURE) -> np.ndarray:
    out, h = [], _START
    for _ in range(n):
        h = (h * _FACTOR + _STEP) % 2**64
        out.append(h)
    return np.array(out, np.uint64)


def fnv1a(data: bytes) -> int:
    h = _OFFSET
    for b in data:
        h = (h ^ b) * _PRIME % 2**64
    return h


@F.pandas_udf(T.StringType())
def fnv1a_text(texts: pd.Series) -> pd.Series:
    """The unsigned 64-bit FNV-1a hash of a text's UTF-8 bytes, in decimal."""
    return texts.map(lambda t: None if t is None else str(fnv1a(t.encode("utf-8", "surrogatepass"))))


def _hash_each(text: str, n: int) -> np.ndarray:
    """The FNV-1a hashes of the UTF-8 bytes of a text's n-grams, in order."""
    if len(text) < n:
        return np.zeros(0, np.uint64)
    raw = text.encode("utf-8", "surrogatepass")
    a = np.frombuffer(raw, np.uint8)
    starts = np.flatnonzero((a & 0xC0) != 0x80)
    ends = np.append(starts[1:], len(a))
    at, to = starts[: len(starts) - n + 1], ends[n - 1 :]
    h = np.full(len(at), _OFFSET, np.uint64)
    for k in range(4 * n):
        p = at + k
        live = p < to
        if not live.any():
            break
        h[live] = (h[live] ^ a[p[live]]) * np.uint64(_PRIME)
    return h


def _hash_grams(text: str, n: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's n-grams."""
    return np.unique(_hash_each(text, n))


@F.pandas_udf(T.ArrayType(T.LongType()))
def shingle_hashes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Distinct 64-bit hashes (as signed longs) of the 4-grams of each text, in unsigned order."""
    yield from each(texts, lambda t: _hash_grams(t).view(np.int64))


def _least_of(h: np.ndarray, among: int) -> np.ndarray:
    """The distinct least ones of each `among` in a row, of all if there are fewer."""
    if len(h) < among:
        return np.unique(h.min(keepdims=True)) if len(h) else h
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, among).min(1))


def anchors(n: int, among: int) -> Callable[[ColumnOrName], Column]:
    """Distinct 64-bit hashes of those n-grams of texts that are least hashed among some `among` in a row. A text of that many n-grams or more
    that stands in another has one at least, and all its own are the other's too."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def hashes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from each(texts, lambda t: _least_of(_hash_each(t, n), among).view(np.int64))

    return hashes


def _signature(h: np.ndarray) -> np.ndarray:
    m = multipliers()
    if not len(h):
        return np.full(SIGNATURE, 2**64 - 1, np.uint64).view(np.int64)
    least = np.full(SIGNATURE, 2**64 - 1, np.uint64)
    for at in range(0, len(h), 4096):
        np.minimum(least, (h[at : at + 4096, None] * m[None] + m[None]).min(0), out=least)
    return least.view(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def minhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """64 unsigned minima of hash * m + m modulo 2^64, as signed longs."""
    yield from each(texts, lambda t: _signature(_hash_grams(t)))


def minhash_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    """The share of equal positions."""
    return F.size(F.filter(F.arrays_zip(col(a).alias("x"), col(b).alias("y")), lambda p: p["x"] == p["y"])) / F.lit(SIGNATURE)


def unsigned(c: Column) -> Column:
    """A signed long as the decimal number of its 64 bits."""
    d = c.cast("decimal(20,0)")
    return F.when(c < 0, d + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")


def stems(c: ColumnOrName) -> Column:
    """Lower-cased parts of a name between underscores and before capitals, sorted and distinct."""
    snake = F.filter(F.split(col(c), "_"), lambda p: p != "")
    camel = F.filter(F.split(col(c), r"(?<!^)(?=\p{Lu})"), lambda p: p != "")
    return F.array_sort(F.array_distinct(F.transform(F.concat(snake, camel), F.lower)))
