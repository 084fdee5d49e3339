"""Whitening of embeddings by a matrix-free block Lanczos eigensolver.

Entries become fixed-point longs, x = floor(64 c) + 1000000. The covariance V of the distinct x vectors is never formed: each step of the
solver is one distributed pass over them that gives V B for a block B of columns, from centred rows, X'(X B) / n. The basis is kept
orthogonal by full reorthogonalisation (twice), a direction that is spent (a breakdown) is replaced by a random one orthogonal to
all before, and the solver ends when the residuals of the wanted pairs are at rounding, or when the basis spans the whole space. The driver holds
the basis and its images only: dimension x steps x block doubles, whatever the number of rows. The trace comes from the rows' deviations.

Defined cases: a vector that is null, or holds a null or a non-finite entry, drops its row, and so does an entry whose x doesn't fit a long; where vectors differ in
length, those of the most frequent length stay (of equally frequent ones, the longest); a null vec_id is carried and repeated rows
are whitened each, though the fit counts a vector once; fewer components than asked come out where the dimension or the
rank is lower, and none (no rows in the query) from one distinct vector or an empty table; components of equal eigenvalues are any orthonormal basis of
their space; a deviation beyond a long is null; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Residuals that count as converged, against the largest eigenvalue; eigenvalues up to RANK of the trace count as zero.
TOLERANCE, RANK = 1e-14, 1e-11
SEED = 11


@dataclass(frozen=True)
class Whitener:
    """What fit() learns. components holds a unit eigenvector in each column, by falling eigenvalue."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float
    passes: int

    @property
    def explained(self) -> list[float]:
        return (self.eigenvalues / self.trace).tolist() if len(self.eigenvalues) else []


def fixed_point(vector: str | Column) -> Column:
    """The x vector as array<bigint>; null where the row is to be dropped."""
    v = F.transform(vector, lambda c: c.cast("double"))
    fits = F.forall(v, lambda c: c.isNotNull() & (F.abs(c) * SCALE < 2.0**62))  # NaN is the largest double to Spark
    return F.when(fits, F.transform(F.when(fits, v), lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("bigint")))


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - sums, exactly: int64 where all squares of a row fit one, else Python integers."""
    middle = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    far = max(float(np.abs(x.astype(float) - np.array(middle, dtype=float)).max(initial=0)) + 1, 1.0) * n
    if far * far * len(sums) < 2.0**62:
        return n * (x - np.array(middle, dtype=np.int64)) - np.array(rest, dtype=np.int64)
    return n * (x.astype(object) - np.array(middle, dtype=object)) - np.array(rest, dtype=object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n as doubles, rounded once."""
    return (scaled(x, n, sums) / n).astype(float)


def _pass(distinct: DataFrame, n: int, sums: list[int], block: np.ndarray, image: bool) -> tuple[np.ndarray, float]:
    """image: X'(X block) / n, else the covariance (X block)'(X block) / n of the projected rows; and the mean squared length of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros((len(block) if image else block.shape[1], block.shape[1])), 0.0
        for rb in batches:
            x = centred(_rows(rb.column(0)), n, sums)
            y = x @ block
            total += (x if image else y).T @ y
            squares += float((x * x).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size + 1)), pa.array(np.append(total.ravel(), squares))], names=["k", "v"])
        release()

    # one row for each entry of the block: as many as dimension x block, summed before and after the shuffle
    sums_of = dict(distinct.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v")).collect())
    flat = np.array([sums_of[k] for k in range(len(sums_of))]) / n
    return flat[:-1].reshape(-1, block.shape[1]), float(flat[-1])


def _orthonormal(block: np.ndarray, basis: np.ndarray, scale: float, random: np.random.Generator) -> np.ndarray:
    """The block's part outside the basis, as orthonormal columns. Columns with nothing left are replaced by random ones; there are
    no more than the space has room for."""
    out = basis
    room = basis.shape[0] - basis.shape[1]
    for column in block.T[:room]:
        v, least = column, 1e-10 * scale
        while True:
            for _ in range(2):
                v = v - out @ (out.T @ v)
            size = np.linalg.norm(v)
            if size > least:
                break
            v, least = random.standard_normal(len(column)), 1e-6  # breakdown: restart in the rest of the space
        v = v / size
        v = v - out @ (out.T @ v)
        out = np.column_stack([out, v / np.linalg.norm(v)])
    return out[:, basis.shape[1] :]


def lanczos(image, dimension: int, wanted: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, int]:
    """The largest eigenvalues and their vectors of a symmetric matrix that is only known by image(block) = matrix @ block; and how many
    images were taken."""
    random = np.random.default_rng(seed)
    width = min(wanted, dimension)  # of a block: no eigenvalue of a multiplicity up to it is missed
    basis = images = np.zeros((dimension, 0))
    block, scale, steps = random.standard_normal((dimension, width)), 1.0, 0
    while True:
        q = _orthonormal(block, basis, scale, random)
        w = image(q)
        steps += 1
        basis, images = np.column_stack([basis, q]), np.column_stack([images, w])
        t = basis.T @ images
        values, y = np.linalg.eigh((t + t.T) / 2)
        values, y = values[::-1][:width], y[:, ::-1][:, :width]
        scale = max(float(np.abs(values).max()), np.finfo(float).tiny)
        residuals = np.linalg.norm(images @ y - (basis @ y) * values, axis=0)
        if basis.shape[1] == dimension or residuals.max() <= TOLERANCE * scale:
            return values, basis @ y, steps
        block = w


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitener:
    """Learns from every distinct x vector of the table, each once."""
    x = vectors.select(fixed_point(vector).alias("x")).where("size(x) > 0")
    none = Whitener(0, [], np.zeros(0), np.zeros((0, 0)), 0.0, 0.0, 0)
    length = x.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if length is None:
        return none
    distinct = materialize(x.where(F.size("x") == length["size"]).distinct(), "vectors")

    def column_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = [0] * length["size"], 0
        for rb in batches:
            a = _rows(rb.column(0))
            small = float(np.abs(a.astype(float)).max(initial=0)) * len(a) < 2.0**62
            total = [t + int(s) for t, s in zip(total, (a if small else a.astype(object)).sum(axis=0), strict=True)]
            rows += len(a)
        whole = [*total, rows]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(whole))), pa.array([str(t) for t in whole])], names=["k", "v"])

    got = dict(distinct.mapInArrow(column_sums, "k long, v string").groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)"))).collect())
    *sums, n = (int(got[k]) for k in range(len(got)))
    trace = [0.0]

    def image(block: np.ndarray) -> np.ndarray:
        out, trace[0] = _pass(distinct, n, sums, block, image=True)
        return out

    values, vectors_, passes = lanczos(image, len(sums), components)
    real = values > RANK * trace[0]
    if not real.any():
        return Whitener(n, sums, np.zeros(0), np.zeros((len(sums), 0)), trace[0], 0.0, passes)
    values, vectors_ = values[real], vectors_[:, real]
    covariance, _ = _pass(distinct, n, sums, vectors_ / np.sqrt(values), image=False)
    return Whitener(n, sums, values, vectors_, trace[0], float(np.abs(covariance - np.eye(len(values))).max()), passes)


def whiten(vectors: DataFrame, model: Whitener, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Of each row that stays: its key, deviation (the sum over dimensions of (n x - sums)^2, exact) and whitened (array<double>, one for each component)."""
    n, sums, by = model.n, model.sums, model.components / np.sqrt(model.eigenvalues) if len(model.eigenvalues) else None
    x = vectors.select(F.col(key).cast("long").alias("key"), fixed_point(vector).alias("x")).where((F.size("x") == len(sums)) & F.lit(by is not None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            d = scaled(_rows(rb.column(1)), n, sums)
            squares = (d * d).sum(axis=1)
            deviation = pa.array(squares if squares.dtype == np.int64 else [int(s) if s < 2**63 else None for s in squares], pa.int64())
            w = (d / n).astype(float) @ by
            whitened = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([rb.column(0), deviation, whitened], names=[key, "deviation", "whitened"])

    return x.mapInArrow(run, f"`{key}` long, deviation long, whitened array<double>")


def components_of(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each row that stays and each component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    model = fit(vectors, components=components)
    explained = F.array(*(F.lit(e) for e in model.explained)).cast("array<double>")
    rows = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
