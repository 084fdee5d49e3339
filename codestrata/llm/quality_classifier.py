"""Quality classification by ordinal cumulative-link regression on graded ratings.

A document's grade (0, 1, 2) follows P(grade <= j) = sigmoid(t_j - s) with increasing thresholds t_0 < t_1 and one shared score
s = sum of hashed weights of its distinct words, their beginnings of four and six bytes, how large a share of all words has the
same beginning, and tokens that describe its shape (shares of symbols, capitals, digits and repeated lines and words, lengths).
The expected grade and the tail probability P(grade >= 2) select documents.

Ratings: low quality is grade 0, good but toxic 1, good 2. Learned from at most SAMPLE_ROWS rated documents (those of least
hash): executors turn them into hashed features and count these by grade; the driver gets the features whose documents' mean grade stands out,
of each document those only, and fits.

Defined cases: a null text has no words, only shape tokens; labels with a null doc_id or quality are ignored, a null toxic is 0,
several labels of a document count as the lowest, of several texts of a rated doc_id the first in order is learned from; without any
label every document has expected grade 2; repeated rows give a row each, and equal results; a text of any length is read whole; a tail
probability right at the limit is kept; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import materialize, text_or_empty

SAMPLE_ROWS = 16_384
BITS = 22
GRADES = 3
#: Standard errors that the mean grade of a feature's documents must be off the mean of all.
LEAST_Z = 5.0
#: Least documents of a feature, and shares of a text's words from which words of one beginning count.
LEAST_DOCS = 3
SHARES = (1 / 512, 1 / 256, 1 / 128, 1 / 64, 1 / 32)
_SPACES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_SYMBOLS = b"#*$%&|<>=~^@\\{}"
_STEPS = (0.0, 0.002, 0.01, 0.03, 0.08, 0.2, 0.4, 0.7)


def _shape(raw: bytes, n_words: int, n_distinct: int) -> list[bytes]:
    size = max(1, len(raw))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    shares = (
        ("symbol", (len(raw) - len(raw.translate(None, _SYMBOLS))) / size),
        ("upper", (len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / size),
        ("digit", (len(raw) - len(raw.translate(None, b"0123456789"))) / size),
        ("bang", (len(raw) - len(raw.translate(None, b"!?"))) / size),
        ("lines", 1 - len(set(lines)) / max(1, len(lines))),
        ("again", 1 - n_distinct / max(1, n_words)),
    )
    out = [f"\x00{k}{int(np.searchsorted(_STEPS, v, side='right'))}".encode() for k, v in shares]
    return [*out, f"\x00words{n_words.bit_length()}".encode(), f"\x00length{min(20, size // max(1, n_words))}".encode()]


def _repeated(w: list[bytes]) -> Iterator[bytes]:
    """Beginnings of several words that have a share of all words: a token for each of the SHARES reached."""
    for start, n in Counter([x[:4] for x in w if len(x) > 4]).items():
        if n > 1:
            for i, share in enumerate(SHARES):
                if n < share * len(w):
                    break
                yield b"\x02%d" % i + start


def features(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The distinct hashed features of each text."""
    shift = np.uint64(64 - BITS)
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        w = raw.lower().translate(_SPACES).split()
        own = set(w)
        tokens = [*own, *{b"\x01" + x[:4] for x in own}, *{b"\x01" + x[:6] for x in own if len(x) > 6}, *_repeated(w), *_shape(raw, len(w), len(own))]
        yield np.unique(words.hash_words(tokens) >> shift).astype(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        own = [x.astype(np.int32) for x in features(rb.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(own, pa.list_(pa.int32()))], names=["grade", "ids"])


class Model:
    """Weights by hashed feature, and thresholds."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, cuts: np.ndarray):
        self.ids, self.weights, self.cuts = ids, weights, cuts

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS, np.float32)
        w[self.ids] = self.weights
        return w

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2 (columns)."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts[None], -60, 60)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, steps: int = 500, rate: float = 0.05, ridge: float = 1e-4, least_z: float = LEAST_Z) -> Model:
    """Maximum likelihood with a ridge, by Adam. Only features whose documents' mean grade stands out get a weight:
    the many rare words of long documents would add noise."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    ids, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    mean_by = np.bincount(inverse, grades[doc].astype(float), len(ids)) / times
    z = np.abs(mean_by - grades.mean()) * np.sqrt(times) / max(grades.std(), 1e-9)
    keep = ((times >= LEAST_DOCS) & (z >= least_z))[inverse]
    doc, inverse = doc[keep], inverse[keep]
    used, col = np.unique(inverse, return_inverse=True)
    n, m = len(rows), len(used)
    share = np.array([(grades >= j).mean() for j in range(1, GRADES)]).clip(0.01, 0.99)
    x = np.zeros(m + 2)
    cuts0 = -np.log(share / (1 - share))
    x[m], x[m + 1] = cuts0[0], np.log(max(0.1, cuts0[1] - cuts0[0]))
    mean, var = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, steps + 1):
        w, c0, gap = x[:m], x[m], np.exp(x[m + 1])
        s = np.bincount(doc, w[col], n)
        sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        f0, f1 = sig(c0 - s), sig(c0 + gap - s)
        p = np.choose(grades, [f0, f1 - f0, 1 - f1]).clip(1e-9)
        d0, d1 = f0 * (1 - f0), f1 * (1 - f1)
        g0 = np.choose(grades, [-d0, d0, np.zeros(n)]) / p / n  # by the first threshold
        g1 = np.choose(grades, [np.zeros(n), -d1, d1]) / p / n
        grad = np.concatenate([np.bincount(col, -(g0 + g1)[doc], m) + ridge * w, [(g0 + g1).sum(), g1.sum() * gap]])
        mean, var = 0.9 * mean + 0.1 * grad, 0.999 * var + 0.001 * grad**2
        x -= rate * (mean / (1 - 0.9**k)) / (np.sqrt(var / (1 - 0.999**k)) + 1e-8)
    return Model(ids[used], x[:m].astype(np.float32), np.array([x[m], x[m] + np.exp(x[m + 1])]))


def grade_of(quality, toxic):
    return F.when(quality == 0, 0).when(F.coalesce(toxic, F.lit(0)) == 1, 1).otherwise(2)


def _only(known: np.ndarray):
    """Of each row's features those known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            own = [x[np.isin(x, known)].astype("<i4").tobytes() for x in (np.asarray(y.values) for y in rb.column(1))]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(own, pa.binary())], names=["grade", "ids"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, least_z: float = LEAST_Z) -> Model:
    rated = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    # at most sample_rows rows: small enough to send to every executor
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample_rows).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")
    source = source.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    rated = materialize(source.select("grade", "text").mapInArrow(_features, "grade int, ids array<int>"), "rated")
    all_ = rated.agg(F.avg("grade").alias("mean"), F.stddev_pop("grade").alias("spread")).first()
    if all_["mean"] is None:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), np.array([-60.0, -60.0]))
    z = F.abs(F.avg("grade") - all_["mean"]) * F.sqrt(F.count("*")) / max(all_["spread"], 1e-9)
    by = rated.select("grade", F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"), z.alias("z"))
    # by chance about one feature in two million stands out: few, and of 2^BITS at most
    known = np.sort(by.where((F.col("n") >= LEAST_DOCS) & (F.col("z") >= least_z * (1 - 1e-9))).select("id").toArrow().column("id").to_numpy())
    got = rated.mapInArrow(_only(known), "grade int, ids binary").toArrow().sort_by([("grade", "ascending"), ("ids", "ascending")])
    return fit_ordinal([np.frombuffer(b, "<i4").astype(np.int64) for b in got.column("ids").to_pylist()], got.column("grade").to_numpy(), least_z=least_z)


def _score(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        w = model.dense()
        for rb in batches:
            s = np.array([w[x].sum(dtype=np.float64) for x in features(rb.column(1).to_pylist())])
            p = model.probabilities(s) if len(s) else np.zeros((0, 2))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(p.sum(1)), pa.array(p[:, 1])], names=["doc_id", "expected_grade", "tail_probability"])

    return run


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade (0 to 2), tail_probability P(grade >= 2), kept (that probability reaches least)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    out = source.mapInArrow(_score(held), "doc_id long, expected_grade double, tail_probability double")
    return out.withColumn("kept", F.col("tail_probability") >= least)
