"""Near-duplicate documents by SetSketch registers.

Each distinct shingle set gets m registers: the floor of the base-b logarithm of minima of exponentially
distributed values, truncated to 16 bits (b = 1.001, rate a = 20). Registers merge by maximum and their
equality is locality-sensitive, so four at a time they are banded. Documents with equal sets are one class.
A bucket links each of its classes to its least one (a star, not all pairs); candidates are screened by the
joint maximum-likelihood estimate of the Jaccard similarity from the registers, confirmed on full sets, and
joined into components. Classes that share buckets, directly or over others, form a cluster. Clusters that still span
several components are compared across components in pairs of bounded blocks, by the same estimate and exact set
sizes; only links that join components leave a block. So no link between different texts is lost to the star, and no
pairs are emitted.

With 20 bands of four registers a pair at the threshold 0.85 is missed with probability 4e-7, one at 0.8 (the pipeline's) with 3e-5.

Defined cases: a null or word-free text has an empty set and is linked with nothing; a text of fewer than five
words has one shingle; a null doc_id is its own class, with a null component, and is kept; repeated rows give
a row each, and rows that share a doc_id but not the text are classes of their own, each with its links; texts of any length are taken
whole; a similarity right at the threshold is a link; of a component's documents that share its smallest doc_id all are kept; an empty
table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import materialize, release, text_or_empty
from .components import components

BANDS, ROWS = 20, 4
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Screened out only when the estimate is this far below the threshold: five standard errors of 80 registers.
MARGIN = 0.2
#: Documents, and bytes of text, of a block of a cluster; two blocks at a time are compared.
BLOCK_ROWS, BLOCK_BYTES = 2048, 8 << 20


def registers(s: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """SetSketch registers of a non-empty set of hashes."""
    keys = words.random_words(2 * m, 11).reshape(2, m, 1)
    flip, odd = keys[0], keys[1] | np.uint64(1)
    least = np.full(m, np.iinfo(np.uint64).max)
    for at in range(0, len(s), 2048):
        y = s[None, at : at + 2048] ^ flip
        y *= odd
        np.minimum(least, y.min(axis=1), out=least)
    u = (least.astype(np.float64) + 1) / 2.0**64
    x = np.maximum(-np.log1p(-np.minimum(u, 1 - 1e-16)), 1e-300) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype("<u2")


def likely_jaccard(ru: np.ndarray, rv: np.ndarray, nu: np.ndarray, nv: np.ndarray, steps: int = 30) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from register pairs (rows) and the set sizes, by golden section."""
    above, below = (ru > rv).sum(1), (ru < rv).sum(1)
    equal = ru.shape[1] - above - below
    u, v = nu / (nu + nv), nv / (nu + nv)

    def p(x: np.ndarray) -> np.ndarray:
        return np.maximum(-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE), 1e-12)

    def fit(j: np.ndarray) -> np.ndarray:
        a, b = p(u - v * j), p(v - u * j)
        return above * np.log(a) + below * np.log(b) + equal * np.log(np.maximum(1 - a - b, 1e-12))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    g = (5**0.5 - 1) / 2
    for _ in range(steps):
        x, y = hi - g * (hi - lo), lo + g * (hi - lo)
        up = fit(x) < fit(y)
        lo, hi = np.where(up, x, lo), np.where(up, hi, y)
    return (lo + hi) / 2


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        for at in range(0, rb.num_rows, 512):
            part = rb.slice(at, 512)
            n, key, sig = [], [], []
            for h in words.each_hashed(part.column(1).to_pylist()):
                s = words.shingle_set(h)
                n.append(len(s))
                key.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "tag", "n_shingles", "set_key", "sig"])
    release()


def features(docs: DataFrame) -> DataFrame:
    """doc_id, tag (a hash of the text), n_shingles, set_key (equal for equal sets, null for the empty one), sig (registers)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("tag"))
    return source.mapInArrow(_features, "doc_id long, tag long, n_shingles long, set_key binary, sig binary")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = words.random_words(BANDS, 13)
    for rb in batches:
        sig = np.frombuffer(b"".join(rb.column(1).to_pylist()), "<u2").reshape(rb.num_rows, BANDS, ROWS)
        key = words.mix(np.ascontiguousarray(sig).view("<u8").reshape(rb.num_rows, BANDS) ^ salt)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(np.repeat(rb.column(0).to_numpy(), BANDS))], names=["bucket", "id"])


def _screen(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if not rb.num_rows:
                continue
            ru, rv = (np.frombuffer(b"".join(rb.column(c).to_pylist()), "<u2").reshape(rb.num_rows, -1) for c in ("sig_a", "sig_b"))
            nu, nv = (rb.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            keep = (np.minimum(nu, nv) >= threshold * np.maximum(nu, nv)) & (likely_jaccard(ru, rv, nu, nv) >= threshold - MARGIN)
            yield rb.select(["a", "b"]).filter(pa.array(keep))

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict = OrderedDict()

        def full(i: int, text: str) -> np.ndarray:
            if i in held:
                held.move_to_end(i)
                return held[i]
            s = words.shingle_set(words.hash_words(words.lower_words(text)))
            if len(s) < 1 << 20:
                held[i] = s
                if len(held) > 256:
                    held.popitem(last=False)
            return s

        for rb in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            a, b, ta, tb = (rb.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
            keep = []
            for i, j, x, y in zip(a, b, ta, tb, strict=True):
                s, t = full(i, x), full(j, y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield rb.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        held.clear()
        release()

    return run


def _compare(percent: int):
    """Links between the components of a group of documents: those that join components, found by exact set sizes."""

    def run(table: pa.Table) -> pa.Table:
        first, last = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        ids, block = table.column("id").to_numpy(), table.column("block").to_numpy()
        _, root = np.unique(table.column("component").to_numpy(), return_inverse=True)
        sets = [words.shingle_set(h) for h in words.each_hashed(table.column("text").to_pylist())]
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(len(ids), -1)
        n = np.array([len(s) for s in sets], float)
        every, times = np.unique(np.concatenate(sets), return_counts=True)
        every = every[times > 1]  # a shingle of one document is in no intersection
        width = len(every) // 64 + 1
        dense = len(ids) * width <= 4 << 20
        if dense:
            bits = np.zeros((len(ids), width * 64), bool) if len(ids) * width <= 1 << 17 else None
            packed = np.zeros((len(ids), width), np.uint64)
            for i, s in enumerate(sets):
                at = np.searchsorted(every, s)
                at = at[(at < len(every)) & (every[np.minimum(at, len(every) - 1)] == s)] if len(every) else at[:0]
                row = np.zeros(width * 64, bool) if bits is None else bits[i]
                row[at] = True
                packed[i] = np.packbits(row).view(np.uint64)
        found = []
        for i in range(len(ids)):
            j = np.arange(i + 1, len(ids))
            if first != last:
                j = j[block[j] != block[i]]
            j = j[(root[j] != root[i]) & (np.minimum(n[j], n[i]) * 100 >= percent * np.maximum(n[j], n[i]))]
            if not len(j):
                continue
            j = j[(sig[j] == sig[i]).sum(1) >= sig.shape[1] * (percent / 100 - 2 * MARGIN)]
            if len(j):
                j = j[likely_jaccard(np.broadcast_to(sig[i], sig[j].shape), sig[j], np.full(len(j), n[i]), n[j], 12) >= percent / 100 - MARGIN]
            if dense:
                both = np.bitwise_count(packed[j] & packed[i]).sum(1) if len(j) else n[j]
            else:
                both = np.array([len(np.intersect1d(sets[i], sets[k], assume_unique=True)) for k in j], float)
            for k in j[100 * both >= percent * (n[i] + n[j] - both)]:
                if root[k] != root[i]:
                    root[root == root[k]] = root[i]
                    found.append(sorted((int(ids[i]), int(ids[k]))))
        packed = bits = sets = every = times = None
        release()
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document; linked where 100 * intersection >= percent * union."""
    return tagged(docs, percent).drop("tag")


def least_of_each(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The documents kept, with all their columns. Rows are told apart by doc_id and text."""
    gone = tagged(docs, percent).where("NOT kept").select(F.col("doc_id").alias("_gone"), F.col("tag").alias("_gone_tag")).distinct()
    return docs.join(gone, (docs["doc_id"].cast("long") == gone["_gone"]) & (F.xxhash64(text_or_empty(docs["text"])) == gone["_gone_tag"]), "left_anti")


def tagged(docs: DataFrame, percent: int) -> DataFrame:
    """The same with tag, a hash of the text: rows that share a doc_id but not the text have results of their own."""
    feats = materialize(features(docs), "features")
    named = feats.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = named.groupBy("set_key").agg(F.min(F.struct("doc_id", "tag")).alias("row"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    # a class has a number of its own, fixed once written: a doc_id may stand for several
    reps = materialize(classes.select("set_key", F.monotonically_increasing_id().alias("id"), "row.doc_id", "row.tag", "sig", "n_shingles"), "reps")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("tag"), text_or_empty().alias("text")).where("doc_id IS NOT NULL")
    bands = reps.select("id", "sig").mapInArrow(_bands, "bucket long, id long")
    hubs = bands.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    star = materialize(bands.join(hubs, "bucket").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "star")
    # all that share a bucket, directly or over others, are one cluster; links lie within clusters
    cluster = components(star).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    clustered = reps.select("id", "doc_id", "tag", "sig", "n_shingles").join(cluster, "id")
    # neither side of this join has a size bound: it is a merge join at every size
    own = materialize(texts.hint("merge").join(clustered, ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag"]), "texts")
    side = lambda c: own.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n_shingles").alias(f"n_{c}"))
    likely = materialize(star.join(side("a"), "a").join(side("b"), "b").mapInArrow(_screen(percent / 100), "a long, b long"), "likely")
    whole = lambda c: own.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
    links = materialize(likely.join(whole("b"), "b").join(whole("a"), "a").mapInArrow(_confirm(percent), "a long, b long"), "links")
    label = components(links)
    # clusters that span several components: compare across these, in pairs of bounded blocks
    marked = own.select("id", "cluster", F.octet_length("text").alias("size")).join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    spans = marked.groupBy("cluster").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n"), F.sum("size").alias("bytes")).where("least <> most")
    spans = spans.select("cluster", F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    placed = marked.drop("size").join(spans, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    dealt = own.select("id", "sig", "text").join(placed, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "id", "component", "block", "sig", "text")
    more = materialize(dealt.groupBy("cluster", "lo", "hi").applyInArrow(_compare(percent), "a long, b long"), "links")
    if more.limit(1).count():
        label = components(links.unionByName(more))
    label = label.withColumnRenamed("node", "id")
    least = label.join(reps.select("id", "doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("least"))
    linked = label.join(least, "component").select("id", "least")
    class_of = reps.select("set_key", "id", "doc_id").join(linked, "id", "left").select("set_key", F.coalesce("least", "doc_id").alias("component_id"))
    out = feats.select("doc_id", "tag", "n_shingles", "set_key").join(class_of, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "tag", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
