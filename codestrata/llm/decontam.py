"""Benchmark decontamination: stretches of documents within a word edit distance of a benchmark item.

Words are runs of letters and digits (ASCII letters and digits, and all non-ASCII characters) of the lower-cased
text. A document leaks an item of L words when some stretch of it is within k = floor(0.2 L) word edits of the item,
a similarity of 0.8 or more.

1. Segments: an item under twice SEGMENT words is one, a longer one is cut into equal segments of SEGMENT words or more. Of a
   stretch within k edits of the item, some segment is met within its share of the edits, whatever the item's length.
2. CGK: segments and document windows of a segment's size are embedded by the same random walks, which turn edit distance into Hamming distance.
3. Bit sampling: a table for each of REPEATS walks holds the segments by SAMPLES coordinates of their embedding. A window looks up
   its coordinates in all tables; the segments it meets there are the candidates.
4. The exact edit distance of the item to the best stretch around a candidate's place decides.

Windows are only embedded where a leak can be: by the q-gram lemma a segment of n words that is met within e edits shares n - q + 1 - eq word
q-grams with the document on diagonals no further than e apart (q is the largest of 3, 2, 1 that leaves at least one). The gate counts, at each place, the
q-grams that any segment of that size and number of edits has there or thereabouts. It loses nothing, takes time and memory linear in the words whatever the items share, and passes
places and sizes on, not items: what a document leaks is found in the tables alone.

Recall is that of the tables: the tests hold it to 0.99 of planted leaks at the largest distance, for items of 10 to 1000 words
(tests/llm/test_decontam_long.py). A verbatim item agrees in all coordinates, so it is always found.

The benchmark is taken in blocks of at most BLOCK_BYTES of text; each block's index is sent to all executors, and documents
are scanned once per block. Results don't depend on the blocks.

Defined cases: a null text holds no words; an item without words, with a null text or a null item_id is never found; equal items are all
reported; a leak is reported once for an item, at its best stretch (a tie is the first's); rows with a null doc_id are scanned like others;
repeated document rows give a row each, rows that share a doc_id their own leaks; texts of any length are scanned whole, in time linear in
their length and, at places near items, in the number of items met there; an empty table gives no rows, an empty benchmark no leaks; columns other than doc_id and text (item_id and
text) are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import materialize, text_or_empty

SIMILARITY = 0.8
SEGMENT = 24
REPEATS, SAMPLES = 32, 2
BLOCK_BYTES = 16 << 20
_FILTER_BITS = 22
#: Words of documents hashed and gated at a time, windows embedded at a time, meetings in the tables handed on at a time.
_WORDS, _SLICE, _WINDOWS, _PAIRS = 1 << 19, 1 << 15, 1 << 15, 1 << 22
_SPACES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
HITS = "array<struct<item_id:bigint,start:bigint,length:bigint,distance:int,similarity:double>>"
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("distance", pa.int32()), ("similarity", pa.float64())]))


def content_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACES).split()


def edits(n: int, similarity: float) -> int:
    return int(n * (1 - similarity) + 1e-9)


def gram_size(n: int, k: int) -> int:
    return next((q for q in (3, 2) if n >= q and n - q + 1 - k * q >= 1), 1)


def best_stretch(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Smallest edit distance of item to a stretch of region, with the stretch's start and end."""
    m = len(region)
    at = np.arange(m + 1)
    row, start = np.zeros(m + 1, np.int64), at.copy()
    for i, w in enumerate(item, 1):
        sub = row[:-1] + (region != w)
        up = row[1:] + 1
        cost = np.concatenate(([i], np.minimum(sub, up)))
        origin = np.concatenate(([0], np.where(sub <= up, start[:-1], start[1:])))
        # insertions: the cheapest cost to the left plus the distance
        keyed = (cost - at) * (m + 2) + at
        best = np.minimum.accumulate(keyed)
        src = best - (best // (m + 2)) * (m + 2)
        row, start = cost[src] - src + at, origin[src]
    end = int(np.argmin(row))
    return int(row[end]), int(start[end]), end


class Index:
    """The items of a block: their words, their segments, the gate's q-grams and the tables of sampled embeddings."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, repeats: int = REPEATS, samples: int = SAMPLES):
        hashed = [(i, words.hash_words(w)) for i, t in items if (w := content_words(t))]
        self.ids = [i for i, _ in hashed]
        self.words = [h for _, h in hashed]
        self.lengths, self.similarity = np.array([len(h) for h in self.words], np.int64), similarity
        self.k = [edits(len(h), similarity) for h in self.words]
        self.salts = words.random_words(repeats, 17)
        self.draws = (words.random_words(repeats * samples, 19).astype(np.float64) / 2.0**64).reshape(repeats, samples)
        item, start, size, slips = [], [], [], []
        for n, h in enumerate(self.words):
            parts = max(1, len(h) // SEGMENT)
            cuts = [len(h) * x // parts for x in range(parts + 1)]
            item += [n] * parts
            start += cuts[:-1]
            size += [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
            slips += [self.k[n] // parts] * parts
        #: of segments: item, first word in it, words, edits
        self.item, self.start, self.size, self.slips = (np.array(x, np.int64) for x in (item, start, size, slips))
        self._gate()
        self.tables = self._tables()

    def _segment(self, n: int) -> np.ndarray:
        return self.words[self.item[n]][self.start[n] : self.start[n] + self.size[n]]

    def _gate(self) -> None:
        """What the gate looks up: for each gram the kinds of segments (words and edits) that hold it, and its first and last offset in them. A phrase
        that many items share is one entry of a kind."""
        kinds, of = np.unique(np.stack([self.size, self.slips], 1), axis=0, return_inverse=True)
        of = of.ravel()
        self.kinds = [(n, k, gram_size(n, k)) for n, k in kinds.tolist()]
        self.need = np.array([max(1, n - q + 1 - k * q) for n, k, q in self.kinds], np.int64)
        self.grams = []  # per q: filter, sorted grams, first entry of each; of entries: kind, first and last offset
        for q in sorted({q for _, _, q in self.kinds}):
            own = [(of[n], words.grams(self._segment(n), q)) for n in range(len(self.size)) if self.kinds[of[n]][2] == q]
            g = np.concatenate([x for _, x in own])
            kind = np.concatenate([np.full(len(x), n) for n, x in own])
            offset = np.concatenate([np.arange(len(x)) for _, x in own])
            order = np.lexsort((offset, kind, g))
            g, kind, offset = g[order], kind[order], offset[order]
            new = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (kind[1:] != kind[:-1]))))
            last = np.append(new[1:], len(g)) - 1
            unique, first = np.unique(g[new], return_index=True)
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[(unique >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.grams.append((q, seen, unique, np.append(first, len(new)), kind[new], offset[new], offset[last]))

    def sampled(self, x: np.ndarray) -> np.ndarray:
        """For windows of equal length (rows): the sampled coordinates of every walk as one key, shape (rows, repeats)."""
        rows, n = x.shape
        repeats, samples = self.draws.shape
        where = (self.draws * 2 * n).astype(np.int64)
        padded = np.concatenate([x, np.zeros((rows, 1), np.uint64)], 1)
        at = np.zeros((rows, repeats), np.int64)
        out = np.tile(self.salts + np.uint64(n), (rows, 1))
        line = np.arange(rows)[:, None]
        for j in range(int(where.max(initial=0)) + 1):
            c = padded[line, at]
            for r, s in np.argwhere(where == j):
                out[:, r] += words.mix(c[:, r] + np.uint64(s + 1))
            step = words.mix(c + self.salts[None, :] + np.uint64(j * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(63)
            at = np.minimum(at + step.astype(np.int64), n)
        return words.mix(out)

    def _tables(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each length of segments the tables of all walks, as one: sorted keys, and the segment of each."""
        out = {}
        for n in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == n)
            keys = np.concatenate([self.sampled(np.stack([self._segment(m) for m in own[at : at + _WINDOWS]])) for at in range(0, len(own), _WINDOWS)])
            segment = np.repeat(own, keys.shape[1])
            order = np.argsort(keys.ravel(), kind="stable")
            out[n] = keys.ravel()[order], segment[order]
        return out

    def meets(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Which windows (rows, of equal length) meet which segments in a table: numbers of windows and of segments, each pair once, in parts of
        about _PAIRS meetings."""
        keys, segment = self.tables[windows.shape[1]]
        if not len(keys):
            return
        own = self.sampled(windows)
        lo, hi = np.searchsorted(keys, own), np.searchsorted(keys, own, side="right")
        part = np.cumsum((hi - lo).sum(1)) // _PAIRS
        for s, e, _ in _runs(part):
            first, each = lo[s:e].ravel(), (hi - lo)[s:e].ravel()
            window = np.repeat(np.repeat(np.arange(s, e), own.shape[1]), each)
            found = segment[np.repeat(first, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
            pairs = np.unique(window * len(self.size) + found)
            yield pairs // len(self.size), pairs % len(self.size)

    def find(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text its leaks: (item_id, first word, words, distance, similarity)."""
        found: list[list[tuple]] = [[] for _ in texts]
        held: list[bytes] = []
        counts: list[int] = []
        at = 0

        def flush() -> None:
            h = words.hash_words(held)
            for n, hits in self._find(h, np.cumsum([0, *counts])):
                found[at + n] = hits

        for i, t in enumerate(texts):
            w = content_words(t)
            held += w
            counts.append(len(w))
            if len(held) >= _WORDS:
                flush()
                held, counts, at = [], [], i + 1
        flush()
        return found

    def _places(self, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Where segments may be met, by the gate, in slices of the words: document, first word and size of windows, each once in a slice.

        A shared gram stands for the starts of windows from its place less its offset back to the segment's edits before; a start that enough grams
        stand for, and as many after it as the edits allow, are places. Counts are of all segments of a kind, so the work is linear in the words."""
        reach = int((self.size + self.slips).max(initial=0)) + 3
        kinds = len(self.kinds)
        size, slips = (np.array([k[i] for k in self.kinds], np.int64) for i in (0, 1))
        for a in range(0, len(h), _SLICE):
            held = []
            for q, seen, unique, first, kind, least, most in self.grams:
                g = words.grams(h[a : a + _SLICE + reach], q)
                p = np.flatnonzero(seen[(g >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
                n = np.minimum(np.searchsorted(unique, g[p]), len(unique) - 1)
                p, n = p[unique[n] == g[p]] + a, n[unique[n] == g[p]]
                d = np.searchsorted(bounds, p, side="right") - 1
                inside = p + q <= bounds[d + 1]
                p, n, d = p[inside], n[inside], d[inside]
                each = first[n + 1] - first[n]
                entry = np.repeat(first[n], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                at, c = np.repeat(p, each), kind[entry]
                held.append((np.repeat(d, each) * kinds + c, at - most[entry] - slips[c], at - least[entry]))
            group, low, high = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 3
            if not len(group):
                continue
            group, place, step = np.concatenate([group, group]), np.concatenate([low, high + 1]), np.repeat([1, -1], len(low))
            order = np.lexsort((place, group))
            group, place, count = group[order], place[order], np.cumsum(step[order])
            ok = np.flatnonzero((count[:-1] >= self.need[group[:-1] % kinds]) & (group[1:] == group[:-1]) & (place[1:] > place[:-1]))
            c = group[ok] % kinds
            # starts of this slice; those before the first word belong to the first
            begin, end = np.maximum(place[ok], a if a else -reach), np.minimum(place[ok + 1], a + _SLICE)
            each = np.where(end > begin, end - begin + slips[c], 0)
            starts = np.repeat(begin, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            rows = np.unique(np.stack([np.repeat(size[c], each), np.repeat(group[ok] // kinds, each), starts], 1), axis=0)
            if len(rows):
                yield rows[:, 1], rows[:, 2], rows[:, 0]

    def _candidates(self, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows of document, item and place of its first word, by the tables."""
        rows = [np.zeros((0, 3), np.int64)]
        for d, g, size in self._places(h, bounds):
            for s, e, n in _runs(size):
                for at in range(s, e, _WINDOWS):
                    own = slice(at, min(e, at + _WINDOWS))
                    cols = g[own, None] + np.arange(n)[None]
                    lo, hi = bounds[d[own]][:, None], bounds[d[own] + 1][:, None]
                    windows = np.where((cols >= lo) & (cols < hi), h[np.clip(cols, 0, len(h) - 1)], np.uint64(0))
                    # equal windows are embedded once
                    key = words.mix((windows * (words.random_words(n, 23) | np.uint64(1))).sum(1))
                    _, one, of = np.unique(key, return_index=True, return_inverse=True)
                    by = np.argsort(of, kind="stable")
                    start = np.searchsorted(of[by], np.arange(len(one) + 1))
                    for window, segment in self.meets(windows[one]):
                        each = (start[1:] - start[:-1])[window]
                        places = by[np.repeat(start[window], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
                        segment = np.repeat(segment, each)
                        rows.append(np.unique(np.stack([d[own][places], self.item[segment], g[own][places] - self.start[segment]], 1), axis=0))
        return np.unique(np.concatenate(rows), axis=0)

    def _worded(self, rows: np.ndarray, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The candidates without those that lack more of their item's words around their place than edits could take away. Of items of one segment; others stay."""
        keep = np.ones(len(rows), bool)
        length = self.lengths[rows[:, 1]] if len(rows) else np.zeros(0, np.int64)
        for n in np.unique(length[length < 2 * SEGMENT]).tolist():
            own, k = np.flatnonzero(length == n), edits(n, self.similarity)
            for at in range(0, len(own), _SLICE // n + 1):
                some = own[at : at + _SLICE // n + 1]
                d, item, place = rows[some].T
                cols = place[:, None] + np.arange(-k, n + k)[None]
                inside = (cols >= bounds[d][:, None]) & (cols < bounds[d + 1][:, None])
                near = np.where(inside, h[np.clip(cols, 0, len(h) - 1)], np.uint64(0))
                own_words = np.stack([self.words[i] for i in item.tolist()])
                keep[some] = (own_words[:, :, None] == near[:, None, :]).any(2).sum(1) >= n - k
        return rows[keep]

    def _find(self, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, list[tuple]]]:
        out: dict[int, list[tuple]] = {}
        rows = self._worded(self._candidates(h, bounds), h, bounds)
        new = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(1)))) if len(rows) else np.zeros(0, np.int64)
        for s, e in zip(new.tolist(), [*new[1:].tolist(), len(rows)], strict=False):
            doc, item = rows[s, :2].tolist()
            lo, hi, n, k = int(bounds[doc]), int(bounds[doc + 1]), len(self.words[item]), self.k[item]
            at, best = rows[s:e, 2], None
            for near in np.split(at, np.flatnonzero(np.diff(at) > n + 2 * k) + 1):  # those that overlap at once
                a, b = max(lo, int(near[0]) - k), min(hi, int(near[-1]) + n + k)
                dist, x, y = best_stretch(self.words[item], h[a:b]) if b > a else (k + 1, 0, 0)
                if dist <= k and (best is None or dist < best[0]):
                    best = (dist, a + x, a + y)
            if best:
                dist, a, b = best
                out.setdefault(doc, []).append((self.ids[item], a - lo, b - a, dist, 1 - dist / n))
        yield from out.items()


def _runs(key: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Start, end and value of the runs of a sorted array."""
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))).tolist() if len(key) else []
    for s, e in zip(at, [*at[1:], len(key)] if at else [], strict=True):
        yield s, e, int(key[s])


def _scan(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for rb in batches:
            for at in range(0, rb.num_rows, 1024):
                part = rb.slice(at, 1024)
                hits = index.find(part.column(1).to_pylist())
                rows = [[dict(zip(("item_id", "start", "length", "distance", "similarity"), x, strict=True)) for x in sorted(own, key=lambda x: x[0])] for own in hits]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, _HIT)], names=["doc_id", "hits"])

    return run


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about block_bytes, dealt by a hash of item_id."""
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for n in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n) if blocks > 1 else items
        yield [(r.item_id, r.text) for r in block.orderBy("item_id").collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, hits (array of item_id, start, length, distance, similarity; words from 0)."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")

    def scan(block: list[tuple[int, str]]) -> DataFrame:
        held = spark.sparkContext.broadcast(Index(block, similarity))
        return source.mapInArrow(_scan(held), f"doc_id long, hits {HITS}")

    blocks = _blocks(items, block_bytes)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return scan(first)
    # rows are told apart by doc_id and text: equal rows have equal leaks
    tagged = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.sha2("text", 256).alias("_tag")]
    rows = source.select("doc_id", *tagged)
    found = None
    for block in chain([first, second], blocks):
        held = spark.sparkContext.broadcast(Index(block, similarity))
        part = source.select(F.struct(*tagged).alias("_row"), "text").mapInArrow(_scan(held), f"doc_id struct<_id:string,_tag:string>, hits {HITS}")
        part = materialize(part.where("size(hits) > 0").select("doc_id.*", F.explode("hits").alias("hit")).distinct(), "leaks")
        found = part if found is None else found.unionByName(part)
    grouped = found.groupBy("_id", "_tag").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    return rows.join(grouped, ["_id", "_tag"], "left").select("doc_id", F.coalesce("hits", F.expr(f"cast(array() AS {HITS})")).alias("hits"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, n_items, item_ids (sorted), best_similarity (0 without a leak), contaminated."""
    hits = leaks(docs, benchmark, similarity)
    return hits.select(
        "doc_id",
        F.size("hits").cast("long").alias("n_items"),
        F.expr("transform(hits, h -> h.item_id)").alias("item_ids"),
        F.coalesce(F.array_max(F.expr("transform(hits, h -> h.similarity)")), F.lit(0.0)).alias("best_similarity"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def _free(held):
    @F.pandas_udf("boolean")
    def free(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([not x for x in held.value.find(texts.tolist())], dtype=bool)

    return free


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    for block in _blocks(items, BLOCK_BYTES):
        held = spark.sparkContext.broadcast(Index(block, similarity))
        docs = docs.where(_free(held)(text_or_empty()))
    return docs
