"""Removal of repeated substrings by a sparse suffix order, built with a common-prefix-aware distributed merge sort.

Every 50-byte string holds one anchor, the least hashed 24-byte string in it, whatever stands around it; so equal 50-byte
strings have equal anchors, and only suffixes at anchors (about one in 14 bytes) need sorting.

1. Each bucket of documents counts its anchors, and the different surroundings of each. Hashes of anchors are dealt to buckets; those of
   one row alone drop out, the rest go back to the buckets of documents that hold them.
2. Each bucket of documents sorts its remaining suffixes with their left context. Of suffixes with equal contexts only those of the
   smallest doc_id go on (the others are thereby known to be repeated, which also bounds hot passages to a few rows a bucket), and
   a row's equal ones go on as one, with its places. Sorted runs are front-coded (length of the prefix shared with the one before, and the
   rest) and exchanged.
3. A loser tree combines the runs of a bucket, which it decodes as it goes. It knows how long a prefix each run's head shares with the last
   suffix put out: heads that differ in this are ordered by it alone, heads that agree are compared from there on.
4. Suffixes that share an anchor stand together. A window of 50 bytes that also starts in a smaller doc_id's suffix is marked, and each
   document drops its marked bytes.

An anchor with more than HOT different surroundings (a short phrase that stands everywhere) makes no group: each of its windows is a suffix
of its own, dealt by the hash of its 50 bytes. Equal ones come out of the tree by doc_id, so that none but the first of them is held.

Everything moves as packed blobs. The texts are shuffled once; all three uses share the exchange. Decisions are exact: bytes are
compared, hashes only choose what to compare.

Defined cases: a null text is empty; rows with a null doc_id neither lose bytes nor make others lose any; rows that share a doc_id never
affect each other, and each gets a row; equal rows get equal results; texts under 50 bytes lose nothing; a text of any length is read in
overlapping pieces and held whole by one task only while it is cut; an empty table gives no rows; columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import release, text_or_empty

NEED, ANCHOR = 50, 24
WINDOW = NEED - ANCHOR + 1
LEFT = NEED - ANCHOR
#: Bytes of text a bucket of documents holds, and bytes of text whose anchors a bucket of hashes holds.
DOC_BYTES, HASH_BYTES = 8 << 20, 16 << 20
#: Different surroundings of an anchor (by bucket of documents, summed) from which its windows are dealt one by one.
HOT = 4096
#: Suffixes that a bucket of documents sorts at a time, and that a run decodes at a time.
_SORTED, _DECODED = 400_000, 1024
_PIECE = 1 << 18
_BLOCK = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)


def pack(x: np.ndarray, sorted_: bool = False) -> bytes:
    """Integers as compressed byte planes; sorted ones as differences."""
    x = x.astype(np.int64)
    if sorted_:
        x = np.diff(x, prepend=0)
    return zstandard.compress(x.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(b: bytes, sorted_: bool = False) -> np.ndarray:
    x = np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1).T).view(np.int64).ravel()
    return np.cumsum(x) if sorted_ else x


def _blocks(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts in pieces (number, offset, bytes) of bounded size, that overlap so that every window is whole in one."""
    held, size = [], 0
    for n, t in enumerate(texts):
        for at in range(0, max(0, len(t) - NEED + 1), _PIECE):
            piece = t[at : at + _PIECE + NEED - 1]
            held.append((n, at, piece))
            size += len(piece)
            if size >= _BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


class Anchors:
    """Of joined pieces: the bytes a, and for each anchor its place p, its first and last window, its piece and its hash q."""

    def __init__(self, block: list[tuple[int, int, bytes]]):
        self.a = a = np.frombuffer(b"".join(p for _, _, p in block), np.uint8)
        up, self._down, table = words._powers(len(a) + 1)
        self._total = total = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(table[a] * up[: len(a)], out=total[1:])
        starts = np.arange(len(a) - ANCHOR + 1)
        h = self.hashes(starts, starts + ANCHOR)
        m = (h & ~_PLACE) | starts.astype(np.uint64)
        for step in (1, 2, 4, 8):
            m = np.minimum(m[:-step], m[step:])
        m = np.minimum(m[: -(WINDOW - 16)], m[WINDOW - 16 :])  # the least of 27
        place = (m & _PLACE).astype(np.int64)
        sizes = np.array([len(p) for _, _, p in block])
        piece = np.repeat(np.arange(len(block)), sizes)[: len(place)]
        ok = np.flatnonzero(np.arange(len(place)) + NEED <= np.cumsum(sizes)[piece])
        p, s = place[ok], piece[ok]
        new = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (s[1:] != s[:-1]))))
        last = np.append(new[1:], len(ok)) - 1
        self.p, self.first, self.last, self.piece = p[new], ok[new], ok[last], s[new]
        self.q = words.mix(h[self.p] ^ np.uint64(0x5851F42D4C957F2D))
        offsets = np.cumsum([0, *sizes[:-1]])
        self.row = np.array([n for n, _, _ in block])[self.piece]
        #: what turns a place in the block into one in the row's text
        self.shift = (np.array([at for _, at, _ in block]) - offsets)[self.piece]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return words.mix((self._total[end] - self._total[start]) * self._down[start])


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin in sorted arrays."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _runs(key: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Start, end and value of the runs of a sorted array."""
    at = _starts(key).tolist()
    for s, e in zip(at, [*at[1:], len(key)] if at else [], strict=True):
        yield s, e, int(key[s])


def _rows(t: pa.Table) -> tuple[list, list[bytes]]:
    """The rows of a bucket of documents, by id and text: ids and texts. Rows without an id come last."""
    ids, texts = t.column("doc_id").to_pylist(), [(x or "").encode("utf-8", "surrogatepass") for x in t.column("text").to_pylist()]
    order = sorted((i for i in range(len(ids)) if ids[i] is not None), key=lambda i: (ids[i], texts[i])) + [i for i in range(len(ids)) if ids[i] is None]
    return [ids[i] for i in order], [texts[i] for i in order]


def _compared(ids: list, texts: list[bytes]) -> list[bytes]:
    return [t for i, t in zip(ids, texts, strict=True) if i is not None]


_HASHES = pa.schema([("hash_bucket", pa.int64()), ("bucket", pa.int64()), ("hashes", pa.binary()), ("times", pa.binary()), ("several", pa.binary())])


def _scan(hash_buckets: int):
    """Of a bucket of documents: its anchors' hashes, the different surroundings of each, and whether several rows hold it."""

    def run(t: pa.Table) -> pa.Table:
        bucket, held = t.column("bucket")[0].as_py(), []
        for block in _blocks(_compared(*_rows(t))):
            x = Anchors(block)
            held.append((x.q, x.hashes(x.first, x.last + NEED) + (x.p - x.first).astype(np.uint64), x.row))
        rows = []
        if held:
            q, body, row = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((body, q))
            q, body, row = q[order], body[order], row[order]
            at = _starts(q)
            differ = np.zeros(len(q), np.int64)
            differ[_starts(q, body)] = 1
            times, several = np.add.reduceat(differ, at), np.minimum.reduceat(row, at) != np.maximum.reduceat(row, at)
            q = q[at]
            h, to = (q >> np.uint64(24)).astype(np.int64), (q % np.uint64(hash_buckets)).astype(np.int64)
            order = np.lexsort((h, to))
            h, to, times, several = h[order], to[order], times[order], several[order]
            rows = [{"hash_bucket": b, "bucket": bucket, "hashes": pack(h[s:e], True), "times": pack(times[s:e]), "several": pack(several[s:e])} for s, e, b in _runs(to)]
        held = q = body = row = order = differ = None
        release()
        return pa.Table.from_pylist(rows, schema=_HASHES)

    return run


_REPEATED = pa.schema([("bucket", pa.int64()), ("hash_bucket", pa.int64()), ("hashes", pa.binary()), ("hot", pa.binary())])


def _repeated(t: pa.Table) -> pa.Table:
    """Of a bucket of hashes, those of several rows, for each bucket of documents that holds them, and which of them are hot."""
    h, times, several = (np.concatenate([unpack(x, c == "hashes") for x in t.column(c).to_pylist()]) for c in ("hashes", "times", "several"))
    whole = t.column("hash_bucket")[0].as_py()
    source = np.repeat(t.column("bucket").to_numpy(), [len(unpack(x)) for x in t.column("several").to_pylist()])
    order = np.argsort(h, kind="stable")
    h, times, several, source = h[order], times[order], several[order], source[order]
    at = _starts(h)
    size = np.diff(np.append(at, len(h)))
    keep = np.repeat((size > 1) | (np.maximum.reduceat(several, at) > 0), size)
    hot = np.repeat(np.add.reduceat(times, at) > HOT, size)
    h, hot, source = h[keep], hot[keep], source[keep]
    order = np.lexsort((h, source))
    h, hot, source = h[order], hot[order], source[order]
    rows = [{"bucket": b, "hash_bucket": whole, "hashes": pack(h[s:e], True), "hot": pack(hot[s:e])} for s, e, b in _runs(source)]
    h = times = several = source = order = keep = hot = None
    release()
    return pa.Table.from_pylist(rows, schema=_REPEATED)


_RUN = pa.schema([("direct", pa.bool_()), ("bucket", pa.int64()), ("source", pa.int64()), *((c, pa.binary()) for c in ("docs", "rows", "times", "places", "shape", "rest", "left"))])
_RUN_DDL = "direct boolean, bucket long, source long, docs binary, rows binary, times binary, places binary, shape binary, rest binary, left binary"


def united(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of rows, those that meet as one: rows, starts, ends in order."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return row, start, end
    reach = np.maximum.accumulate((row << 40) + end)
    new = np.flatnonzero(np.concatenate(([True], (row[1:] << 40) + start[1:] > reach[:-1])))
    return row[new], start[new], reach[np.append(new[1:], len(row)) - 1] - (row[new] << 40)


def _windows(x: Anchors, hit: np.ndarray, hash_buckets: int) -> tuple[np.ndarray, ...]:
    """Each window of the anchors hit as a suffix of its own: body, row, place, bucket."""
    each = x.last[hit] - x.first[hit] + 1
    of = np.repeat(hit, each)
    w = np.repeat(x.first[hit], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    body = np.zeros((len(w), NEED + 1 + LEFT + 1), np.uint8)
    body[:, :NEED] = x.a[w[:, None] + np.arange(NEED)]
    body[:, NEED] = NEED
    bucket = hash_buckets + (x.hashes(w, w + NEED) % np.uint64(hash_buckets)).astype(np.int64)
    return body, x.row[of], w + x.shift[of], bucket


def _suffixes(x: Anchors, hit: np.ndarray, hash_buckets: int) -> tuple[np.ndarray, ...]:
    """The suffixes at the anchors hit, with their left context reversed: body, row, place, bucket."""
    p, first, last = x.p[hit], x.first[hit], x.last[hit]
    cols = np.arange(NEED)
    right = np.where(cols < (last + NEED - p)[:, None], x.a[np.minimum(p[:, None] + cols, len(x.a) - 1)], 0).astype(np.uint8)
    cols = np.arange(LEFT)
    left = np.where(cols < (p - first)[:, None], x.a[np.maximum(p[:, None] - 1 - cols, 0)], 0).astype(np.uint8)
    size, hi = (NEED + last - p).astype(np.uint8), (p - first).astype(np.uint8)
    return np.concatenate([right, size[:, None], left, hi[:, None]], 1), x.row[hit], p + x.shift[hit], (x.q[hit] % np.uint64(hash_buckets)).astype(np.int64)


def _sorted_runs(source: int, ids: np.ndarray, parts: list[tuple[np.ndarray, ...]]) -> Iterator[tuple]:
    body, row, p, bucket = (np.concatenate(x) for x in zip(*parts, strict=True))
    # by bucket, then lexicographically (padded; a tie is the shorter's), then by document
    order = np.lexsort((p, row))
    order = order[np.argsort(np.ascontiguousarray(body[order]).view(f"S{body.shape[1]}").ravel(), kind="stable")]
    order = order[np.argsort(bucket[order], kind="stable")]
    body, row, p, bucket = body[order], row[order], p[order], bucket[order]
    new = np.zeros(len(row), bool)
    new[0] = True
    new[1:] = (bucket[1:] != bucket[:-1]) | (body[1:] != body[:-1]).any(1)
    doc = ids[row]
    leader = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    lo, hi = NEED - body[:, NEED].astype(np.int64), body[:, -1].astype(np.int64)
    gone = doc > leader
    if gone.any():
        spans = united(row[gone], (p - hi)[gone], (p - lo)[gone] + NEED)
        yield (True, source, source, b"", *map(pack, spans[:1]), b"", *map(pack, spans[1:]), b"", b"")
    kept = np.flatnonzero(~gone)
    group = (np.cumsum(new) - 1)[kept]
    record = _starts(group, row[kept])
    times = np.diff(np.append(record, len(kept)))
    for s, e, b in _runs(bucket[kept[record]]):
        k = kept[record[s:e]]
        right = body[k, :NEED]
        same = right[1:] == right[:-1]
        shared = np.concatenate(([0], np.where(same.all(1), NEED, same.argmin(1))))
        size = NEED - lo[k]
        shared = np.minimum(shared, np.minimum(size, np.concatenate(([0], size[:-1]))))  # padding isn't text
        cols = np.arange(NEED)
        rest = right[(cols >= shared[:, None]) & (cols < size[:, None])]
        left = body[k, NEED + 1 : NEED + 1 + LEFT][np.arange(LEFT) < hi[k, None]]
        places = p[kept[record[s] : record[e] if e < len(record) else len(kept)]]
        yield False, b, source, pack(doc[k]), pack(row[k]), pack(times[s:e]), pack(places), pack(shared << 10 | lo[k] << 5 | hi[k]), zstandard.compress(rest.tobytes(), 1), zstandard.compress(left.tobytes(), 1)


def _suffix_runs(hash_buckets: int):
    def run(key: tuple, texts: pa.Table, repeated: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if repeated.num_rows and texts.num_rows:
            known = np.concatenate([unpack(h, True) * hash_buckets + b for h, b in zip(repeated.column("hashes").to_pylist(), repeated.column("hash_bucket").to_pylist(), strict=True)])
            hot = np.concatenate([unpack(x) for x in repeated.column("hot").to_pylist()]) > 0
            order = np.argsort(known)
            known, hot = known[order], hot[order]
            ids, raw = _rows(texts)
            raw = _compared(ids, raw)
            id_of, parts = np.array(ids[: len(raw)], np.int64), []
            for block in _blocks(raw):
                x = Anchors(block)
                h = (x.q >> np.uint64(24)).astype(np.int64) * hash_buckets + (x.q % np.uint64(hash_buckets)).astype(np.int64)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                for made, own in ((_suffixes, hit & ~hot[at]), (_windows, hit & hot[at])):
                    if own.any():
                        parts.append(made(x, np.flatnonzero(own), hash_buckets))
                if sum(len(y[1]) for y in parts) >= _SORTED:
                    out += _sorted_runs(key[0], id_of, parts)
                    parts = []
            if parts:
                out += _sorted_runs(key[0], id_of, parts)
            known = hot = order = parts = raw = texts = None
        release()
        return pa.Table.from_pylist([dict(zip(_RUN.names, r, strict=True)) for r in out], schema=_RUN)

    return run


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """The length of the common prefix, known to be at least at."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    x = int.from_bytes(a[at:n], "big") ^ int.from_bytes(b[at:n], "big")
    return n - (x.bit_length() + 7) // 8


#: A suffix: its bytes, the prefix it shares with the one before in its run, doc_id, number of the run and in it, windows (least and
#: greatest number of bytes before the anchor), reversed bytes before it.
Suffix = tuple[bytes, int, int, int, int, int, int, bytes]


def decode(n: int, docs: np.ndarray, shape: np.ndarray, rest: bytes, left: bytes) -> Iterator[Suffix]:
    """The suffixes of the front-coded run n, in order."""
    prev, x, y, i = b"", 0, 0, 0
    for at in range(0, len(docs), _DECODED):
        for d, m in zip(docs[at : at + _DECODED].tolist(), shape[at : at + _DECODED].tolist(), strict=True):
            s, lo, hi = m >> 10, m >> 5 & 31, m & 31
            more = NEED - lo - s
            prev = prev[:s] + rest[x : x + more]
            yield prev, s, d, n, i, lo, hi, left[y : y + hi]
            x += more
            y += hi
            i += 1


def merge(runs: list[Iterator[Suffix]]) -> Iterator[tuple[Suffix, int]]:
    """All suffixes in order (equal ones by doc_id), each with the prefix it shares with the one put out before, by a loser tree."""
    k = 1
    while k < len(runs):
        k *= 2
    runs = [*runs, *(iter(()) for _ in range(k - len(runs)))]
    head = [next(r, None) for r in runs]
    known = [0] * k  # the prefix that a run's head shares with the last one put out
    tree = [0] * (2 * k)

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser learns the prefix it shares with the winner."""
        x, y = head[a], head[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        n = known[a]
        if n != known[b]:
            return (a, b) if n > known[b] else (b, a)
        u, v = x[0], y[0]
        n = common(u, v, n)
        if n == len(u):
            ahead = n < len(v) or x[2] <= y[2]
        else:
            ahead = n < len(v) and u[n] < v[n]
        if ahead:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    best = list(range(k))
    level = k
    while level > 1:
        level //= 2
        games = [play(best[2 * i], best[2 * i + 1]) for i in range(level)]
        for i, (_, loser) in enumerate(games):
            tree[level + i] = loser
        best = [w for w, _ in games]
    win = best[0]
    while (item := head[win]) is not None:
        yield item, known[win]
        head[win] = nxt = next(runs[win], None)
        if nxt is not None:
            known[win] = nxt[1]
        node = (k + win) // 2
        while node:
            win, tree[node] = play(win, tree[node])
            node //= 2


def repeats(group: list[Suffix]) -> Iterator[tuple[int, int, int, int]]:
    """Of suffixes with one anchor: (run, number, greatest, least bytes before the anchor) of windows that a smaller doc_id has too."""
    least = min(group, key=lambda x: x[2])
    first: dict = {}
    for right, _, doc, n, i, lo, hi, left in group:
        if doc == least[2]:
            continue
        if NEED - common(right, least[0]) <= lo and common(left, least[7]) >= hi:
            yield n, i, hi, lo
            continue
        if not first:  # the smallest document of each window of the group
            for x in group:
                for o in range(x[5], x[6] + 1):
                    w = (o, x[7][:o], x[0][: NEED - o])
                    if first.get(w, x[2]) >= x[2]:
                        first[w] = x[2]
        from_ = None
        for o in range(lo, hi + 2):
            if o <= hi and first[o, left[:o], right[: NEED - o]] < doc:
                from_ = o if from_ is None else from_
            elif from_ is not None:
                yield n, i, o - 1, from_
                from_ = None


def _marked(merged: Iterable[tuple[Suffix, int]]) -> Iterator[tuple[int, int, int, int]]:
    group: list[Suffix] = []
    for x, shared in merged:
        if shared < ANCHOR:
            if len(group) > 1:
                yield from repeats(group)
            group = []
        group.append(x)
    if len(group) > 1:
        yield from repeats(group)


def _marked_whole(merged: Iterable[tuple[Suffix, int]]) -> Iterator[tuple[int, int, int, int]]:
    """Of single windows: all that equal one of a smaller doc_id, which came out before them."""
    least = 0
    for x, shared in merged:
        if shared < NEED:
            least = x[2]
        elif x[2] > least:
            yield x[3], x[4], 0, 0


_SPANS = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in ("rows", "starts", "ends"))])


def _merged(hash_buckets: int):
    def run(t: pa.Table) -> pa.Table:
        if t.column("direct")[0].as_py():
            return pa.table([t.column(c) for c in ("bucket", "rows", "places", "shape")], schema=_SPANS)
        whole = t.column("bucket")[0].as_py() >= hash_buckets
        source = t.column("source").to_numpy()
        docs, shape = ([unpack(x) for x in t.column(c).to_pylist()] for c in ("docs", "shape"))
        rest, left = ([zstandard.decompress(x) for x in t.column(c).to_pylist()] for c in ("rest", "left"))
        merged = merge([decode(n, *x) for n, x in enumerate(zip(docs, shape, rest, left, strict=True))])
        found = array("q")
        for x in _marked_whole(merged) if whole else _marked(merged):
            found.extend(x)
        docs = shape = rest = left = merged = None
        out = []
        e = np.frombuffer(found, np.int64).reshape(-1, 4) if found else np.zeros((0, 4), np.int64)
        e = e[np.argsort(e[:, 0], kind="stable")]
        spans: dict[int, list] = {}
        blobs = [t.column(c).to_pylist() for c in ("rows", "times", "places")]
        for s, stop, n in _runs(e[:, 0]):
            row, times, places = (unpack(x[n]) for x in blobs)
            i, hi, lo = e[s:stop, 1], e[s:stop, 2], e[s:stop, 3]
            each, begin = times[i], (np.cumsum(times) - times)[i]
            at = places[np.repeat(begin, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
            spans.setdefault(int(source[n]), []).append((np.repeat(row[i], each), at - np.repeat(hi, each), at - np.repeat(lo, each) + NEED))
        for b, own in spans.items():
            out.append(dict(zip(_SPANS.names, (b, *map(pack, united(*(np.concatenate(x) for x in zip(*own, strict=True))))), strict=True)))
        spans = e = blobs = found = None
        release()
        return pa.Table.from_pylist(out, schema=_SPANS)

    return run


def cut(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    """The text without the spans, which are in order and apart."""
    return b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)], strict=True))


def _removed(key: tuple, texts: pa.Table, spans: pa.Table) -> pa.Table:
    ids, raw = _rows(texts)
    of = united(*(np.concatenate([unpack(x) for x in spans.column(c).to_pylist()]) for c in ("rows", "starts", "ends"))) if spans.num_rows else [np.zeros(0, np.int64)] * 3
    bounds = np.searchsorted(of[0], np.arange(len(raw) + 1))
    kept = [cut(t, of[1][s:e].tolist(), of[2][s:e].tolist()) if e > s else t for t, s, e in zip(raw, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    n = np.array([len(t) for t in raw], np.int64)
    out = pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": n, "n_removed": n - np.array([len(t) for t in kept], np.int64), "n_spans": np.diff(bounds).astype(np.int64), "kept": pa.array(kept, pa.binary())})
    raw = kept = of = None
    release()
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) for each document."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    doc_buckets, hash_buckets = max(1, -(-total // DOC_BYTES)), max(1, -(-total // HASH_BYTES))
    texts = source.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(doc_buckets))).groupBy("bucket")
    hashes = texts.applyInArrow(_scan(hash_buckets), "hash_bucket long, bucket long, hashes binary, times binary, several binary")
    repeated = hashes.groupBy("hash_bucket").applyInArrow(_repeated, "bucket long, hash_bucket long, hashes binary, hot binary")
    runs = texts.cogroup(repeated.groupBy("bucket")).applyInArrow(_suffix_runs(hash_buckets), _RUN_DDL)
    spans = runs.groupBy("direct", "bucket").applyInArrow(_merged(hash_buckets), "bucket long, rows binary, starts binary, ends binary")
    return texts.cogroup(spans.groupBy("bucket")).applyInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def dedup_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
