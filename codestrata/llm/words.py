"""Vectorised word hashing: 64-bit hashes of whole words from one pass over the bytes of many texts.

A word's hash is a polynomial over random byte values modulo 2^64, read off a running sum, then mixed. Such polynomials of long words can be made to
collide (those of a Thue-Morse word and its complement do, for any base), so words over LONG bytes, far below where that begins, have a BLAKE2b digest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np

_U = np.uint64
_BLOCK = 1 << 20
LONG = 32
_tables: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def random_words(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + _U(seed) * _U(1_000_003)) * _U(0x9E3779B97F4A7C15))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if _tables.get("n", 0) < n:
        base = 0x9E3779B97F4A7C55
        size = max(n, 1 << 16)
        up = np.empty(size, np.uint64)
        down = np.empty(size, np.uint64)
        up[0] = down[0] = 1
        up[1:] = _U(base)
        down[1:] = _U(pow(base, -1, 1 << 64))
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        _tables.update(n=size, up=up, down=down, bytes=random_words(256, 7))
    return _tables["up"][:n], _tables["down"][:n], _tables["bytes"]


def _hash_joined(joined: bytes) -> np.ndarray:
    """Hashes of the words of single-space separated bytes."""
    a = np.frombuffer(joined, np.uint8)
    up, down, table = _powers(len(a) + 1)
    total = np.empty(len(a) + 1, np.uint64)
    total[0] = 0
    np.cumsum(table[a] * up[: len(a)], out=total[1:])
    gaps = np.flatnonzero(a == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(a)]))
    out = mix((total[ends] - total[starts]) * down[starts])
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        out[i] = int.from_bytes(blake2b(joined[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def hash_words(words: list[bytes]) -> np.ndarray:
    """One hash per word. No word may hold a space or be empty."""
    out, at, size = [], 0, 0
    if not words:
        return np.empty(0, np.uint64)
    if sum(map(len, words)) + len(words) <= _BLOCK:
        return _hash_joined(b" ".join(words))
    for i, w in enumerate(words):
        size += len(w) + 1
        if size >= _BLOCK:
            out.append(_hash_joined(b" ".join(words[at : i + 1])))
            at, size = i + 1, 0
    if at < len(words):
        out.append(_hash_joined(b" ".join(words[at:])))
    return np.concatenate(out)


def lower_words(text: str | None) -> list[bytes]:
    """Words of [^\\x20\\x09-\\x0D]+ after lower-casing A-Z."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def each_hashed(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order. Small texts are hashed together."""
    held: list[bytes] = []
    counts: list[int] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        yield from np.split(hash_words(held), np.cumsum(counts)[:-1]) if counts else ()

    for t in texts:
        w = lower_words(t)
        held += w
        counts.append(len(w))
        size += len(t or "")
        if size >= _BLOCK // 2:
            yield from flush()
            held, counts, size = [], [], 0
    yield from flush()


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each window of k words; order matters."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = np.full(n, _U(0x2545F4914F6CDD1D) * _U(k))
    for j in range(k):
        x = (x + h[j : j + n]) * _U(0xD6E8FEB86659FD93)
        x ^= x >> _U(32)
    return mix(x)


def shingle_set(h: np.ndarray, k: int = 5) -> np.ndarray:
    """The sorted distinct k-word shingles; with fewer words, the whole sequence as one."""
    if not len(h):
        return h
    return np.unique(grams(h, k if len(h) >= k else len(h)))
