"""Best-fit packing of token sequences by hierarchical residual packing.

Partitions tokenize their documents and pack the pieces by best-fit decreasing; bins that are
nearly full are final. Underfull bins travel up a tree as items: each round deals them to groups of
bounded size, packs them by best fit again and accepts a larger residual as full, until the last
round accepts all. Only underfull bins are ever shuffled.

Ids are those of the tokenizers library as it reads the file: a special token's string in a text is that token.

Defined cases: a null text is an empty one (its only token is the end id); a null doc_id is carried;
repeated rows are packed once each; an empty table gives no rows; columns other than doc_id and text
are ignored; a text of any length is tokenized whole and cut into pieces; of bins with equal residuals that fit, the one
that got it last takes the item, and equal sizes are packed in the order read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

SEQ_LEN = 1024
END_ID = 2
#: Residual tokens that count as full: of a partition's own bins, then of the bins of each round.
SLACK = (8, 24, 96, SEQ_LEN)
#: Items and open bins held at once by a partition, and pieces of a group of a round.
CHUNK = 65_536
_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, used long, done boolean"
#: A run of white space (as the pattern's \\s has it) that is taken out of the text before its regular expression runs, which would stack a frame a character.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
_cache: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """A byte-level BPE of a tokenizers file, run by tiktoken: the same ids at several times the speed."""
    if path not in _cache:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, special = file["model"]["vocab"], {t["content"]: t["id"] for t in file["added_tokens"]}
        # the printable stand-ins of byte-level BPE: printable bytes stand for themselves, the rest follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(to_byte[c] for c in t): i for t, i in vocab.items() if all(c in to_byte for c in t) and t not in special}
        _cache[path] = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _cache[path]


def _ids_around_space(text: str, path: str) -> Iterator[np.ndarray]:
    """The ids of a text with long runs of white space. Such a run is one pre-token, but for its last character if more follows, whatever stands around it."""
    bpe = encoder(path)
    special = f"({'|'.join(map(re.escape, sorted(bpe.special_tokens_set)))})" if bpe.special_tokens_set else "(?!)()"
    for n, part in enumerate(re.split(special, text)):
        if n % 2:
            yield np.array([bpe.encode_single_token(part)])
            continue
        at = 0
        for run in _LONG_SPACE.finditer(part):
            yield bpe.encode_to_numpy(part[at : run.start()], disallowed_special=())
            at = run.end() if run.end() == len(part) else run.end() - 1
            yield np.array(bpe._encode_single_piece(part[run.start() : at]))
        yield bpe.encode_to_numpy(part[at:], disallowed_special=())


def token_ids(text: str, path: str) -> np.ndarray:
    if _LONG_SPACE.search(text):
        ids = np.concatenate(list(_ids_around_space(text, path)))
    else:
        ids = encoder(path).encode_to_numpy(text, allowed_special="all")
    return np.append(ids, np.uint32(END_ID)).astype("<u4")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing. Returns the bins as lists of indexes. Open bins are found by a bit mask of residuals."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins: list[list[int]] = []
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in order:
        s = sizes[i]
        m = mask >> s
        if m:
            r = s + (m & -m).bit_length() - 1
            b = at[r].pop()
            if not at[r]:
                mask ^= 1 << r
            bins[b].append(i)
            r -= s
        else:
            b, r = len(bins), capacity - s
            bins.append([i])
        at[r].append(b)
        mask |= 1 << r
    return bins


def _tokenize_and_pack(path: str, seq_len: int, slack: int, chunk: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "sequence_id", "offset", "used")), ("done", pa.bool_())])

    def batch(bins: list[tuple[int, list[tuple], int, bool]]) -> pa.RecordBatch:
        rows = []
        for number, members, used, done in bins:
            offset = 0
            for m in members:
                rows.append((*m, number, offset, used, done))
                offset += m[3]
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count = TaskContext.get().partitionId() << 34, 0
        full: list[tuple] = []
        items: list[tuple[int, list[tuple]]] = []  # length, pieces

        def packed() -> list[tuple[int, list[tuple]]]:
            return [(sum(items[i][0] for i in b), [m for i in b for m in items[i][1]]) for b in best_fit([x[0] for x in items], seq_len)]

        for rb in batches:
            for doc_id, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                ids = token_ids(text or "", path)
                n, start, piece = len(ids), 0, 0
                size = n - (-(-n // seq_len) - 1) * seq_len
                while start < n:
                    x = (doc_id, piece, start, size, zlib.crc32(ids[start : start + size].tobytes()))
                    if size == seq_len:
                        full.append((base + count, [x], size, True))
                        count += 1
                    else:
                        items.append((size, [x]))
                    start, piece, size = start + size, piece + 1, seq_len
            if len(items) >= chunk:
                kept = []
                for used, members in packed():
                    if seq_len - used <= slack:
                        full.append((base + count, members, used, True))
                        count += 1
                    else:
                        kept.append((used, members))
                if len(kept) > chunk // 2:  # no small items come: leave these to the rounds
                    for used, members in kept:
                        full.append((base + count, members, used, False))
                        count += 1
                    kept = []
                items = kept
            if len(full) >= 4096:
                yield batch(full)
                full = []
        for used, members in packed() if items else []:
            full.append((base + count, members, used, seq_len - used <= slack))
            count += 1
        yield batch(full)

    return run


def _merge(seq_len: int, slack: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sequence_id", "offset"], kind="stable")
        bins = pdf.drop_duplicates("sequence_id")
        ids, used = bins["sequence_id"].tolist(), bins["used"].tolist()
        to, shift, total = {}, {}, {}
        for b in best_fit(used, seq_len):
            at = 0
            for i in b:
                to[ids[i]], shift[ids[i]] = ids[b[0]], at
                at += used[i]
            total[ids[b[0]]] = at
        old = pdf["sequence_id"]
        new = old.map(to)
        size = new.map(total)
        out = pdf.assign(sequence_id=new, offset=pdf["offset"] + old.map(shift), used=size, done=seq_len - size <= slack)
        return out[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "used", "done"]]

    return run


def pack(docs: DataFrame, tokenizer_path: str | None = None, seq_len: int = SEQ_LEN, slack: tuple[int, ...] = SLACK, chunk: int = CHUNK) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    path = tokenizer_path or default_tokenizer()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    level = materialize(source.mapInArrow(_tokenize_and_pack(path, seq_len, slack[0], chunk), _SCHEMA), "packed")
    parts = [level.where("done")]
    for s in slack[1:]:
        left = level.where("NOT done")
        n = left.count()
        if not n:
            break
        groups = -(-n // chunk)
        dealt = left.withColumn("_g", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)))
        level = materialize(dealt.groupBy("_g").applyInPandas(_merge(seq_len, seq_len if groups == 1 else s), _SCHEMA), "packed")
        parts.append(level.where("done"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("used", "done")
