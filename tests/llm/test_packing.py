import zlib

import numpy as np
import pytest
from codestrata.llm import packing
from tokenizers import Tokenizer

TEXTS = ["", None, "a", "word " * 3000, "Ünïcode ½ Ⅷ _x_ \x1c y", "I'm <|endoftext|> ok", "<|endoftext|>", " a  <|endoftext|><|endoftext|>\n\n b<|endoftext", "The cat's  \t paw 123 4567!? " * 9000, "x" * 9000, "日本語 テスト", "  lead\n\n trail  "]


TOKENIZER = Tokenizer.from_file(packing.default_tokenizer())


def ids_of(text):
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_the_tokenizers_library(text):
    assert packing.token_ids(text or "", packing.default_tokenizer()).tolist() == ids_of(text).tolist()


N = 2_000_000
SPACE = {"spaces": " " * N + "a", "newlines": "\n" * N + "a", "at the end": "a " + " " * N, "alone": "\t" * N, "mixed": "x\u3000" + " \n\u2003\x85" * (N // 4) + "<|endoftext|>" + " " * N + "\n<|endoftext|>b", "twice": "a" + "\n" * 20_000 + "é" + " " * 30_000 + "\nb", "control": "\x1c" * 20_000 + " " * 20_000 + "\x1fa"}


@pytest.mark.parametrize("name", SPACE)
def test_long_white_space(name):
    assert packing.token_ids(SPACE[name], packing.default_tokenizer()).tolist() == ids_of(SPACE[name]).tolist()


def test_other_long_runs():
    for x in ("x", "7", "-", "é", "'s "):
        assert len(packing.token_ids(x * 1_200_000, packing.default_tokenizer())) > 1000


def check(rows, docs):
    seqs, got = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        got.setdefault(r.doc_id, []).append(r)
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 1024
    total = 0
    for doc_id, text in docs:
        ids, at = ids_of(text), 0
        total += len(ids)
        for k, r in enumerate(sorted(got[doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (r.length == 1024 or k == 0)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    return len(seqs), total


@pytest.mark.parametrize("chunk", [4, 65536])
def test_pieces_and_places(spark, chunk):
    docs = [(i, TEXTS[i % len(TEXTS)]) for i in range(40)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, length int").repartition(3)
    n, total = check(packing.pack(df, chunk=chunk).collect(), docs)
    assert n <= -(-total // 1024) * 1.5 + 10


def test_whole_table_is_tight(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    n, total = check(packing.pack(df).collect(), [(r.doc_id, r.text) for r in df.collect()])
    assert n <= total / 1024 * 1.03 + 1


def test_groups_of_a_round_are_bounded_by_pieces(spark):
    """Tiny documents: bins of a thousand pieces each make many groups, all of them whole."""
    docs = [(i, "a" if i % 5 else "a b c") for i in range(3000)]
    n, total = check(packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(9), chunk=512).collect(), docs)
    assert n <= -(-total // 1024) * 1.5 + 10


def test_long_white_space_is_packed(spark):
    docs = [(1, SPACE["spaces"]), (2, "a b"), (3, SPACE["mixed"])]
    check(packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)).collect(), docs)


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none).count() == 0
    rows = packing.pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.length) for r in rows) == [(False, 3), (False, 3), (True, 2)]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3
