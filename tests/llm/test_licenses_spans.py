import random

import numpy as np
import pyarrow as pa
from codestrata.llm import licenses


def test_notices_need_their_words_in_order(spark):
    rng = random.Random(1)
    w = licenses.NOTICES["mpl"].split()
    mixed = [" ".join(w[i : i + 2]) for i in range(0, len(w), 2)]
    rng.shuffle(mixed)
    apart = " ".join(x + " z" * 12 if i % 3 == 2 else x for i, x in enumerate(w))
    texts = ["GNU General Public License v2\n" * 8, " ".join(mixed), apart, "x " * 30 + " ".join(w) + " y" * 30, ("z " * 9).join([" ".join(w)] * 3), "public license " * 2000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(rows).collect()}
    assert got == {0: ("gpl", 1.0), 1: ("", 0.0), 2: ("", 0.0), 3: ("mpl", 1.0), 4: ("mpl", 1.0), 5: ("", 0.0)}


def plain(text):
    """The whole operator in plain Python: votes for each template by words, base phrases in full, notices by the longest chain."""
    w = licenses.content_words(text)
    labels, base_labels, score = set(), set(), 0.0
    for label, base, t in licenses._every():
        v = licenses.content_words(t)
        size = len(v) - licenses.K + 1
        at: dict = {}
        for j in range(size):
            at.setdefault(tuple(v[j : j + licenses.K]), []).append(j)
        places = [(i, j) for i in range(len(w) - licenses.K + 1) for j in at.get(tuple(w[i : i + licenses.K]), ())]
        if base:
            if any(w[i : i + len(v)] == v for i, _ in places):
                labels.add(label)
                base_labels.add(label)
                score = 1.0
        elif len({j for _, j in places}) >= licenses.LEAST * size:
            best: list = []  # for each place the latest start of a chain of each length that ends there
            most = 0
            for i, j in sorted(places):
                own = {1: i}
                for (q, b), ends in zip(sorted(places), best, strict=False):
                    if q < i and b < j and abs((i - j) - (q - b)) <= licenses.SLIP:
                        for n, start in ends.items():
                            if i - start <= 2 * size + licenses.SLIP:
                                own[n + 1] = max(own.get(n + 1, -1), start)
                best.append(own)
                most = max(most, *own)
            if most >= licenses.LEAST * size:
                labels.add(label)
                score = max(score, most / size)
    return ",".join(sorted(labels)), ",".join(sorted(base_labels)), score


def test_the_whole_operator_on_the_table_and_on_pieces_of_notices(spark, sf):
    rng = random.Random(8)
    notices = [n.split() for n in licenses.NOTICES.values()]
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            w = list(rng.choice(notices))
            for _ in range(rng.randrange(0, 9)):
                i = rng.randrange(len(w))
                w[i : i + rng.randrange(2)] = [rng.choice(["of", "the", "license", "x", "software"])] * rng.randrange(3)
            parts += [*w[rng.randrange(9) :], *["so"] * rng.randrange(14)]
        texts.append(" ".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.base_labels, r.score) for r in licenses.scan(df).collect()}
    want = {i: plain(t) for i, t in enumerate(texts)}
    assert {i: x[:2] for i, x in got.items()} == {i: x[:2] for i, x in want.items()}
    assert all(abs(got[i][2] - want[i][2]) < 1e-9 for i in want)
    assert len({x[0] for x in want.values()}) > 8


def test_common_words_make_no_notice(spark):
    texts = ["of the river we saw " * 20, "license at dawn the " * 30, "of the license " * 400_000, "under the terms of the " * 50]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: ("", 0.0) for i in range(4)}


def test_equal_hashes_of_other_words_have_no_vote(spark, monkeypatch):
    monkeypatch.setattr(licenses, "_grams", lambda t: (np.zeros(max(0, len(licenses.content_words(t)) - 1), np.int64), licenses.content_words(t)))
    rb = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["mit license and other words"]})
    out = next(licenses._hashes(iter([rb])))
    assert len(out.column(3)[0]) == 4 or len(out.column(3)[0]) == 3
