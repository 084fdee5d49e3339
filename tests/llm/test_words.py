"""Word hashes: words that a polynomial modulo 2^64 can't tell apart are apart."""

import numpy as np
from codestrata.llm import decontam, neardup, words


def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate({97: 98, 98: 97})
    return w, w.translate({97: 98, 98: 97})


def test_long_words_with_equal_polynomials_differ():
    for n in (64, 1024, 2048, 65536):
        a, b = (x.encode() for x in thue_morse(n))
        assert len(np.unique(words.hash_words([a, b, b"x", a]))) == 3


def test_they_link_nothing_and_leak_nothing(spark):
    a, b = thue_morse(2048)
    docs = spark.createDataFrame([(1, a), (2, b), (3, b)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 2}
    index = decontam.Index([(7, a)])
    assert index.find([b, a]) == [[], [(7, 0, 1, 0, 1.0)]]
