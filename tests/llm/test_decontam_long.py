import random

import numpy as np
import pytest
from codestrata.llm import decontam, words
from test_decontam import mutate


@pytest.mark.parametrize("length", [10, 24, 47, 60, 200, 400, 1000])
def test_long_items_are_found_at_the_largest_distance(length):
    rng = random.Random(length)
    vocab = [f"v{i}" for i in range(60)] + [f"r{i}" for i in range(3000)]
    say = lambda n: [vocab[min(int(rng.expovariate(1 / 80)), len(vocab) - 1)] for _ in range(n)]
    items = [say(length) for _ in range(2000 // length + 10)]
    k = decontam.edits(length, 0.8)
    docs = [say(50) + mutate(rng, w, k) + say(50) for w in items]
    index = decontam.Index([(i, " ".join(w)) for i, w in enumerate(items)])
    got = index.find([" ".join(d) for d in docs])
    hashed = lambda w: words.hash_words([x.encode() for x in w])
    found = 0
    for i, (w, d) in enumerate(zip(items, docs, strict=True)):
        assert decontam.best_stretch(hashed(w), hashed(d))[0] <= k
        own = [h for h in got[i] if h[0] == i]
        found += bool(own) and own[0][3] <= k
    assert found >= 0.99 * len(items), (length, found, len(items))
    far = [say(50) + mutate(rng, w, 3 * k) + say(50) for w in items]
    want = [decontam.best_stretch(hashed(w), hashed(d))[0] <= k for w, d in zip(items, far, strict=True)]
    assert all(w for w, x in zip(want, [i in [h[0] for h in x] for i, x in enumerate(index.find([" ".join(d) for d in far]))], strict=True) if x)
    assert np.sum(want) < len(items)
