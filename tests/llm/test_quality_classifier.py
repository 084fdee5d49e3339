import random

import numpy as np
from codestrata.llm import quality_classifier as q


def make(rng, n):
    vocab = [f"{a}{b}{c}" for a in ("ba", "do", "fi", "gu") for b in ("len", "mir", "nas") for c in ("to", "vu", "za")]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(80)]
        g = i % 3
        if g == 1:
            w[5] = w[40] = "scumword"
        text = " ".join(x + (rng.choice(["###", "$$$"]) if g == 0 else "") for x in w)
        rows.append((i, text, g))
        labels.append((i, int(g > 0), int(g == 1)))
    return rows, labels


def test_grades_are_learned_and_ordered(spark):
    rows, labels = make(random.Random(1), 900)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, kept string")
    rated = spark.createDataFrame([x for x in labels if x[0] < 600] + [(None, 1, 0), (5, None, 0), (10**9, 1, 0)], "doc_id long, quality int, toxic int")
    model = q.fit(docs, rated)
    assert model.cuts[0] < model.cuts[1]
    got = {r.doc_id: r for r in q.score(docs, model).collect()}
    test = [(got[i], g) for i, _, g in rows if i >= 600]
    assert sum(r.kept == (g == 2) for r, g in test) >= 0.97 * len(test)
    means = [np.mean([r.expected_grade for r, g in test if g == j]) for j in range(3)]
    assert means[0] < means[1] < means[2] and all(0 <= r.tail_probability <= r.expected_grade <= 2 for r, _ in test)


def test_gradient_agrees_with_a_direct_fit():
    rng = np.random.default_rng(0)
    n = 3000
    x = rng.integers(0, 2, n)
    s = 2.0 * x
    u = rng.logistic(size=n) + s
    grades = (u > 0.5).astype(int) + (u > 2.0)
    m = q.fit_ordinal([np.array([7]) if v else np.array([9]) for v in x], grades, steps=1500, ridge=0, least_z=0)
    w = dict(zip(m.ids.tolist(), m.weights.tolist(), strict=True))
    assert abs(w[7] - w[9] - 2.0) < 0.25 and abs(m.cuts[1] - m.cuts[0] - 1.5) < 0.2


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a " * 60000), (3, "b"), (None, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r.kept, round(r.expected_grade, 6)) for r in q.score(docs, q.fit(docs, none)).collect()] == [(True, 2.0)] * 5
    one = spark.createDataFrame([(1, 1, None), (1, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert q.score(docs, q.fit(docs, one)).count() == 5
    assert q.score(docs.limit(0), q.fit(docs, one)).count() == 0


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    part = labels.where("pmod(xxhash64(doc_id), 4) <> 0")
    got = q.score(docs, q.fit(docs, part)).join(labels.where("pmod(xxhash64(doc_id), 4) = 0"), "doc_id").collect()
    good = [r.kept for r in got if r.quality == 1 and not r.toxic]
    low = [r.kept for r in got if r.quality == 0]
    toxic = [r.kept for r in got if r.quality == 1 and r.toxic]
    assert np.mean(good) >= 0.98 and np.mean(low) <= 0.04 and np.mean(toxic) <= 0.15, (np.mean(good), np.mean(low), np.mean(toxic))


def test_several_texts_and_repeated_rows(spark):
    rows, labels = make(random.Random(2), 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(7, "zzz")] + [(9, rows[9][1])], "doc_id long, text string")
    rated = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a, b = (q.fit(d, rated) for d in (docs, docs.repartition(5)))
    assert (a.ids == b.ids).all() and np.allclose(a.weights, b.weights) and np.allclose(a.cuts, b.cuts)


def test_scores_equal_plain_python(spark):
    """The features and the model in plain Python: sums of weights of hashed tokens, two thresholds."""
    rows, labels = make(random.Random(3), 200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = q.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    weight = dict(zip(model.ids.tolist(), model.weights.tolist(), strict=True))
    got = {r.doc_id: r for r in q.score(docs, model).collect()}
    for i, t, _ in rows:
        s = sum(weight.get(x, 0.0) for x in next(q.features([t])).tolist())
        above = [1 / (1 + np.exp(c - s)) for c in model.cuts]
        assert abs(got[i].expected_grade - sum(above)) < 1e-4 and abs(got[i].tail_probability - above[1]) < 1e-4 and got[i].kept == (got[i].tail_probability >= 0.5)
