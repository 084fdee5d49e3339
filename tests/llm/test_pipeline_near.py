import corpus_pipeline as cp
from test_neardup import brute, sets


def test_near_dedup_stage_links_from_four_fifths(spark):
    docs = []
    for i in range(30):
        w = [f"w{i}x{j}" for j in range(104)]  # 100 shingles
        docs.append((10 * i, " ".join(w)))
        docs.append((10 * i + 1, " ".join(["new", *w[1:40], "edited", *w[41:-4], "a", "b", "c"])))
        docs.append((10 * i + 2, " ".join([*w[:20], "one", *w[21:40], "two", *w[41:60], "three", *w[61:]])))
    alike = [len(sets(a) & sets(b)) / len(sets(a) | sets(b)) for (_, a), (_, b) in zip(docs[::3], docs[1::3], strict=True)]
    assert all(0.8 <= x < 0.85 for x in alike), alike[0]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars int")
    got = {r.doc_id for r in cp.drop_near_duplicates(spark, df, "").collect()}
    assert got == {i for i, x in brute(docs, 80).items() if x[2]} == {i for i, _ in docs if i % 10 != 1}
