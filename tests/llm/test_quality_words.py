import random

from codestrata.llm import quality_rules as q

EN, DE = q.COMMON[:10], q.COMMON[10:20]


def test_texts_without_common_words_or_of_another_language_go(spark):
    rng = random.Random(6)
    rare = [f"{a}{b}{c}{d}" for a in "bdfgk" for b in "aeiou" for c in "lmnr" for d in "aeiou"]
    say = lambda n, common: " ".join(rng.choice(common) if common and rng.random() < 0.2 else rng.choice(rare) for _ in range(n)) + "."
    rows = [(i, say(rng.randrange(256, 500), DE if i % 2 else EN), "de" if i % 2 else "en") for i in range(200)]
    rows += [(1000 + i, say(300, ()), "de" if i % 2 else "en") for i in range(6)]
    rows += [(2000 + i, say(300, EN if i % 2 else DE), "de" if i % 2 else "en") for i in range(6)]
    rows += [(3000 + i, say(150, EN if i % 2 else DE), "de" if i % 2 else "en") for i in range(6)]
    got = {r.doc_id: r.kept for r in q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    stayed = [i for i in got if i >= 1000 and got[i]]
    assert not stayed, stayed
    gone = [i for i in range(200) if not got[i]]
    assert len(gone) <= 2, gone


def test_many_languages_are_joined_alike(spark, monkeypatch):
    rng = random.Random(9)
    rare = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnr"]
    rows = [(i, " ".join(rng.choice(rare + list(EN)) for _ in range(rng.randrange(60, 300))), f"l{i % 400}" if i % 7 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = sorted(map(tuple, q.quality_rules(df).collect()), key=str)
    monkeypatch.setattr(q, "BROADCAST_ROWS", 10)
    assert sorted(map(tuple, q.quality_rules(df).collect()), key=str) == one and len(one) == 900
