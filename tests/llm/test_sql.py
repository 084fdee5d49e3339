import random

import duckdb
import pytest
from codestrata.llm import queries
from test_spans import fuzz

EXTRA = ["ghp_" + "a1" * 18, "xgho_" + "Z" * 36, "ghs_" + "b" * 300 + " ghp_" + "c" * 40, "eyJabcdefgh.eyJabcdefgh.abcdefgh", "-eyJabcdefgh.eyJabcdefgh.abcdefgh", "-----BEGIN RSA PRIVATE KEY-----", "xoxb-1234567890-abc", "é AKIA" + "A1" * 9]


def key(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(x for x in queries.SQL if "FROM documents" in queries.SQL[x]))
def test_sql_says_the_same(spark, name, tmp_path):
    """On the table, with made texts beside its own: secrets and repeats of all kinds, empty texts, and no rows at all."""
    rng = random.Random(4)
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    made = [None, "", "x" * 60, *EXTRA, *(fuzz(rng, rng.randrange(1, 30)) for _ in range(150)), *("".join(rng.choice([rng.choice(EXTRA), " ", "é", "ab ", "\n#$ "]) for _ in range(9)) for _ in range(60))]
    rows += [(10_000 + i, t, rng.choice(["en", "xx", None])) for i, t in enumerate(made)]
    for own in (rows, []):
        spark.createDataFrame(own, "doc_id long, text string, lang string").repartition(3).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        rel = con.sql(queries.SQL[name])
        df = queries.queries()[name](spark, str(tmp_path))
        assert sorted(df.columns) == sorted(rel.columns)
        got = sorted((tuple(key(r[c]) for c in rel.columns) for r in df.collect()), key=str)
        assert got == sorted((tuple(map(key, r)) for r in rel.fetchall()), key=str)
        assert len(got) == len(own)
