"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to its character n-grams of five, then
four, three, two and one letters (with marks for the word's start and end): the longest length of which any gram is known decides,
by the mean of these grams' log frequencies. A document's score for a language is the sum over its words; the prediction is the
largest, its score that language's share after normalisation.

Learning is distributed counting over a sample of labelled rows of SAMPLE_DOCS in all, dealt evenly to the languages (each language
gives as many as it has, up to its share, chosen by a hash of doc_id). The TABLE_SIZE words and grams with the largest share of some language's
are kept, so that frequent languages don't crowd out others; fewer where CELLS numbers don't suffice for so many languages. All labels
are learned.

Defined cases: a text that is null or has no letter is `und` with score 0, as is any text if nothing could be learned; of languages with
equal sums the alphabetically first is predicted; rows with a null doc_id are predicted but never learned from; repeated rows give a row
each, and equal results; a text of any length is read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, text_or_empty

SAMPLE_DOCS = 4096
TABLE_SIZE = 120_000
#: Rows times languages of the model.
CELLS = 32 << 20
LONGEST = 5
_SMOOTH = 0.1
_MEMO = 120_000
_WORD = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a marked word; a tag keeps lengths and words apart."""
    w = f"^{word}$"
    return [f"{n}{w[i : i + n]}" for i in range(len(w) - n + 1)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, Counter] = {}

    def flush() -> pa.RecordBatch:
        rows = [(lang, g, n) for lang, c in seen.items() for g, n in c.items()]
        cols = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "gram", "n"])

    for rb in batches:
        for lang, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
            c = seen.setdefault(lang, Counter())
            for w, n in Counter(letters(text)).items():
                c[f"w{w}"] += n
                for k in range(1, LONGEST + 1):
                    for g in grams(w, k):
                        c[g] += n
        if sum(map(len, seen.values())) > 150_000:
            yield flush()
            seen = {}
    yield flush()
    seen = {}
    release()


class Model:
    def __init__(self, langs: list[str], rows: list[str], counts: np.ndarray):
        """rows: words tagged w and grams tagged by length; counts: one column per language."""
        self.langs = langs
        self.index = {g: i for i, g in enumerate(rows)}
        tags = np.array([ord(g[0]) for g in rows], np.int64)
        logs = np.zeros((len(rows), len(langs)), np.float64)
        for t in np.unique(tags):
            own = counts[tags == t] + _SMOOTH
            logs[tags == t] = np.log(own / own.sum(0))
        self.logs = logs.astype(np.float32)


class Scorer:
    """A model at work: unseen words' vectors are kept in a bounded memo."""

    def __init__(self, model: Model):
        self.langs, self.index, self.size = model.langs, model.index, len(model.logs)
        self.table = np.concatenate([model.logs, np.zeros((_MEMO, len(model.langs)), np.float32)])
        self.words = {g[1:]: i for g, i in self.index.items() if g[0] == "w"}
        self.known = len(self.words)
        self.memo: dict[str, int] = {}

    def _unseen(self, word: str) -> int:
        if len(self.memo) >= _MEMO:
            self.memo.clear()
        at = self.size + len(self.memo)
        w, index = f"^{word}$", self.index
        for n in range(LONGEST, 0, -1):
            own = [i for k in range(len(w) - n + 1) if (i := index.get(f"{n}{w[k : k + n]}")) is not None]
            if own:
                np.multiply(np.add.reduce(self.table.take(own, 0), 0), 1 / len(own), out=self.table[at])
                break
        else:
            self.table[at] = 0
        self.memo[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        found = Counter(letters(text))
        if not self.langs or not any(c.isalpha() for w in found for c in w):
            return "und", 0.0
        total = np.zeros(len(self.langs))
        items = list(found.items())
        for at in range(0, len(items), _MEMO // 2):
            part = items[at : at + _MEMO // 2]
            if len(self.memo) + len(part) >= _MEMO:
                self.memo.clear()
            words, memo = self.words, self.memo
            rows = [i if (i := words.get(w)) is not None else i if (i := memo.get(w)) is not None else self._unseen(w) for w, _ in part]
            total += np.array([n for _, n in part], np.float64) @ self.table[rows]
        p = np.exp(total - total.max())
        best = int(total.argmax())
        return self.langs[best], float(p[best] / p.sum())


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, table_size: int = TABLE_SIZE) -> Model:
    """docs: doc_id, text, lang. Learns from rows with a lang that aren't held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each label
    langs = sorted(sizes)
    if not langs:
        return Model([], [], np.zeros((0, 0)))
    share = sample_docs / len(langs)
    quota = F.create_map(*(F.lit(x) for k in langs for x in (k, float(min(1.0, share / sizes[k])))))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) < quota[F.col("lang")] * (1 << 30)
    counted = materialize(rows.where(drawn).select("lang", "text").mapInArrow(_count, "lang string, gram string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")), "grams")
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return Model(langs, [], np.zeros((0, len(langs))))
    of_lang = F.create_map(*(F.lit(x) for k, n in totals.items() for x in (k, float(n))))
    size = min(table_size, CELLS // len(langs))
    best = counted.groupBy("gram").agg(F.sum("n").alias("_all"), F.max(F.col("n") / of_lang[F.col("lang")]).alias("_share")).where("_all > 1").orderBy(F.desc("_share"), "gram").limit(size)
    got = counted.join(best.select("gram"), "gram").toArrow()  # at most CELLS rows
    grams_, row = np.unique(got.column("gram").to_numpy(zero_copy_only=False), return_inverse=True)
    counts = np.zeros((len(grams_), len(langs)))
    counts[row, np.searchsorted(langs, got.column("lang").to_numpy(zero_copy_only=False))] = got.column("n").to_numpy()
    return Model(langs, grams_.tolist(), counts)


def _predict(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for rb in batches:
            got = [scorer.predict(t) for t in rb.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])
        del scorer
        release()

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)
    doc_id = F.col("doc_id").cast("long")
    source = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), text_or_empty().alias("text"))
    return source.mapInArrow(_predict(held), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document; learned from those that aren't held out."""
    return predict(docs, fit(docs))


def accept(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents whose language is recognised, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(held.value)
        for texts in batches:
            yield pd.Series([scorer.predict(t)[1] >= least for t in texts], dtype=bool)
        del scorer
        release()

    return docs.where(known(text_or_empty()))
