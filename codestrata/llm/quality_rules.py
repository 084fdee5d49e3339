"""Quality rules by distribution divergence, on the JVM alone.

Each document's histogram of character classes and its histogram of common words are held against references of its
language by Jensen-Shannon distance (0 to 1). References are the sums over all documents of the language that pass the
base rules; documents without a language, or of one without such documents, are held against all languages
together. A distance counts only for documents of a minimum length, as short histograms stray by chance.

Distances of common words fall with the root of the length, so the limit is set on their product: the median over the sound
documents of the language and length (a power of two), plus DEVIATIONS times the spread from the 16th percentile to it, which the
strange ones above do not widen. Fewer than LEAST_DOCS documents take the limit of all lengths of the language, then of all languages;
documents of the pooled reference take their own, and MAX_WORD_DISTANCE without one.

The text is read once: counts are written to the shared folder, then summed and compared; so are the distances.

Defined cases: a null text has no words and fails the base rules; a null lang uses the pooled reference; repeated rows give a
row each, and equal results; a text of any length is counted whole; a distance right at a limit is kept; an empty table gives no rows;
columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WHITE, materialize, text_or_empty

# Frequent function words of English, German, French and Spanish.
COMMON = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with",
    "der", "die", "und", "das", "den", "von", "ist", "nicht", "ein", "mit",
    "le", "la", "les", "de", "et", "des", "un", "du", "que", "pour",
    "el", "los", "en", "y", "las", "por", "con", "una", "se", "no",
)
#: Rows (of a language, or a language and length) up to which they are sent to every executor.
BROADCAST_ROWS, SPLIT = 32_768, 16
MIN_CHARS, MAX_CHAR_DISTANCE = 200, 0.3
MIN_WORDS, MAX_WORD_DISTANCE = 100, 0.6
DEVIATIONS, LEAST_SPREAD, LEAST_DOCS = 4, 0.1, 30
#: Width and number of the bins of distances times the root of the length.
BIN, BINS = 0.02, 5000
_WS = r"[\x20\x09-\x0D]+"
_CHARS = ("lower", "upper", "digit", "white", "mark", "symbol")


def _taken(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def counts(docs: DataFrame) -> DataFrame:
    """Base counts and histograms of each document, without a shuffle."""
    t = F.col("_t")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_or_empty().alias("_t"))
    trimmed = F.btrim(t, F.lit(WHITE))
    d = d.select("doc_id", "lang", "_t", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _WS)).alias("_w"))
    w, n = F.col("_w"), F.size("_w")
    d = d.select(
        "doc_id", "lang", n.cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, _WS, "")).cast("long").alias("word_chars"),
        F.length(t).cast("long").alias("_all"),
        _taken(t, "[#*$%&|<>]+").alias("n_symbols"),
        _taken(t, r"\p{Lu}+").alias("_upper"), _taken(t, "[0-9]+").alias("_digit"), _taken(t, r"[.,;:!?'\"()\[\]_-]+").alias("_mark"), _taken(t, r"[^\p{L}\p{N}\x09-\x0D\x20.,;:!?'\"()\[\]_-]+").alias("_symbol"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.transform(F.filter(w, lambda x: F.lower(x).isin(*COMMON)), F.lower).alias("_common"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))).otherwise(F.array().cast("array<bigint>")).alias("_g"),
    )
    g = F.col("_g")
    pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    empty = F.expr("cast(array() AS array<struct<h:bigint,i:int>>)")
    d = d.withColumn("_s", F.when(F.size(F.array_distinct(g)) < F.size(g), pairs).otherwise(empty)).drop("_g")
    s = F.col("_s")
    again = F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"]))
    d = d.withColumn("_p", F.sort_array(F.filter(again, lambda i: i.isNotNull()))).drop("_s")
    p, common = F.col("_p"), F.col("_common")
    covered = F.aggregate(F.transform(p, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - i, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    words = [(F.size(common) - F.size(F.array_remove(common, v))).cast("long") for v in COMMON]
    white = F.col("_all") - F.col("word_chars")
    other = F.greatest(F.lit(0), F.col("_all") - white - F.col("_upper") - F.col("_digit") - F.col("_mark") - F.col("_symbol"))
    d = d.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.array(other, F.col("_upper"), F.col("_digit"), white, F.col("_mark"), F.col("_symbol")).alias("chars"),
        F.array(*words, F.col("n_words") - F.size(common)).alias("common"),
    )
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _distribution(c: Column, n: int) -> Column:
    """Shares of the counts, each raised by a half so that none is nothing."""
    total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x) + F.lit(n / 2)
    return F.transform(c, lambda x: (x + 0.5) / total)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of positive shares: the root of the divergence in bits, 0 to 1."""
    parts = F.zip_with(p, q, lambda a, b: (a * F.log2(2 * a / (a + b)) + b * F.log2(2 * b / (a + b))) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)))


def word_limits(d: DataFrame) -> DataFrame:
    """group, length, limit (of the distance times the root of the length); length -1 for all, group * for all languages."""
    scaled = F.least(F.lit(BINS), F.floor(F.col("word_distance") * F.sqrt("n_words") / BIN))
    sound = d.where((~F.col("base_failed")) & (F.col("n_words") >= MIN_WORDS))
    bins = sound.groupBy("group", "length", scaled.alias("bin")).agg(F.count("*").alias("n"))
    level = lambda group, length: F.struct(group.alias("group"), length.alias("length"))
    every = F.when(F.col("group") != "-", level(F.lit("*"), F.lit(-1)))
    levels = F.filter(F.array(level(F.col("group"), F.col("length")), level(F.col("group"), F.lit(-1)), every), lambda x: x.isNotNull())
    bins = bins.select(F.explode(levels).alias("_l"), "bin", "n").groupBy("_l.group", "_l.length", "bin").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("group", "length")
    bins = bins.withColumn("_upto", F.sum("n").over(own.orderBy("bin"))).withColumn("_all", F.sum("n").over(own)).where(F.col("_all") >= LEAST_DOCS)
    at = lambda q: F.min(F.when(F.col("_upto") >= q * F.col("_all"), F.col("bin"))) * BIN
    q = bins.groupBy("group", "length").agg(at(0.1587).alias("low"), at(0.5).alias("mid"))
    return q.select("group", "length", (F.col("mid") + BIN + DEVIATIONS * F.greatest(F.lit(LEAST_SPREAD), F.col("mid") - F.col("low"))).alias("limit"))


def _beside(d: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """d with the row of few for its keys, if any. Too many rows to send about are shuffled, the rows of d with a key to SPLIT tasks."""
    if few.count() <= BROADCAST_ROWS:
        return d.join(F.broadcast(few), keys, "left")
    parts = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))))
    return d.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(SPLIT)).cast("int")).join(parts, [*keys, "_part"], "left").drop("_part")


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance."""
    feats = materialize(counts(docs), "quality")
    sizes = {"chars": len(_CHARS), "common": len(COMMON) + 1}
    sums = [F.array(*(F.coalesce(F.sum(F.col(c)[i]), F.lit(0)).cast("double") for i in range(n))).alias(f"ref_{c}") for c, n in sizes.items()]
    sound = feats.where("NOT base_failed")
    refs = materialize(sound.where("lang IS NOT NULL").groupBy("lang").agg(*sums), "references")
    pooled = sound.agg(*sums).first()
    d = _beside(feats, refs, ["lang"])
    distance = {}
    for c, n in sizes.items():
        ref = F.coalesce(F.col(f"ref_{c}"), F.array(*(F.lit(float(x)) for x in pooled[f"ref_{c}"])))
        distance[c] = js_distance(_distribution(F.transform(F.col(c), lambda x: x.cast("double")), n), _distribution(ref, n))
    d = d.withColumn("char_distance", distance["chars"]).withColumn("word_distance", distance["common"])
    chars = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.withColumn("odd_chars", (chars >= MIN_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE))
    d = d.withColumn("group", F.when(F.col("ref_common").isNull(), "-").otherwise(F.concat(F.lit("="), "lang"))).withColumn("length", F.floor(F.log2(F.greatest(F.lit(1), F.col("n_words")))).cast("int"))
    d = materialize(d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "odd_chars", "group", "length"), "distances")
    limits = materialize(word_limits(d), "limits")
    for_all = limits.where("length = -1").select("group", F.col("limit").alias("_of_group"))
    for_any = limits.where("group = '*'").agg(F.max("limit").alias("_of_any"))
    of_any = F.lit(for_any.first()["_of_any"]).cast("double")
    d = _beside(_beside(d, limits, ["group", "length"]), for_all, ["group"])
    limit = F.coalesce("limit", "_of_group", F.when(F.col("group") != "-", of_any)) / F.sqrt("n_words")
    strange = F.col("odd_chars") | ((F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > F.coalesce(limit, F.lit(MAX_WORD_DISTANCE))))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~strange).alias("kept"), "char_distance", "word_distance")
