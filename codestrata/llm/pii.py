"""Personal data by candidate gradient boosting, on the JVM alone.

1. High-recall generators, several for a kind, propose overlapping spans of each kind. Spans of the base patterns are always taken, and
   proposals that overlap one of them are part of it.
2. Each candidate has FEATURES: numbers that describe its format (digits, separators, checks) and its context (words before it).
3. One model of boosted trees for all kinds scores the candidates; a candidate is taken from its kind's calibrated threshold on.
4. Of taken candidates that overlap, whatever their kind, the best scored stays (from left to right; a tie is the first's).

The trees are grown here, from TRAINING_ROWS labelled examples (a bounded sample): the executors draw a form and a context for each
from the tables below, fill in digits and letters, and turn it into candidates with their features by the same columns that
documents go through. The driver gets these few rows and fits trees to one half; the other half sets each kind's threshold: the
lowest score from which on at least PRECISION of the examples are personal data.

Defined cases: a null text is empty; repeated rows give a row each, and equal results; an empty table gives none; columns other than
doc_id and text are ignored by detect() and carried by redact(), whatever their names; a text of any length is read whole, in time linear
in its length and its matches; equal scores are a tie as said above.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import native
from .common import text_or_empty

KINDS = ("email", "ip", "card", "phone")
TRAINING_ROWS = 16_384
PRECISION = 0.98
TREES, RATE, DEPTH = 40, 0.3, 3

# Possessive quantifiers and look-behinds give the plain patterns' matches in linear time. \G lets a match follow the last one.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART, _HEX = "[0-9]{1,3}", "[0-9A-Fa-f]{1,4}"
#: Kind and pattern. Patterns of a kind overlap, and so do cards and phones.
GENERATORS = (
    ("email", rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+\x20?(?:@|\[at\]|\(at\)|\{{at\}})\x20?[A-Za-z0-9-]{{1,63}}+(?:\x20?(?:\.|\[dot\]|\(dot\)|\{{dot\}})\x20?[A-Za-z0-9-]{{1,63}}+){{1,4}}+"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+\x20at\x20[A-Za-z0-9-]{2,63}+(?:\x20dot\x20[A-Za-z]{2,24}+){1,3}+"),
    ("ip", rf"(?<![0-9A-Fa-f:.]){_PART}(?:(?:\[\.\]|\(\.\)|\.){_PART}){{3}}(?![0-9A-Fa-f:])"),
    ("ip", rf"(?<![0-9A-Za-z:.])(?:{_HEX}:){{7}}{_HEX}(?![0-9A-Za-z:])"),
    ("ip", rf"(?<![0-9A-Za-z:.]){_HEX}(?::{_HEX}){{0,6}}::(?:{_HEX}(?::{_HEX}){{0,6}})?(?![0-9A-Za-z:])"),
    ("card", r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}[0-9]){12,18}(?![0-9])"),
    ("card", r"(?<![0-9A-Za-z])[0-9]{4}[^0-9A-Za-z\s]{1,2}[0-9]{4,6}[^0-9A-Za-z\s]{1,2}[0-9]{4,5}(?:[^0-9A-Za-z\s]{1,2}[0-9]{4})?(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z])(?:00|\(?0|\(?[1-9])[0-9]{0,4}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,8}\)?){1,5}(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z])0[0-9]{8,13}(?![0-9A-Za-z])"),
)
# Words before personal data of each kind, before numbers that aren't, and others.
NEAR = {
    "email": ("mail", "e-mail", "contact", "write to", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login from", "addr"),
    "card": ("card", "visa", "credit", "debit", "pay by", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telefon", "call", "mobile", "fax", "cell", "ruf", "appel", "llama"),
}
AGAINST = ("order", "invoice", "version", "isbn", "issn", "art", "no", "nr", "id", "ref", "page", "years", "chapter", "section", "score", "part", "lot")
NEUTRAL = ("the", "and then", "with", "aaaaa", "we saw", "und", "der", "que", "les", "about", "aaa aaaa")
# Examples; 9 stands for any digit, X for any letter from a to f.
# Kind, 1 personal data (a card with a Luhn sum), 2 personal data after one of the kind's words only, 0 not; form.
FORMS = (
    ("email", 1, "XXXX.XXX [at] XXXXXX [dot] XXX"), ("email", 1, "XXXXXX(at)XXXXXX(dot)XXX"), ("email", 1, "XXXX99 [at] XXXX.XXX"), ("email", 1, "XXX{at}XXXXX{dot}XX"),
    ("email", 1, "X.XXXXX[at]XXXX-XXX.XX"), ("email", 1, "XXX_XX (at) XXXXX [dot] XX [dot] XX"), ("email", 2, "XXXXXX at XXXXXXX dot XXX"), ("email", 2, "XXXX.XXX at XXXXX dot XX dot XX"),
    ("email", 0, "XXXXX @ XXXX . XXXX"), ("email", 0, "XX @ XXXXXX. XXXXX"), ("email", 0, "99 @ 9.99"), ("email", 0, "XXX @XXXXX. XX"), ("email", 0, "XXXX@ XXXX.XXXX XXX"), ("email", 0, "XXX at XXXX dot XXXXXXXXXXXXX"),
    ("ip", 1, "99[.]99[.]9[.]99"), ("ip", 1, "9(.)99(.)99(.)9"), ("ip", 1, "199[.]99.99.9"), ("ip", 1, "99X9:9XX9:99X9:XX99:9999:99XX:X999:9X9X"), ("ip", 1, "XX99::9X:9"), ("ip", 1, "fe80::XX99:9Xff:fe99:9X9X"), ("ip", 1, "9X9X:X99::"),
    ("ip", 0, "999.999.999.999"), ("ip", 0, "999.9.9.999"), ("ip", 0, "XX::XX"), ("ip", 0, "9::9"), ("ip", 0, "999[.]999[.]999[.]999"),
    ("card", 1, "9999.9999.9999.9999"), ("card", 1, "9999/9999/9999/9999"), ("card", 1, "9999_9999_9999_9999"), ("card", 1, "4999.999999.99999"), ("card", 1, "5999*9999*9999*9999"), ("card", 1, "9999. 9999. 9999. 9999"),
    ("card", 0, "999.9.99.999999.9"), ("card", 0, "9999999999999"), ("card", 0, "9999.99.99.999999"), ("card", 0, "9999999999999999"), ("card", 0, "99.999.999.999.999"), ("card", 0, "9.9.9.9.9.9.9.9.9.9.9.9.9.9"), ("card", 0, "1999/99/99/999999"), ("card", 0, "99/99/9999 99/99/9999"),
    ("phone", 1, "(0999) 999999"), ("phone", 2, "0999/999999"), ("phone", 2, "0999-9999999"), ("phone", 1, "00999 999 9999"), ("phone", 2, "099 999 99 99"), ("phone", 1, "(999) 999-9999"), ("phone", 2, "999-999-9999"), ("phone", 2, "09999 999999"), ("phone", 2, "09999999999"),
    ("phone", 2, "0999.99.99.99"), ("phone", 0, "1999-1999"), ("phone", 0, "999-9999-99"), ("phone", 0, "99 999"), ("phone", 0, "2999-09-19"), ("phone", 0, "99 99"), ("phone", 0, "99.99.1999"), ("phone", 0, "999 999"), ("phone", 0, "9.999.999"), ("phone", 0, "99/99/99"), ("phone", 0, "9999 9999 9999"),
)
FEATURES = ("kind", "form", "near", "against", "digits", "length", "marks", "mark_kinds", "luhn", "lead", "zero", "bracket", "year", "shape", "octets", "letters")
DESCRIBED = "struct<start:int,cand:int,end:int,order:int,x:array<int>>"
PICKED = "struct<start:int,cand:int,end:int,order:int,score:double>"


def _ends_in(words: tuple[str, ...]) -> str:
    return rf"(?i)(?<![A-Za-z])(?:{'|'.join(words)})\W*$"


def _passes(kind: str, m: Column) -> Column:
    """The base check of a match."""
    d = native.digits(m)
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.length(d).between(14, 19) & native.luhn(d)
    if kind == "phone":
        return F.length(d).between(10, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    when = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind)
    return F.filter(native.matches(text, BASE[kind], when), lambda x: _passes(kind, x["match"]))


def candidates(text: Column, form: int) -> Column:
    kind, pattern = GENERATORS[form]
    when = {0: F.contains(text, F.lit("@")) | text.rlike(r"at[\])}]"), 1: F.contains(text, F.lit(" dot ")), 4: F.contains(text, F.lit("::"))}.get(form)
    return native.matches(text, pattern, when)


def features(form: int, x: Column) -> Column:
    """The features of a candidate (match, before) as an array of whole numbers, in the order of FEATURES."""
    kind = GENERATORS[form][0]
    m, before = x["match"], x["before"]
    d, marks = native.digits(m), F.regexp_replace(m, "[A-Za-z0-9]+", "")
    shape = F.when(m.rlike(r"^[0-9]{4}([^0-9]{1,2})[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"), 1).when(m.rlike(r"^[0-9]{4}[^0-9]{1,2}[0-9]{6}[^0-9]{1,2}[0-9]{5}$"), 2).when(m.rlike(r"^([0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}|[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2})\b"), 3).when(m.rlike(r"\.[A-Za-z]{2,6}$|dot.?\x20?[A-Za-z]{2,6}$"), 4).otherwise(0)
    values = {
        "kind": F.lit(KINDS.index(kind)), "form": F.lit(form), "near": before.rlike(_ends_in(NEAR[kind])).cast("int"), "against": before.rlike(_ends_in(AGAINST)).cast("int"),
        "digits": F.least(F.length(d), F.lit(40)), "length": F.least(F.length(m), F.lit(80)), "marks": F.least(F.length(marks), F.lit(20)), "mark_kinds": F.size(F.array_distinct(F.split(marks, ""))),
        "luhn": F.when(F.length(d).between(13, 19), native.luhn(d).cast("int")).otherwise(0), "lead": F.coalesce(F.substring(d, 1, 1).try_cast("int"), F.lit(-1)), "zero": m.rlike(r"^\(?0").cast("int"),
        "bracket": m.rlike(r"\[(at|dot|\.)\]|\((at|dot|\.)\)|\{(at|dot)\}").cast("int") + 2 * m.rlike(r"^\([0-9]+\)").cast("int"), "year": m.rlike(r"(?<![0-9])(1[89]|20)[0-9]{2}(?![0-9])").cast("int"), "shape": shape,
        "octets": m.rlike(r"(?<![0-9A-Fa-f])([3-9][0-9]{2}|2[6-9][0-9]|25[6-9])(?![0-9A-Fa-f])").cast("int"), "letters": F.least(F.length(F.regexp_replace(m, "[^A-Za-z]+", "")), F.lit(40)),
    }
    return F.array(*(values[k].cast("int") for k in FEATURES))


def described(found: Column, form: int) -> Column:
    """Candidates as start, cand, end, order and x, their features."""
    order = F.lit(KINDS.index(GENERATORS[form][0]))
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("cand"), x["end"].alias("end"), order.alias("order"), features(form, x).alias("x")))


def _values(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM VALUES {', '.join(str(r) for r in rows)} AS t({names})"


def examples(spark: SparkSession, rows: int = TRAINING_ROWS) -> DataFrame:
    """id, kind, label, text: forms in contexts, filled with pseudo-random digits and letters."""
    forms = spark.sql(_values([(n, *f) for n, f in enumerate(FORMS)], "n, kind, sort, form"))
    pick = lambda words, salt: F.get(F.array(*map(F.lit, words)), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))).cast("int"))
    d = spark.range(rows).withColumn("n", F.pmod(F.xxhash64("id"), F.lit(len(FORMS)))).join(F.broadcast(forms), "n")
    near = reduce(lambda a, k: F.when(F.col("kind") == k, pick(NEAR[k], 3)).otherwise(a), KINDS, F.lit(""))
    context = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(3))
    d = d.select("id", "kind", "sort", context.alias("context"), F.when(context == 0, near).when(context == 1, pick(AGAINST, 4)).otherwise(pick(NEUTRAL, 5)).alias("word"), "form", pick((" ", ": ", " "), 6).alias("gap"), pick((" and so on", ".", ", as said", " aaa"), 7).alias("tail"))
    draw = lambda i: F.pmod(F.xxhash64("id", i), F.lit(2600))
    fill = F.transform(F.split("form", ""), lambda c, i: F.when(c == "9", (draw(i) % 10).cast("string")).when(c == "X", F.char(97 + draw(i) % 6)).otherwise(c))
    luhn = (F.col("kind") != "card") | native.luhn(native.digits("_f"))
    label = ((F.col("sort") == 1) & ~((F.col("context") == 1) & F.col("kind").isin("card", "phone")) | (F.col("sort") == 2) & (F.col("context") == 0)) & luhn
    return d.withColumn("_f", F.array_join(fill, "")).select("id", "kind", label.cast("int").alias("label"), F.concat("word", "gap", "_f", "tail").alias("text"))


class Trees:
    """Boosted regression trees of the logistic loss, and each kind's threshold."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE, depth: int = DEPTH):
        self.trees: list = []
        self.limits = dict.fromkeys(KINDS, math.inf)
        self._cuts = [np.unique(x[:, f])[:-1] for f in range(x.shape[1])] if len(x) else []
        score = np.zeros(len(x))
        for _ in range(trees if len(x) else 0):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(x)), depth, rate)
            self.trees.append(tree)
            score += self._of(tree, x)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, own: np.ndarray, level: int, rate: float) -> tuple:
        total_g, total_h = g[own].sum(), h[own].sum()
        best = (total_g**2 / (total_h + 1) + 1e-6, None)
        for f, cuts in enumerate(self._cuts if level else ()):
            for c in cuts:
                low = own[x[own, f] <= c]
                if 0 < len(low) < len(own):
                    a, b = g[low].sum(), h[low].sum()
                    gain = a**2 / (b + 1) + (total_g - a) ** 2 / (total_h - b + 1)
                    if gain > best[0]:
                        best = (gain, (f, int(c), low))
        if best[1] is None:
            return (float(rate * total_g / (total_h + 1)),)
        f, c, low = best[1]
        return f, c, self._grow(x, g, h, low, level - 1, rate), self._grow(x, g, h, np.setdiff1d(own, low), level - 1, rate)

    def _of(self, node: tuple, x: np.ndarray) -> np.ndarray:
        if len(node) == 1:
            return np.full(len(x), node[0])
        low = x[:, node[0]] <= node[1]
        out = np.empty(len(x))
        out[low], out[~low] = self._of(node[2], x[low]), self._of(node[3], x[~low])
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sum((self._of(t, x) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float) -> None:
        """Sets each kind's threshold: the lowest score from which on enough of the rows are positive."""
        score = self.scores(x)
        for k, kind in enumerate(KINDS):
            own = x[:, 0] == k
            s, good = score[own], y[own]
            values = np.unique(s)[::-1]
            for v in values[values > 0]:
                if good[s >= v].mean() >= precision:
                    self.limits[kind] = float(v) - 1e-9

    def column(self, x: Column) -> Column:
        """The score of an array of features."""

        def of(node: tuple) -> Column:
            if len(node) == 1:
                return F.lit(node[0])
            return F.when(F.get(x, F.lit(node[0])) <= node[1], of(node[2])).otherwise(of(node[3]))

        return reduce(add, map(of, self.trees), F.lit(0.0))

    def taken(self, found: Column) -> Column:
        """Of described candidates those that reach their kind's threshold, as PICKED."""
        limits = F.array(*(F.lit(float(self.limits[k])) for k in KINDS))
        scored = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["cand"].alias("cand"), x["end"].alias("end"), x["order"].alias("order"), self.column(x["x"]).alias("score")))
        return F.filter(scored, lambda x: x["score"] >= F.get(limits, x["order"]))


def fit(spark: SparkSession, rows: int = TRAINING_ROWS, precision: float = PRECISION) -> Trees:
    made = examples(spark, rows)
    none = F.expr(f"cast(array() AS array<{DESCRIBED}>)")
    own = [F.when(F.col("kind") == kind, described(candidates(F.col("text"), form), form)).otherwise(none) for form, (kind, _) in enumerate(GENERATORS)]
    found = made.select("label", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)) == 0).alias("grow"), F.explode(F.concat(*own)).alias("x")).select("label", "grow", "x.x")
    # equal examples as one with their number: at most a few of each of the rows
    got = found.groupBy("label", "grow", "x").count().orderBy("grow", "label", "x").collect()
    x, y, n, grow = (np.array(c) for c in ([r["x"] for r in got], [r["label"] for r in got], [r["count"] for r in got], [r["grow"] for r in got]))
    each = lambda own: (np.repeat(x[own], n[own], 0), np.repeat(y[own], n[own]))
    model = Trees(*each(grow))
    model.calibrate(*each(~grow), precision)
    return model


def _apart(base: Column, picked: Column) -> Column:
    """Taken candidates (PICKED) that overlap no base span, and of those that overlap each other the best scored. Both by start."""
    as_item = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("cand"), b["end"].alias("end"), b["order"].alias("order"), F.lit(0.0).alias("score")))
    none = F.expr(f"cast(array() AS array<{PICKED}>)")

    far = 2147483647

    def after(every: Column) -> Column:
        """Without candidates that a base span from before their start reaches into."""
        reach = native.running(F.transform(every, lambda x: F.when(x["cand"] == 0, x["end"]).otherwise(-1)), F.greatest)
        return native.bound(reach, lambda r: F.filter(every, lambda x, i: (x["cand"] == 0) | (x["start"] >= F.get(r, i))))

    def before(back: Column) -> Column:
        """Of spans from last to first the candidates that end before the next base span."""
        bound = native.running(F.transform(back, lambda x: F.when(x["cand"] == 0, x["start"]).otherwise(far)), F.least)
        return native.bound(bound, lambda b: F.filter(back, lambda x, i: (x["cand"] == 1) & (x["end"] <= F.get(b, i))))

    def best(last: Column, x: Column) -> tuple[Column, Column]:
        apart = x["start"] >= last["end"]
        return F.when(apart | (x["score"] > last["score"]), x).otherwise(last), F.when(apart & (last["cand"] == 1), F.array(last)).otherwise(none)

    free = F.reverse(native.bound(F.reverse(native.bound(F.sort_array(F.concat(as_item, picked)), after)), before))
    start = F.expr(f"cast(named_struct('start', -1, 'cand', 0, 'end', -1, 'order', 0, 'score', 0.0D) AS {PICKED})")
    kept = native.bound(free, lambda f: native.walk(f, start, best, PICKED, lambda last: F.when(last["cand"] == 1, F.array(last)).otherwise(none)))
    return F.when(F.size(picked) > 0, kept).otherwise(none)


def _spans(d: DataFrame, text: Column, model: Trees | None) -> DataFrame:
    """d with _base_<kind>, _base and _spans: sorted arrays of start, order, end, kind."""
    model = model or fit(d.sparkSession)
    d = d.select("*", *(native.kind_spans(base_spans(text, k), k, i).alias(f"_base_{k}") for i, k in enumerate(KINDS)))
    d = d.withColumn("_base", F.sort_array(F.concat(*(f"_base_{k}" for k in KINDS))))
    forms = [described(candidates(text, form), form) for form, (kind, _) in enumerate(GENERATORS) if model.limits[kind] < math.inf]
    d = d.withColumn("_found", F.concat(*forms) if forms else F.expr(f"cast(array() AS array<{DESCRIBED}>)"))
    d = d.withColumn("_picked", F.array_sort(model.taken(F.col("_found"))))
    kinds = F.array(*map(F.lit, KINDS))
    more = F.transform(_apart(F.col("_base"), F.col("_picked")), lambda x: F.struct(x["start"].alias("start"), x["order"].alias("order"), x["end"].alias("end"), F.get(kinds, x["order"]).alias("kind")))
    return d.withColumn("_spans", F.sort_array(F.concat("_base", more)))


def detect(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, spans_list (array of start, order, end, kind)."""
    d = _spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_t")), F.col("_t"), model)
    return d.select(
        "doc_id", *(F.size(f"_base_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(native.joined(F.col("_base")), 256).alias("base_sha256"), native.joined(F.col("_spans")).alias("spans"), F.col("_spans").alias("spans_list"),
    )


def redact(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """docs with each span of text replaced by its kind in brackets; overlapping spans become one. A null text stays null."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    d = _spans(docs.select(row, text_or_empty().alias("_t")), F.col("_t"), model).withColumn("_blocks", F.when(F.size("_spans") > 0, native.blocks(F.col("_t"))))
    new = F.when(F.size("_spans") > 0, native.replaced(F.col("_t"), F.col("_blocks"), F.col("_spans"))).otherwise(F.col("_row.text"))
    return d.select(*(new.alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
