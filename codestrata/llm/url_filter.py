"""URL filter: rules for places, and for the rest the ratio of two character language models, one of accepted and one of rejected URLs.

A URL's text is its host and path in lower case, each run of digits as one 0. Every distinct text of the table counts once, so a host with a third of the rows teaches
no more than its distinct paths. A text is an example of rejected ones if its host has a word of REJECTED between dots and hyphens (distant labels), of none if it has one of at least WITHIN
letters inside another word, which is left to the models to judge, else of accepted ones. A quarter of the sites, by a digest, is held out.

The models are Markov models of variable order: the probability of a character after up to ORDER - 1 others is interpolated with that
after one less, down to the uniform one, by Witten and Bell's weights (counts of different successors). Counts, probabilities and log ratios are tables,
one row for each distinct run of characters, built level by level; they grow with the table's URLs and are never gathered or broadcast.
A text's score is its sum of log ratios (rejected against accepted) by its length; the threshold is the one with the least
errors on the held-out sites, the share of accepted texts that are blocked counting FALSE_COST times that of rejected ones that are missed, in the middle between the two scores around it.

Joins on runs of characters and on texts meet hot keys (a run that all URLs have, a text of a third of the rows): runs that are over 1 / HOT of
all are joined by broadcasting them (there are fewer than HOT), and texts over 1 / SALTS of the rows are salted.

Defined cases: a null url is an empty text, with a score of 0; an empty text has no host, no path, and is allowed; where no site or no held-out site is of one class, the
threshold is 0, and where nothing is learned of one class, all is allowed, as where no threshold is better than none; of rules that fit the longest
wins (host and path together, then the host's length), block before allow; a null page_id is carried; repeated rows are judged each; an empty table gives no rows; a url of any length is
read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


class Rule(NamedTuple):
    """Fits its host and all subdomains, if the path starts with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Fixed values of the contract
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

#: Words of hosts that mark an example of a rejected URL.
REJECTED = ("ads", "adult", "bet", "bets", "betting", "bingo", "casino", "dating", "escort", "gambling", "jackpot", "lottery", "pharmacy", "pills", "poker", "porn", "replica", "roulette", "sex", "slots", "torrent", "viagra", "warez", "xxx")
WITHIN = 5
#: Characters of the longest run: a character and the four before it.
ORDER, PAD = 5, "\x02"
HOT, SALTS = 4096, 1024
#: Scores are compared in hundredths, within +-WIDEST of them; log ratios are summed in billionths, so that sums don't hang on the order.
BINS, WIDEST, UNIT = 100, 2000, 1_000_000_000
FALSE_COST = 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first ://, in lower case, and the path after it; both empty without one."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*+", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*+([^?#]*+)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The winning rule as a struct of name and verdict; null where none fits."""
    order = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.verdict != "block"))
    fits = [((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path) for r in order]
    return F.coalesce(*(F.when(f, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))) for f, r in zip(fits, order, strict=True)))


def model_text(url: Column) -> Column:
    host, path = host_and_path(url)
    whole = F.when(F.instr(url, "://") > 0, F.concat(host, path)).otherwise(F.regexp_extract(url, "^[^?#]*+", 0))
    return F.regexp_replace(F.translate(F.coalesce(whole, F.lit("")), _UPPER, _LOWER), "[0-9]+", "0")


def distant_label(site: Column) -> Column:
    """true: rejected, false: accepted, null: not an example."""
    inside = site.rlike("|".join(w for w in REJECTED if len(w) >= WITHIN))
    return F.when(site.rlike(f"(^|[.-])({'|'.join(REJECTED)})([.-]|$)"), True).when(~inside, False)


def _runs(texts: DataFrame) -> DataFrame:
    """Each character of each text with the ORDER - 1 before it, as one string; places before the start are PAD."""
    c = F.concat(F.array_repeat(F.lit(PAD), ORDER - 1), F.split("text", ""))
    # an array of characters: cutting strings at growing places would take square time
    return texts.withColumn("_c", c).withColumn("gram", F.explode(F.transform(F.sequence(F.lit(ORDER - 1), F.size("_c") - 1), lambda i: F.concat(*(F.col("_c")[i - k] for k in range(ORDER - 1, -1, -1)))))).drop("_c")


def gram_ratios(texts: DataFrame) -> DataFrame:
    """gram, n (occurrences) and ratio: the log of its last character's probability among rejected texts against that among accepted ones, in
    billionths. texts: text, rejected, held_out; those held out are not counted, but have their runs in the result."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    runs = _runs(texts.select("text", "rejected", "held_out")).groupBy("gram")
    counted = materialize(runs.agg(F.count("*").alias("n"), one(~F.col("held_out") & ~F.col("rejected")).alias("a"), one(~F.col("held_out") & F.col("rejected")).alias("r")), "url-runs")
    last = F.substring("gram", -1, 1)
    total = counted.agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.count_distinct(last).alias("letters")).first()
    if not total["a"] or not total["r"]:
        return counted.select("gram", "n", F.lit(0).cast("long").alias("ratio"))
    lower = None
    for k in range(1, ORDER + 1):
        level = counted if k == ORDER else counted.groupBy(F.substring("gram", -k, k).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        if k == 1:
            kinds = level.agg(one(F.col("a") > 0).alias("a"), one(F.col("r") > 0).alias("r")).first()
            seen = level.withColumns({f"{kind}{c}": F.lit(x) for c in "ar" for kind, x in (("n", total[c]), ("t", kinds[c]), ("low_", 1.0 / total["letters"]))})
        else:  # at most as many rows of a context, or of an ending, as there are characters
            context = Window.partitionBy(F.substring("gram", 1, k - 1))
            seen = level.withColumns({f"{kind}{c}": x.over(context) for c in "ar" for kind, x in (("n", F.sum(c)), ("t", one(F.col(c) > 0)))})
            seen = seen.withColumn("_end", F.substring("gram", -(k - 1), k - 1)).join(lower, "_end")
        chance = {f"low_{c}": F.when(F.col(f"n{c}") > 0, (F.col(c) + F.col(f"t{c}") * F.col(f"low_{c}")) / (F.col(f"n{c}") + F.col(f"t{c}"))).otherwise(F.col(f"low_{c}")) for c in "ar"}
        found = seen.withColumns(chance)
        lower = found.select(F.col("gram").alias("_end"), "low_a", "low_r")
    return found.select("gram", "n", F.round((F.log("low_r") - F.log("low_a")) * UNIT).cast("long").alias("ratio"))


def text_scores(texts: DataFrame, ratios: DataFrame) -> DataFrame:
    """texts (text_id, text, ...) with score, the mean log ratio of their characters, and bin, its hundredth."""
    every = ratios.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(ratios.where(F.col("n") * HOT > every).select("gram", "ratio"))  # fewer than HOT rows of ORDER characters
    runs = _runs(texts.select("text_id", "text")).select("text_id", "gram")
    rare = runs.join(hot.select("gram"), "gram", "left_anti").join(ratios.where(F.col("n") * HOT <= every).select("gram", "ratio"), "gram")
    sums = runs.join(hot, "gram").unionByName(rare).groupBy("text_id").agg((F.sum("ratio") / (F.count("*") * F.lit(float(UNIT)))).alias("score"))
    return texts.join(sums, "text_id").withColumn("bin", F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), F.floor(F.col("score") * BINS))).cast("int"))


def calibrated(scored: DataFrame) -> int | None:
    """The bin from which texts are blocked; None: none is. From at most 2 * WIDEST + 1 counted bins of the held-out texts."""
    counts = scored.where("held_out").groupBy("bin").agg(F.count_if(~F.col("rejected")).alias("a"), F.count_if("rejected").alias("r")).orderBy("bin").collect()
    accepted, rejected = (sum(x[c] for x in counts) for c in "ar")
    if not accepted or not rejected:
        return 0
    best, missed, passed, before = (1.0, None), 0, 0, None
    for x in counts:
        cost = missed / rejected + FALSE_COST * (accepted - passed) / accepted
        if cost <= best[0] and cost < 1:
            best = cost, (x["bin"] if before is None else (before + 1 + x["bin"]) // 2)
        missed, passed, before = missed + x["r"], passed + x["a"], x["bin"]
    return best[1]


def judge(urls: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule (null: none fits), verdict, score (of the models, above 0 for rejected ones), by_model (what they alone say)."""
    host, path = host_and_path(F.col("_url"))
    rows = urls.select(F.col(key).alias("_key"), F.col(url).cast("string").alias("_url")).select("_key", host.alias("host"), path.alias("path"), model_text(F.col("_url")).alias("text")).withColumn("_row", F.monotonically_increasing_id())
    site = F.regexp_extract("text", "^[^/]*+", 0)
    texts = rows.where("text <> ''").groupBy("text").agg(F.count("*").alias("rows")).select("text", "rows", distant_label(site).alias("rejected"), (F.md5(site) < "4").alias("held_out"), F.monotonically_increasing_id().alias("text_id"))
    texts = materialize(texts, "url-texts")
    ratios = materialize(gram_ratios(texts), "url-ratios")
    scored = materialize(text_scores(texts, ratios).select("text", "rows", "rejected", "held_out", "score", "bin"), "url-scores")
    least = calibrated(scored)
    every = scored.agg(F.sum("rows")).first()[0] or 0
    salts = F.ceil(F.col("rows") * SALTS / F.lit(max(every, 1))).cast("int")
    hot = F.broadcast(scored.where(F.col("rows") * SALTS > every).select(F.xxhash64("text").alias("_hash"), salts.alias("_salts")).groupBy("_hash").agg(F.max("_salts").alias("_salts")))  # fewer than SALTS rows of numbers
    salted = lambda df: df.withColumn("_hash", F.xxhash64("text")).join(hot, "_hash", "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    known = salted(scored.select("text", "score", "bin")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).select("text", "_salt", "score", "bin")
    met = salted(rows).withColumn("_salt", F.pmod("_row", "_salts").cast("int")).join(known, ["text", "_salt"], "left")
    by_model = F.when(F.coalesce(F.col("bin") >= F.lit(least), F.lit(False)), "block").otherwise("allow")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    return met.withColumn("_rule", rule).select(F.col("_key").alias(key), "host", "path", F.col("_rule.name").alias("rule"), F.coalesce("_rule.verdict", by_model).alias("verdict"), F.coalesce("score", F.lit(0.0)).alias("score"), by_model.alias("by_model"))
