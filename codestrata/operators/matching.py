"""Matching of two snapshots of symbols, within files and across files.

Symbols are frames with sym_id (long, unique, in file order), kind, name, qualified_name, file_path, body_hash, normalized_body and
ast_fingerprint. Matches are frames of old_id, new_id, confidence and match_type.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import features, text
from ..sources.stage import settle, stage
from . import setjoin, textjoin

FUZZY_CAP, CONTAIN_CAP = 50_000, 100_000
#: Pairs that one task assigns; characters of an anchor by which contained bodies are looked up.
GREEDY_ROWS, ANCHOR = 200_000, 10
#: Hashes that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_MATCH = "old_id long, new_id long, confidence double, match_type string"
_BLOCK = 16  # bits of sym_id within a block of rank_in_group


def _first(mode: str) -> int | None:
    return textjoin.FIRST if mode == "compat" else None


def rank_in_group(df: DataFrame, keys: list[str], order: str, name: str = "rn") -> DataFrame:
    """The place of each row among the rows of equal keys, from 1, ordered by a unique long.

    Ranks are counted in blocks of at most 65536 values of the order and offset by the blocks before, so a hot key is spread."""
    blocked = df.withColumn("_block", F.shiftright(order, _BLOCK))
    sizes = blocked.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy(*keys, "_block").orderBy(order)
    ranked = blocked.withColumn("_rank", F.row_number().over(own)).join(offsets, [*keys, "_block"])
    return ranked.withColumn(name, F.col("_rank") + F.col("_before")).drop("_block", "_rank", "_before")


def side(df: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}_{'id' if c == 'sym_id' else c}") for c in ["sym_id", *columns]))


def unmatched(symbols: DataFrame, matches: DataFrame, which: str) -> DataFrame:
    """The symbols that no match uses; which: old or new."""
    return symbols.join(matches.select(F.col(f"{which}_id").alias("sym_id")), "sym_id", "left_anti")


def _by_rank(old: DataFrame, new: DataFrame, keys: list[str], confidence: Column, kind: str) -> DataFrame:
    """The n-th old symbol of a key with the n-th new one: what taking the first free one in order comes to."""
    o = rank_in_group(old.select("sym_id", *keys, F.col("body_hash").alias("_oh")), keys, "sym_id").withColumnRenamed("sym_id", "old_id")
    n = rank_in_group(new.select("sym_id", *keys, F.col("body_hash").alias("_nh")), keys, "sym_id").withColumnRenamed("sym_id", "new_id")
    return o.join(n, [*keys, "rn"]).select("old_id", "new_id", confidence.alias("confidence"), F.lit(kind).alias("match_type"))


def by_qualified_name(old: DataFrame, new: DataFrame) -> DataFrame:
    return _by_rank(old, new, ["file_path", "qualified_name"], F.when(F.col("_oh") == F.col("_nh"), 1.0).otherwise(0.95), "name")


def _by_body(old: DataFrame, new: DataFrame, keys: list[str], confidence: Column, kind: str) -> DataFrame:
    """_by_rank with the bodies' hashes among the keys, which are written once. Each is made of a whole body, and as a key of lazy rows it would be
    made four times: ranks read their rows twice, and a join filters its keys for nulls before it makes them."""
    keyed = [stage(x.select("sym_id", *keys, "body_hash"), "keyed").withColumn("body_key", F.col("body_hash")) for x in (old, new)]
    return _by_rank(*keyed, [*keys, "body_key"], confidence, kind)


def by_hash(old: DataFrame, new: DataFrame) -> DataFrame:
    return _by_body(old, new, ["file_path", "kind"], F.lit(0.9), "hash")


_BODY = ["kind", "name", "file_path", "normalized_body", "ast_fingerprint"]


def _similarity(threshold: Column | float, bodies: Column | None = None) -> Column:
    return text.structural_similarity("o_normalized_body", "n_normalized_body", "o_ast_fingerprint", "n_ast_fingerprint", threshold, bodies)


def fuzzy_candidates(old: DataFrame, new: DataFrame, first: int | None = None) -> DataFrame:
    """Pairs of a file and kind whose 0.4 * name + 0.6 * structure exceeds 0.5: old_id, new_id, score, o_file_path. first: the bytes of a body that are compared; None: whole bodies."""
    o, n = side(old, "o", _BODY), side(new, "n", _BODY)
    pairs = o.join(n, (F.col("o_file_path") == F.col("n_file_path")) & (F.col("o_kind") == F.col("n_kind")))
    pairs = pairs.withColumn("_name", text.name_similarity("o_name", "n_name"))
    threshold = F.greatest(0.5 - F.col("_name") * 0.4, F.lit(0.0)) / 0.6
    alike = None
    if first is None:
        a, b, x, y = (F.col(c) for c in ("o_normalized_body", "n_normalized_body", "o_ast_fingerprint", "n_ast_fingerprint"))
        longer, shorter = F.greatest(F.octet_length(a), F.octet_length(b)), F.least(F.octet_length(a), F.octet_length(b))
        asked = ((F.size(x) == 0) | (F.size(y) == 0)) & (a != b) & (shorter > 0) & (shorter / longer >= threshold)
        # few long texts a task, as each pair takes long
        dealt = pairs.repartition(8 * old.sparkSession.sparkContext.defaultParallelism, "o_id", "n_id")
        pairs = dealt.withColumn("_edits", textjoin.edits(*(F.when(asked, F.encode(c, "UTF-8")) for c in (a, b)), F.when(asked, F.floor((1 - threshold) * longer))))
        alike = F.when(F.col("_edits") >= 0, 1 - F.col("_edits") / longer).otherwise(0.0)
    return pairs.select(F.col("o_id").alias("old_id"), F.col("n_id").alias("new_id"), text.over(F.col("_name") * 0.4 + _similarity(threshold, alike) * 0.6, 0.5).alias("score"), "o_file_path")


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["score", "old_id", "new_id"], ascending=[False, True, True])
    used_old, used_new, keep = set(), set(), []
    for o, n in zip(pdf["old_id"], pdf["new_id"], strict=True):
        ok = o not in used_old and n not in used_new
        keep.append(ok)
        if ok:
            used_old.add(o)
            used_new.add(n)
    return pdf.loc[keep, ["old_id", "new_id", "score"]]


def _best_free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs sorted by group, the best first, those of which neither symbol is taken. Holds the symbols taken in one group."""
    group, used_old, used_new = (), set(), set()
    for rb in batches:
        keep = []
        for at, (g, o, n) in enumerate(zip(*(rb.column(c).to_pylist() for c in ("group", "old_id", "new_id")), strict=True)):
            if (g,) != group:
                group, used_old, used_new = (g,), set(), set()
            if o not in used_old and n not in used_new:
                used_old.add(o)
                used_new.add(n)
                keep.append(at)
        yield rb.select(["old_id", "new_id", "score"]).take(pa.array(keep, pa.int64()))


def greedy_assignment(candidates: DataFrame, group: str) -> DataFrame:
    """One-to-one pairs by score, then old, then new id, in each group of candidates (old_id, new_id, score). For groups such as files.

    Sorted pairs are read as a stream, many groups in a batch; they are dealt by number, as few bytes would make one task of them."""
    n = candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = candidates.select(F.col(group).alias("group"), "old_id", "new_id", "score").repartition(int(n), "group").sortWithinPartitions("group", F.desc("score"), "old_id", "new_id")
    return dealt.mapInArrow(_best_free, "old_id long, new_id long, score double")


def greedy_pairs(candidates: DataFrame) -> DataFrame:
    """The same over all candidates, however many. A pair that is the best of both its symbols is taken, whatever the rest; its symbols' other
    pairs go, and so on. What is left is finished in one task as soon as it is at most GREEDY_ROWS pairs."""
    left, found = stage(candidates.select("old_id", "new_id", "score")), None
    while left.count() > GREEDY_ROWS:
        rank = F.struct((-F.col("score")).alias("_s"), "old_id", "new_id")
        best = [left.groupBy(c).agg(F.min(rank).alias("_b")).select("_b.old_id", "_b.new_id") for c in ("old_id", "new_id")]
        taken = stage(left.join(best[0], ["old_id", "new_id"]).join(best[1], ["old_id", "new_id"]))
        found = taken if found is None else found.unionByName(taken)
        left = stage(left.join(taken.select("old_id"), "old_id", "left_anti").join(taken.select("new_id"), "new_id", "left_anti"))
    rest = left.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(lambda pdf: _greedy(pdf), "old_id long, new_id long, score double")
    return rest if found is None else found.unionByName(rest)


def match_within(old: DataFrame, new: DataFrame, mode: str = "full") -> DataFrame:
    """Three phases in files: equal qualified names, equal bodies, then similar ones one-to-one. compat: by the first bytes of bodies."""

    def phases() -> DataFrame:
        first = settle(lambda: by_qualified_name(old, new))
        o, n = unmatched(old, first, "old"), unmatched(new, first, "new")
        second = settle(lambda: by_hash(o, n))
        o, n = unmatched(o, second, "old"), unmatched(n, second, "new")
        third = greedy_assignment(fuzzy_candidates(o, n, _first(mode)), "o_file_path").select("old_id", "new_id", F.col("score").alias("confidence"), F.lit("similar").alias("match_type"))
        return first.unionByName(second).unionByName(third)

    return settle(phases)


def moved_exact(old: DataFrame, new: DataFrame) -> DataFrame:
    """Equal bodies and kinds in other files. Inputs are left over from match_within, which leaves a body of a file on one side
    only, so that pairing by rank meets the demand for different files."""
    return _by_body(old, new, ["kind"], F.lit(0.95), "ExactBody")


def _first_free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs sorted by group, old_id and preference, what each old symbol in turn takes: the first new one that is free. Holds the new symbols
    taken in one group, no pairs."""
    group, used, done = None, set(), None
    for rb in batches:
        keep = []
        for at, (g, o, n) in enumerate(zip(*(rb.column(c).to_pylist() for c in ("group", "old_id", "new_id")), strict=True)):
            if g != group:
                group, used, done = g, set(), None
            if o != done and n not in used:
                used.add(n)
                done = o
                keep.append(at)
        yield rb.select(["old_id", "new_id", "score"]).take(pa.array(keep, pa.int64()))


def name_candidates(old: DataFrame, new: DataFrame, first: int | None = None) -> DataFrame:
    """Pairs of a name and kind in different files with structural similarity over 0.5."""
    return similar_candidates(old, new, 0.5, ("kind", "name"), first)


def moved_by_name(old: DataFrame, new: DataFrame, first: int | None = None) -> DataFrame:
    """Equal names and kinds in other files with similar bodies: each old symbol in order takes the best free new one, of equals the first.

    A name's pairs are sorted, which spills, and read as a stream, so a name that stands everywhere makes no group."""
    pairs = name_candidates(old, new, first).repartition("group").sortWithinPartitions("group", "old_id", F.desc("score"), "new_id")
    found = pairs.select("group", "old_id", "new_id", "score").mapInArrow(_first_free, "old_id long, new_id long, score double")
    return found.select("old_id", "new_id", (F.col("score") * 0.9).alias("confidence"), F.lit("NameAndBody").alias("match_type"))


def similar_candidates(old: DataFrame, new: DataFrame, least: float = 0.7, keys: tuple[str, ...] = ("kind",), first: int | None = None) -> DataFrame:
    """Pairs of equal keys in different files with structural similarity over least, as old_id, new_id, score, group (the keys): of fingerprints (a set-similarity join, whatever the bodies' lengths),
    of bodies where one has none (the first bytes of each, or whole ones), and equal bodies."""
    group = F.when(reduce(Column.__and__, (F.col(k).isNotNull() for k in keys)), F.concat_ws("\0", *keys)).alias("group")
    o, n = (stage(x.select("sym_id", group, "file_path", "normalized_body", "ast_fingerprint", (F.coalesce(F.size("ast_fingerprint"), F.lit(0)) <= 0).alias("bare")), "left") for x in (old, new))
    have = [{not r.bare for r in x.select("bare").distinct().collect()} for x in (o, n)]  # a row or two
    same = [x.select(F.col("sym_id").alias(i), "group", F.sha2("normalized_body", 256).alias("_body")) for x, i in ((o, "old_id"), (n, "new_id"))]
    found = same[0].join(same[1], ["group", "_body"]).select("old_id", "new_id", F.lit(1.0).alias("score"))
    if False in have[0] | have[1]:
        found = found.unionByName(textjoin.similar_bodies(o, n, least, first))
    if True in have[0] & have[1]:
        sets = [x.select(F.col("sym_id").alias("id"), "group", F.col("ast_fingerprint").alias("tokens")) for x in (o, n)]
        found = found.unionByName(setjoin.similar_sets(*sets, least).select(F.col("l_id").alias("old_id"), F.col("r_id").alias("new_id"), F.col("similarity").alias("score")))
    found = found.groupBy("old_id", "new_id").agg(F.max("score").alias("score"))  # a pair with equal bodies comes twice
    place = lambda df, p: side(df, p, ["group", "file_path"])
    placed = found.join(place(o, "o").withColumnRenamed("o_id", "old_id"), "old_id").join(place(n, "n").withColumnRenamed("n_id", "new_id"), "new_id")
    return placed.where("o_file_path <> n_file_path").select("old_id", "new_id", "score", F.col("o_group").alias("group"))


def _anchors_met(outer: DataFrame, inner: DataFrame, width: int, among: int) -> DataFrame:
    """Pairs outer_id, inner_id that may contain: each inner body is looked up by its rarest anchor of width characters among the outer
    bodies' (an equi-join), if all of its anchors stand somewhere."""
    hashes = features.anchors(width, among)
    own = stage(inner.select("inner_id", hashes("_i").alias("_keys")).select("inner_id", F.size("_keys").alias("_all"), F.explode("_keys").alias("key")), "anchors")
    asked = stage(own.select("key").distinct(), "anchors")
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    # the outer bodies' anchors are made once, and few are kept where few are asked for
    keyed = stage(outer.select("outer_id", F.explode(hashes("_o")).alias("key")).join(asked, "key", "left_semi"), "anchors")
    times = keyed.groupBy("key").agg(F.count("*").alias("_n"))
    rarest = own.join(times, "key").groupBy("inner_id", "_all").agg(F.count("*").alias("_met"), F.min(F.struct("_n", "key")).alias("_r")).where("_met = _all")
    return keyed.join(rarest.select("inner_id", F.col("_r.key").alias("key")), "key").select("outer_id", "inner_id")


def _contained(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Pairs outer_id, inner_id of which outer's body holds inner's, at least 50 and 20 bytes, in a ratio over 0.15."""
    o = outer.where(F.octet_length("normalized_body") >= 50).select(F.col("sym_id").alias("outer_id"), F.col("normalized_body").alias("_o"))
    i = inner.where(F.octet_length("normalized_body") >= 20).select(F.col("sym_id").alias("inner_id"), F.col("normalized_body").alias("_i"))
    pairs = _anchors_met(o, i.where(F.length("_i") >= 20), ANCHOR, 20 - ANCHOR + 1)
    short = i.where(F.length("_i") < 20)  # of wide characters: 20 bytes are five at least
    if short.limit(1).count():
        pairs = pairs.unionByName(_anchors_met(o, short, 5, 1))
    found = pairs.join(o, "outer_id").join(i, "inner_id")
    return found.where(F.contains(F.col("_o"), F.col("_i")) & (F.octet_length("_i") / F.octet_length("_o") > 0.15)).select("outer_id", "inner_id")


def extracted(old: DataFrame, new: DataFrame) -> DataFrame:
    """New bodies that stand in an old body; each new symbol once, with the first old one."""
    pairs = _contained(old, new).groupBy(F.col("inner_id").alias("new_id")).agg(F.min("outer_id").alias("old_id"))
    return pairs.select("old_id", "new_id", F.lit(0.7).alias("confidence"), F.lit("Extracted").alias("match_type"))


def inlined(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old bodies that stand in a new body; every such pair."""
    pairs = _contained(new, old)
    return pairs.select(F.col("inner_id").alias("old_id"), F.col("outer_id").alias("new_id"), F.lit(0.65).alias("confidence"), F.lit("Inlined").alias("match_type"))


def match_across(old: DataFrame, new: DataFrame, mode: str = "full") -> DataFrame:
    """Five phases over what match_within left. full: always all of them, on whole bodies; compat: the costly ones are skipped beyond their
    caps, and the first bytes of bodies are compared."""

    def over(a: DataFrame, b: DataFrame, cap: int) -> bool:
        return mode == "compat" and a.count() * b.count() > cap

    def left(o: DataFrame, n: DataFrame, matches: DataFrame, again: bool = True) -> list[DataFrame]:
        """What matches leave over, in place of o and n if these were staged here."""
        return [settle(lambda x=x, w=w: unmatched(x, matches, w), instead=x if again else None) for x, w in ((o, "old"), (n, "new"))]

    def phases() -> DataFrame:
        found = settle(lambda: moved_exact(old, new))
        o, n = left(old, new, found, False)
        named = settle(lambda: moved_by_name(o, n, _first(mode)))
        found = found.unionByName(named)
        o, n = left(o, n, named)
        if not over(o, n, FUZZY_CAP):
            picked = lambda: greedy_pairs(similar_candidates(o, n, first=_first(mode)))
            fuzzy = settle(lambda: picked().select("old_id", "new_id", (F.col("score") * 0.85).alias("confidence"), F.lit("SimilarBody").alias("match_type")))
            found = found.unionByName(fuzzy)
            o, n = left(o, n, fuzzy)
        size = lambda x, least: x.where(F.octet_length("normalized_body") >= least)
        if not over(size(o, 50), size(n, 20), CONTAIN_CAP):
            taken = settle(lambda: extracted(o, n))
            found = found.unionByName(taken)
            n = settle(lambda n=n: unmatched(n, taken, "new"), instead=n)
        if not over(size(o, 20), size(n, 50), CONTAIN_CAP):
            found = found.unionByName(inlined(o, n))
        return found

    return settle(phases)
