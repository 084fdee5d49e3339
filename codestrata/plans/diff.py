"""The whole comparison of two snapshots: matches, changes, differences, intents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import classify, intent, linediff, matching
from ..sources.stage import settle, stage

_FIELDS = ["sym_id", "kind", "name", "qualified_name", "file_path", "line_start", "line_end", "signature", "visibility", "parameters", "return_type", "body_hash"]
_CROSS = {"ExactBody": "Moved", "NameAndBody": "MovedAndModified", "SimilarBody": "MovedAndModified", "Extracted": "Extracted", "Inlined": "Inlined"}


def _struct(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col("sym_id").alias(f"{name}_id"), F.struct(*_FIELDS).alias(name))


def matched_pairs(matches: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    return matches.join(_struct(old, "old"), "old_id").join(_struct(new, "new"), "new_id")


def changes(old: DataFrame, new: DataFrame, mode: str = "full", cross: bool = True) -> DataFrame:
    """phase, kind, old, new (structs, null where absent), confidence."""
    return settle(lambda: _every(old, new, mode, cross))


def _every(old: DataFrame, new: DataFrame, mode: str, cross: bool) -> DataFrame:
    within = matching.match_within(old, new, mode)
    # matches hang on normalised bodies only
    o, n = (stage(matching.unmatched(x.drop("body_text"), within, w)) for x, w in ((old, "old"), (new, "new")))
    own = matched_pairs(within, old, new).where(~classify.unchanged()).select(F.lit(0).alias("phase"), classify.change_kind().alias("kind"), "old", "new", "confidence")
    parts = [own]
    if cross:
        found = matching.match_across(o, n, mode)
        parts.append(matched_pairs(found, old, new).select(F.lit(1).alias("phase"), classify.one_of(F.col("match_type"), _CROSS).alias("kind"), "old", "new", "confidence"))
        o, n = matching.unmatched(o, found, "old"), matching.unmatched(n, found, "new")
    null = lambda c: F.lit(None).cast(own.schema[c].dataType)
    parts.append(_struct(o, "old").select(F.lit(2).alias("phase"), F.lit("Deleted").alias("kind"), "old", null("new").alias("new"), F.lit(1.0).alias("confidence")))
    parts.append(_struct(n, "new").select(F.lit(3).alias("phase"), F.lit("Added").alias("kind"), null("old").alias("old"), "new", F.lit(1.0).alias("confidence")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def numbered(every: DataFrame) -> DataFrame:
    """Changes with sequential ids from 0, by phase, then path, line and symbol. For reports: ids need one order over all changes."""
    order = [F.col("phase"), F.coalesce("new.file_path", "old.file_path"), F.coalesce("new.line_start", "old.line_start"), F.coalesce("new.sym_id", "old.sym_id"), F.coalesce("old.sym_id", F.lit(-1))]
    keys = [c.alias(f"_{i}") for i, c in enumerate(order)]
    dealt = every.select("*", *keys).repartitionByRange(*(f"_{i}" for i in range(len(order)))).sortWithinPartitions(*(f"_{i}" for i in range(len(order))))
    placed = stage(dealt.drop(*(f"_{i}" for i in range(len(order)))).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    before, sizes = 0, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row for each partition
        sizes += [F.lit(r["part"]), F.lit(before)]
        before += r["count"]
    offset = F.create_map(*sizes)[part] if sizes else F.lit(0)
    return placed.withColumn("id", (offset + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_at")


def with_details(every: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes with their signature delta, body_diff, description, file_info, name and intent. Bodies are fetched for changed pairs only."""
    return _with_intent(settle(lambda: _with_lines(every, old, new)))


def _with_lines(every: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    bodies = lambda df, s: df.select(F.col("sym_id").alias(f"_{s}"), F.col("body_text").alias(f"_{s}_text"), F.col("normalized_body").alias(f"_{s}_norm"), F.col("ast_fingerprint").alias(f"_{s}_print"))
    differs = F.col("old.body_hash") != F.col("new.body_hash")
    # only bodies that differ are looked at: those of pairs are fetched before they meet the changes
    pairs = stage(every.where(differs).select(F.col("old.sym_id").alias("_o"), F.col("new.sym_id").alias("_n")).distinct(), "pairs")
    mine = settle(lambda: bodies(old, "o").join(pairs, "_o"), "bodies")
    texts = settle(lambda: mine.join(bodies(new, "n"), "_n"), "bodies", instead=mine)
    d = every.withColumn("_o", F.when(differs, F.col("old.sym_id"))).withColumn("_n", F.when(differs, F.col("new.sym_id"))).join(texts, ["_o", "_n"], "left")
    d = d.withColumn("lines", F.when(differs, linediff.body_diff("_o_text", "_n_text")))
    delta = classify.signature_delta(F.col("old.parameters"), F.col("new.parameters"), F.col("old.return_type"), F.col("new.return_type"))
    d = d.withColumn("delta", F.when(F.col("kind") == "SignatureChanged", delta))
    kind, o, n = F.col("kind"), F.col("old"), F.col("new")
    d = d.withColumn("name", classify.symbol_name(o, n)).withColumn("file_info", classify.file_info(o, n)).withColumn("description", classify.description(kind, o, n, F.col("delta")))
    lines = F.coalesce("lines", F.expr(f"cast(array() AS {linediff.LINES})"))
    structure = text.structural_similarity("_o_norm", "_n_norm", "_o_print", "_n_print")
    d = d.withColumn("_structure", structure).withColumn("_text", text.body_similarity("_o_norm", "_n_norm"))
    added, removed = intent.changed_lines(lines, "Insert"), intent.changed_lines(lines, "Delete")
    equal = F.size(F.filter(lines, lambda x: x["tag"] == "Equal"))
    d = d.withColumn("_added", added).withColumn("_removed", removed).withColumn("_equal", equal)
    return d.drop("_o", "_n", *(f"_{s}_{c}" for s in "on" for c in ("text", "norm", "print")))


def _with_intent(d: DataFrame) -> DataFrame:
    kind, has = F.col("kind"), F.col("lines").isNotNull()
    differs = F.col("old.body_hash") != F.col("new.body_hash")
    lined = [(i, w, has & h, s) for i, w, h, s in intent.line_rules(F.col("_added"), F.col("_removed"), F.col("_equal"))]
    rules = [
        *intent.structural_rules(kind, F.col("delta")), *lined, *intent.name_rules(F.col("name"), kind, F.col("delta")),
        *intent.similarity_rules(differs, F.col("_structure"), F.col("_text")),
    ]
    d = intent.classify(d, rules)
    return d.drop(*(c for c in d.columns if c.startswith("_")))


def diff(old: DataFrame, new: DataFrame, mode: str = "full") -> DataFrame:
    def details() -> DataFrame:
        o, n = stage(old, "old"), stage(new, "new")
        return _with_lines(numbered(changes(o, n, mode)), o, n)

    return _with_intent(settle(details))
