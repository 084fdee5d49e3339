"""Pieces of SQL shared by the operators that run on the JVM alone. Their time grows with the text and the matches (times the
logarithm of the matches), never with the square."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bound, running

SPAN = "struct<start:int,end:int,match:string,before:string>"
CONTEXT = 24
#: Code points of a block of a text, within which a place is looked up from the block's start.
BLOCK = 4096
#: Items walked over with one growing array: aggregate() copies its state at each step.
CHUNK = 128


def walk(items: Column, at: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str, end: Callable[[Column], Column]) -> Column:
    """Walks over an array with a state: step(state, item) gives the next state and an array of kind to append. All that was
    appended, and end(last state). In chunks, as the state is copied at each step."""
    none = F.expr(f"cast(array() AS array<{kind}>)")

    def inner(acc: Column, x: Column) -> Column:
        state, more = step(acc["at"], x)
        return F.struct(state.alias("at"), F.concat(acc["out"], more).alias("out"))

    def outer(acc: Column, own: Column) -> Column:
        def put(part: Column) -> Column:
            return F.struct(part["at"].alias("at"), F.concat(acc["out"], part["out"]).alias("out"))

        return bound(F.aggregate(own, F.struct(acc["at"].alias("at"), none.alias("out")), inner), put)

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda i: F.slice(items, i * CHUNK + 1, CHUNK))
    walked = F.aggregate(chunks, F.struct(at.alias("at"), none.alias("out")), outer, lambda acc: F.concat(acc["out"], end(acc["at"])))
    return F.when(F.size(items) > 0, walked).otherwise(none)


def matches(text: Column, pattern: str, when: Column | None = None) -> Column:
    """The leftmost non-overlapping matches of a Java pattern that never matches the empty string: an array of
    SPAN in code points, end exclusive, with up to CONTEXT characters before each.

    The pieces between matches come from split(), the matches from regexp_extract_all(); places are their running lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    none = F.expr(f"cast(array() AS array<{SPAN}>)")
    both = F.zip_with(found, pieces, lambda m, p: F.struct(m.alias("match"), F.length(m).alias("own"), (F.length(p) + F.coalesce(F.length(m), F.lit(0))).alias("both"), F.right(p, F.lit(CONTEXT)).alias("before")))

    def placed(all_: Column) -> Column:
        return bound(running(F.transform(all_, lambda x: x["both"]), lambda a, b: a + b), lambda ends: F.transform(
            F.slice(all_, 1, F.size(all_) - 1),  # after the last match there is a piece without one
            lambda x, i: F.struct((F.get(ends, i) - x["own"]).alias("start"), F.get(ends, i).alias("end"), x["match"].alias("match"), x["before"].alias("before")),
        ))

    hit = text.rlike(pattern) if when is None else when & text.rlike(pattern)
    return F.when(hit, bound(both, placed)).otherwise(none)


def kind_spans(found: Column, kind: str, order: int) -> Column:
    """Spans as sortable structs (start, order, end, kind)."""
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind in the listed order, comma-joined."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def replaced(text: Column, blocks: Column, spans: Column) -> Column:
    """The text with each span (start, end, kind; by start) replaced by its kind in brackets; of overlapping ones the first's stands for
    all. blocks: the text in blocks()."""

    def between(start: Column, end: Column) -> Column:
        first = F.floor(start / BLOCK).cast("int")
        whole = F.array_join(F.slice(blocks, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
        return F.when(end > start, F.substring(whole, start - first * BLOCK + 1, end - start)).otherwise("")

    def put(reach: Column) -> Column:
        """reach: the greatest end of each span and those before it."""
        pieces = F.transform(spans, lambda s, i: bound(F.coalesce(F.get(reach, i - 1), F.lit(0)), lambda at: F.when(s["start"] >= at, F.concat(between(at, s["start"]), F.lit("["), s["kind"], F.lit("]"))).otherwise("")))
        return F.concat(F.array_join(pieces, ""), between(F.element_at(reach, -1), F.length(text)))

    return F.when(F.size(spans) > 0, bound(running(F.transform(spans, lambda s: s["end"]), F.greatest), put)).otherwise(text)


def blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    odd = F.split(F.reverse(number), "")
    total = F.aggregate(
        F.transform(odd, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))),
        F.lit(0),
        lambda a, d: a + d,
    )
    return total % 10 == 0
