"""Call graph reachability, impact on callers, warnings and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stage import stage

HOT = 1024


def edges(refs: DataFrame) -> DataFrame:
    """caller, callee, file_path, line of every call reference."""
    return refs.select("caller", "callee", "file_path", "line")


def callers_of(names: DataFrame, calls: DataFrame) -> DataFrame:
    """names: name. The edges into each name, or where there are none into its last :: segment: name, caller, file_path, line."""
    exact = names.join(calls, F.col("name") == F.col("callee")).select("name", "caller", "file_path", "line")
    left = names.join(calls.select(F.col("callee").alias("name")), "name", "left_anti")
    short = left.withColumn("_s", F.substring_index("name", "::", -1)).where("_s <> name")
    return exact.unionByName(short.join(calls, F.col("_s") == F.col("callee")).select("name", "caller", "file_path", "line"))


def _into(starts: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges into each name that a search can come to, as node, caller, file_path, line and salt; and the nodes whose edges are over 1 / HOT of all,
    fewer than HOT, with how many parts these are dealt to."""
    names = starts.select("name").unionByName(calls.select(F.col("caller").alias("name"))).distinct()
    edges = stage(callers_of(names, calls).withColumnRenamed("name", "node"), "edges")
    degree = stage(edges.groupBy("node").agg(F.count("*").alias("n")), "degrees")
    every = degree.agg(F.sum("n")).first()[0] or 0
    hubs = degree.where(F.col("n") * HOT > every).select("node", F.ceil(F.col("n") * HOT / F.lit(max(every, 1))).cast("int").alias("parts"))
    dealt = edges.join(F.broadcast(hubs), "node", "left").withColumn("salt", F.pmod(F.xxhash64("caller", "file_path"), F.coalesce("parts", F.lit(1))).cast("int"))
    return dealt.drop("parts"), hubs


def _met(frontier: DataFrame, edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """frontier (node, ...) with the edges into its nodes; a hub's are met in parts."""
    parts = frontier.join(F.broadcast(hubs), "node", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return parts.join(edges, ["node", "salt"]).drop("salt")


def _reached(starts: DataFrame, edges: DataFrame, hubs: DataFrame, depth: int) -> DataFrame:
    """node, depth, chunk, bits: which starts come to a node first at which depth. starts: name, id; 64 of them are the bits of one long.

    A breadth-first search of all starts at once: a row a node and chunk, whatever number of starts."""
    flags = starts.select(F.col("name").alias("node"), F.shiftright("id", 6).alias("chunk"), F.expr("shiftleft(1L, cast(id & 63 AS int))").alias("bits"))
    frontier = stage(flags.groupBy("node", "chunk").agg(F.bit_or("bits").alias("bits")), "frontier")
    seen, found = frontier, frontier.withColumn("depth", F.lit(0))
    pairs = edges.select("node", "salt", "caller").distinct()
    for d in range(1, depth + 1):
        came = _met(frontier, pairs, hubs).groupBy(F.col("caller").alias("node"), "chunk").agg(F.bit_or("bits").alias("bits"))
        old = seen.select("node", "chunk", F.col("bits").alias("old"))
        fresh = came.join(old, ["node", "chunk"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))).where("bits <> 0")
        frontier = stage(fresh.select("node", "chunk", "bits"), "frontier")
        seen = stage(seen.unionByName(frontier).groupBy("node", "chunk").agg(F.bit_or("bits").alias("bits")), "seen") if d < depth else seen
        found = found.unionByName(frontier.withColumn("depth", F.lit(d)))
    return found


def _starts(changed: DataFrame, calls: DataFrame) -> DataFrame:
    """name, id of the distinct names that have callers, numbered densely enough to fill their longs."""
    names = changed.select("name").distinct()
    called = stage(callers_of(names, calls.select("caller", "callee", "file_path", "line")).select("name").distinct(), "starts")
    n = called.count()
    return stage(called.coalesce(max(1, n // 65_536)).withColumn("id", F.monotonically_increasing_id()), "starts")


def _ids(chunk: Column, bits: Column) -> Column:
    """The starts of a long, a row each."""
    return F.explode(F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(bits, i) == 1), lambda i: F.shiftleft(chunk, 6) + i))


def transitive_callers(changed: DataFrame, calls: DataFrame, depth: int = 2) -> DataFrame:
    """changed: name. Edges reached within depth steps back from each name, at the least depth of their callee:
    name, callee, caller, file_path, line, depth. A name's direct call of itself is left out."""
    calls = stage(calls, "calls")
    starts = _starts(changed, calls)
    edges, hubs = _into(starts, calls)
    edges = stage(edges, "edges")
    nodes = _reached(starts, edges, hubs, depth).select("node", "depth", _ids(F.col("chunk"), F.col("bits")).alias("id"))
    found = _met(nodes.join(starts, "id").select("name", "node", "depth"), edges, hubs).where("depth > 0 OR caller <> node")
    return found.select("name", F.col("node").alias("callee"), "caller", "file_path", "line", "depth")


def transitive_callers_dfs(changed: DataFrame, calls: DataFrame, depth: int = 2) -> DataFrame:
    """The same by depth-first search in the edges' order (line, caller, file), whose depths are those of the first visit. Each start's neighbourhood is found
    breadth-first and searched in one group.

    A caller that nobody calls ends a path and leaves the order of the others as it is, and of the edges between two names the last one decides. So a group holds
    names that are called and one edge for two of them; the edges themselves come in once the visits are known, as in transitive_callers."""
    calls = stage(calls, "calls")
    starts = _starts(changed, calls)
    edges, hubs = _into(starts, calls)
    edges = stage(edges, "edges")
    called = edges.select(F.col("node").alias("caller")).distinct()
    # nulls are the last, as in the order of the search
    inner = edges.groupBy("node", "caller").agg(F.max(F.struct(F.col("line").isNull().alias("none"), "line"))["line"].alias("line")).join(called, "caller", "left_semi")
    inner = stage(inner, "inner")
    reached = stage(_reached(starts, edges, hubs, depth).select("node", "depth", _ids(F.col("chunk"), F.col("bits")).alias("id")), "reached")
    near = reached.where(F.col("depth") < depth).join(inner, "node").select("id", "node", "caller", "line")
    own = reached.where("depth = 0").select("id", "node", F.lit(None).cast("string").alias("caller"), F.lit(None).cast(dict(near.dtypes)["line"]).alias("line"))

    def search(key, pdf):
        start = pdf.loc[pdf["caller"].isna(), "node"].iloc[0]
        pdf = pdf[pdf["caller"].notna()].sort_values(["line", "caller"], kind="stable")
        into = {k: g.tolist() for k, g in pdf.groupby("node")["caller"]}
        seen, stack = {}, [(start, 0)]
        while stack:
            node, d = stack.pop()
            if node not in seen:
                seen[node] = d
                if d < depth:
                    stack += [(caller, d + 1) for caller in into.get(node, ())]
        return type(pdf)({"id": key[0], "node": list(seen), "depth": list(seen.values())})

    visits = stage(near.unionByName(own).groupBy("id").applyInPandas(search, "id long, node string, depth int"), "visits")
    found = _met(visits.join(starts, "id").select("name", "node", "depth"), edges, hubs).where("depth > 0 OR caller <> node")
    return found.select("name", F.col("node").alias("callee"), "caller", "file_path", F.col("line").cast("long").alias("line"), "depth")


def affected_callers(changes: DataFrame, calls: DataFrame, depth: int = 2) -> DataFrame:
    """changes: name, description, risk. One row per caller, file and changed name: the one of least depth, then line.

    Starts stay packed until each has its edge: those that an edge of a caller in a file is the first to have, by depth and line, are what no edge
    before it has."""
    calls = stage(calls, "calls")
    starts = _starts(changes, calls)
    edges, hubs = _into(starts, calls)
    edges = stage(edges, "edges")
    met = _met(_reached(starts, edges, hubs, depth), edges, hubs).where("depth > 0 OR caller <> node")
    place = ["caller", "file_path", "chunk"]
    steps = met.groupBy(*place, "depth", "line").agg(F.bit_or("bits").alias("bits"))
    before = Window.partitionBy(*place).orderBy("depth", "line").rowsBetween(Window.unboundedPreceding, -1)
    first = steps.withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or("bits").over(before), F.lit(0).cast("long"))))).where("bits <> 0")
    rows = first.select("caller", "file_path", "line", "depth", _ids(F.col("chunk"), F.col("bits")).alias("id")).join(starts, "id")
    level = F.when(F.col("depth") == 0, F.col("risk")).when(F.col("risk") == "High", "Medium").otherwise("Low")
    said = rows.join(changes.select("name", "description", "risk"), "name").groupBy("caller", "file_path", "line", "depth", "name").agg(F.min(F.struct(F.col("description").alias("change_description"), level.alias("risk"))).alias("_f"))
    return said.select(F.col("caller").alias("caller_symbol"), F.col("file_path").alias("caller_file"), F.col("line").alias("caller_line"), F.col("name").alias("changed_callee"), "_f.change_description", "_f.risk", "depth")


def pattern_warnings(similar: DataFrame) -> DataFrame:
    """similar: changed_symbol, similar_symbol, file_path, line_start, line_end, similarity, kind."""
    # fixed values: the wording of the warnings
    s, changed, other = F.col("similarity"), F.col("changed_symbol"), F.col("similar_symbol")
    message = (
        F.when(F.col("kind") == "ExactDuplicate", F.concat(F.lit("Exact duplicate of '"), changed, F.lit("' exists but was not changed")))
        .when((F.col("kind") == "StructurallySimilar") & (s > 0.7), F.concat(F.lit("'"), other, F.lit("' is "), F.round(s * 100).cast("int").cast("string"), F.lit("% similar to changed '"), changed, F.lit("' - may need the same update")))
        .when((F.col("kind") == "NamePattern") & (s > 0.5), F.concat(F.lit("'"), other, F.lit("' follows the same naming pattern as '"), changed, F.lit("' - verify consistency")))
    )
    return similar.select(message.alias("message"), "changed_symbol", other.alias("related_symbol"), "file_path", "line_start", "line_end", "similarity").where("message IS NOT NULL")


def class_warnings(unchanged: DataFrame) -> DataFrame:
    """unchanged: changed_symbol, changed, unchanged (counts of a class of equal bodies). One warning a class, however many its pairs."""
    message = F.concat(F.col("unchanged").cast("string"), F.lit(" exact duplicates of '"), "changed_symbol", F.lit("' were not changed"))
    return unchanged.select("changed_symbol", "changed", "unchanged", message.alias("message"))


def scanned(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: the symbols and calls that an analysis saw."""
    one = F.lit(1).alias("_1")
    s, c = symbols.agg(F.count("*").alias("total_repo_symbols")), calls.agg(F.count("*").alias("call_graph_edges"))
    return s.withColumn("_1", one).join(c.withColumn("_1", one), "_1").drop("_1")


def risk_summary(callers: DataFrame, similar: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row of totals and risk levels."""
    n = lambda level: F.count_if(F.col("risk") == level)
    c = callers.agg(F.count("*").alias("total_affected_callers"), n("High").alias("high_risk_count"), n("Medium").alias("medium_risk_count"), n("Low").alias("low_risk_count"))
    s = similar.agg(F.count("*").alias("total_similar_code"))
    w = warnings.agg(F.count("*").alias("total_pattern_warnings"))
    one = F.lit(1).alias("_1")  # single rows, joined on a constant
    return c.withColumn("_1", one).join(s.withColumn("_1", one), "_1").join(w.withColumn("_1", one), "_1").drop("_1")
