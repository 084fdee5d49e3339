"""One query per operator over the driver's tables, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features, text
from ..operators import classify, extract, graph, intent, linediff, matching, similar, textjoin
from ..sources import index
from ..sources.stage import spread, stage
from . import diff, report, views
from .bindings import MATCH_SQL, NORMALIZE, SNAPSHOT_SQL, snapshots, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def r6(c) -> F.Column:
    return F.round(c, 6)


# Scalars


@query(f"SELECT doc_id, {NORMALIZE.format('text')} AS norm FROM documents")
def normalize_body(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.normalize_body("text").alias("norm"))


@query(f"SELECT doc_id, sha256({NORMALIZE.format('text')}) AS body_hash FROM documents")
def body_hash(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.body_hash(text.normalize_body("text")).alias("body_hash"))


@query("SELECT p_partkey, levenshtein(p_name, p_type) AS distance, least(levenshtein(p_name, p_type), 11) AS bounded FROM part")
def levenshtein(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", text.levenshtein("p_name", "p_type").cast("long").alias("distance"), text.levenshtein_bounded("p_name", "p_type", 10).cast("long").alias("bounded"))


_CUT = "substr({0}, 1, CASE WHEN strlen({0}) <= 1000 THEN length({0}) ELSE list_max(list_filter(range(250, 1001), lambda k: strlen(substr({0}, 1, k)) <= 1000)) END)"
_CMP = f"SELECT *, greatest(strlen(a), strlen(b)) AS m, CASE WHEN greatest(strlen(a), strlen(b)) > 1000 THEN {_CUT.format('a')} ELSE a END AS x, CASE WHEN greatest(strlen(a), strlen(b)) > 1000 THEN {_CUT.format('b')} ELSE b END AS y"
_WHOLE = "SELECT *, greatest(strlen(a), strlen(b)) AS m, a AS x, b AS y"
_SIM = "CASE WHEN a = b THEN 1.0 WHEN least(strlen(a), strlen(b)) = 0 THEN 0.0 WHEN least(strlen(a), strlen(b)) / m < {t} THEN 0.0 ELSE 1 - least(levenshtein(x, y), floor((1 - {t}) * m) + 1) / greatest(strlen(x), strlen(y)) END"


@query(f"WITH {SNAPSHOT_SQL}, p AS (SELECT o.sym_id, o.norm AS a, n.norm AS b FROM o JOIN n USING (sym_id)), c AS ({_CMP} FROM p) SELECT sym_id, round({_SIM.format(t=0.0)}, 6)::DOUBLE AS similarity FROM c")
def body_similarity(spark, sf_dir):
    o, n = snapshots(spark, sf_dir)
    p = o.select("sym_id", F.col("normalized_body").alias("a")).join(n.select("sym_id", F.col("normalized_body").alias("b")), "sym_id")
    return p.select("sym_id", r6(text.body_similarity("a", "b")).alias("similarity"))


@query("SELECT p_partkey, round(CASE WHEN p_name = p_type THEN 1.0 ELSE 1 - levenshtein(p_name, p_type) / greatest(strlen(p_name), strlen(p_type)) END, 6)::DOUBLE AS similarity FROM part")
def name_similarity(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", r6(text.name_similarity("p_name", "p_type")).alias("similarity"))


@query("SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6)::DOUBLE AS similarity FROM (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(p_type, ' ') AS b FROM part)")
def jaccard_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", r6(text.jaccard(F.split("p_name", " "), F.split("p_type", " "))).alias("similarity"))


@query("SELECT doc_id, len(list_distinct(list_transform(range(1, length(text) - 2), lambda i: substr(text, i, 4)))) AS n FROM documents")
def shingle_count(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(features.shingles("text")).cast("long").alias("n"))


@query(
    "WITH RECURSIVE s AS (SELECT n_nationkey, n_name, 0 AS i, 14695981039346656037::UHUGEINT AS h FROM nation UNION ALL SELECT n_nationkey, n_name, i + 1, "
    "(xor(h, ascii(substr(n_name, i + 1, 1))::UHUGEINT) * 1099511628211) % 18446744073709551616 FROM s WHERE i < length(n_name)) SELECT n_nationkey, h::VARCHAR AS hash FROM s WHERE i = length(n_name)"
)
def fnv1a(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", features.fnv1a_text("n_name").alias("hash"))


_LOW = "18446744073709551615::UHUGEINT"
_GRAMS = "list_distinct(list_transform(range(1, length(norm) - 2), lambda p: substr(norm, p, 4)))"
#: Signatures in SQL: FNV-1a over the bytes of each distinct gram, and the generator of the multipliers, in 128-bit arithmetic.
_SIGNATURES = (
    f"t AS MATERIALIZED (SELECT doc_id, lang, {NORMALIZE.format('text')} AS norm FROM documents), s AS MATERIALIZED (SELECT doc_id, CASE WHEN length(norm) < 4 THEN []::VARCHAR[] ELSE {_GRAMS} END AS grams FROM t), "
    "u AS (SELECT DISTINCT unnest(grams) AS g FROM s), b AS (SELECT g, hex(encode(g)) AS x FROM u), "
    f"f AS MATERIALIZED (SELECT g, list_reduce(list_transform(range(0, length(x) // 2), lambda i: ((instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)::UHUGEINT), lambda a, y: (xor(a, y) * 1099511628211::UHUGEINT) & {_LOW}, 14695981039346656037::UHUGEINT) AS h FROM b), "
    f"m(k, v) AS (SELECT 0, ({features._START}::UHUGEINT * {features._FACTOR}::UHUGEINT + {features._STEP}::UHUGEINT) & {_LOW} UNION ALL SELECT k + 1, (v * {features._FACTOR}::UHUGEINT + {features._STEP}::UHUGEINT) & {_LOW} FROM m WHERE k < {features.SIGNATURE - 1}), "
    f"w AS (SELECT g, k, ((h * v + v) & {_LOW})::UBIGINT AS y FROM f CROSS JOIN m), "
    "sig AS MATERIALIZED (SELECT s.doc_id, m.k AS position, coalesce(y, 18446744073709551615::UBIGINT)::VARCHAR AS value FROM s CROSS JOIN m LEFT JOIN (SELECT doc_id, k, min(y) AS y FROM (SELECT doc_id, unnest(grams) AS g FROM s) JOIN w USING (g) GROUP BY doc_id, k) z ON z.doc_id = s.doc_id AND z.k = m.k)"
)


@query(f"WITH RECURSIVE {_SIGNATURES} SELECT doc_id, position, value FROM sig")
def minhash_sig(spark, sf_dir):
    sig = docs(spark, sf_dir).select("doc_id", F.posexplode(features.minhash(text.normalize_body("text"))).alias("position", "value"))
    return sig.select("doc_id", "position", features.unsigned(F.col("value")).cast("string").alias("value"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split(replace(p_name, ' ', '_'), '_'), lambda x: x <> '') || [replace(p_name, ' ', '_')], lambda x: lower(x)))), ',') AS stems FROM part")
def name_stems(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.array_join(features.stems(F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))), ",").alias("stems"))


@query(r"""SELECT event_id, regexp_replace(props, '"(?:\\(?:.|\n)|[^"\\])*(?:"|\\?\z)|''(?:\\(?:.|\n)|[^''\\])*(?:''|\\?\z)|[0-9][0-9._]*', '_', 'g') AS stripped FROM events""")
def strip_literals(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.strip_literals("props").alias("stripped"))


@query("SELECT p_partkey, round(len(list_filter(a, lambda w: list_contains(b, w))) / greatest(len(a), len(b)), 6)::DOUBLE AS similarity FROM (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(p_type || ' ' || p_name || ' x', ' ') AS b FROM part)")
def line_similarity(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", r6(text.line_similarity("p_name", F.concat_ws(" ", "p_type", "p_name", F.lit("x")))).alias("similarity"))


@query(rf"WITH {SNAPSHOT_SQL} SELECT o.sym_id, regexp_replace(o.body, '[\s\x0B\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]', '', 'g') = regexp_replace(n.body, '[\s\x0B\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]', '', 'g') AS same FROM o JOIN n USING (sym_id)")
def formatting_only(spark, sf_dir):
    o, n = snapshots(spark, sf_dir)
    p = o.select("sym_id", F.col("body_text").alias("a")).join(n.select("sym_id", F.col("body_text").alias("b")), "sym_id")
    return p.select("sym_id", text.formatting_only("a", "b").alias("same"))


_CELLS = "string_split(l, chr(9))"


@query(
    f"SELECT page_id, array_to_string(list_transform(string_split(html, chr(10)), lambda l: array_to_string(list_transform(range(1, len({_CELLS})), lambda i: rpad({_CELLS}[i], CAST(length({_CELLS}[i]) // 4 + 1 AS INTEGER) * 4, ' ')), '') || {_CELLS}[len({_CELLS})]), chr(10)) AS expanded FROM pages"
)
def expand_tabs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.expand_tabs("html").alias("expanded"))


@query("SELECT page_id, CASE WHEN len(p) <= 3 THEN url ELSE array_to_string(p[-3:], '/') END AS short FROM (SELECT page_id, url, string_split(url, '/') AS p FROM pages)")
def shorten_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.shorten_path("url").alias("short"))


@query("SELECT page_id, array_to_string(list_transform(string_split(url, '/'), lambda x: lower(x)), '|') AS path_key FROM pages")
def path_order(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.path_key("url"), "|").alias("path_key"))


@query("SELECT page_id, url FROM pages WHERE NOT (regexp_matches(url, '^.*[13579]$') OR regexp_matches(url, '^https://.*/a.*$'))")
def exclude_glob(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(~text.excluded("url", ["*[13579]", "https://*/a*", "[bad"])).select("page_id", "url")


@query("SELECT page_id, regexp_extract(url, '\\.([^./]+)$', 1) AS ext, CASE regexp_extract(url, '\\.([^./]+)$', 1) WHEN 'rs' THEN 'rust' WHEN 'go' THEN 'go' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'tsx' WHEN 'svelte' THEN 'tsx' WHEN 'js' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'cjs' THEN 'javascript' WHEN 'py' THEN 'python' END AS language FROM pages")
def detect_language(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"\.([^./]+)$", 1).alias("ext"), text.language("url").alias("language"))


@query("SELECT p_partkey, a || ' -> ' || p_brand <> b || ' -> ' || p_brand AS differs FROM (SELECT p_partkey, p_brand, '(' || array_to_string(string_split(p_name, ' '), ', ') || ')' AS a, '(' || array_to_string(list_reverse(string_split(p_name, ' ')), ', ') || ')' AS b FROM part)")
def signature_differs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    params = lambda words: F.transform(words, lambda w: F.struct(w.alias("name"), F.lit(None).cast("string").alias("type_annotation")))
    a, b = params(F.split("p_name", " ")), params(F.reverse(F.split("p_name", " ")))
    return p.select("p_partkey", (text.normalized_signature(a, "p_brand") != text.normalized_signature(b, "p_brand")).alias("differs"))


# Matching


@query(f"WITH {MATCH_SQL} SELECT * FROM m1")
def within_qname_match(spark, sf_dir):
    return matching.by_qualified_name(*snapshots(spark, sf_dir)).drop("match_type")


@query(f"WITH {SNAPSHOT_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY file_path, norm, kind ORDER BY sym_id) AS rn FROM o), b AS (SELECT *, row_number() OVER (PARTITION BY file_path, norm, kind ORDER BY sym_id) AS rn FROM n) SELECT a.sym_id AS old_id, b.sym_id AS new_id, 0.9::DOUBLE AS confidence FROM a JOIN b USING (file_path, norm, kind, rn)")
def within_hash_match(spark, sf_dir):
    return matching.by_hash(*snapshots(spark, sf_dir)).drop("match_type")


def _left(spark, sf_dir):
    """The symbols that equal names and bodies within files leave over."""
    o, n = (stage(x, "snapshot") for x in snapshots(spark, sf_dir))
    first = stage(matching.by_qualified_name(o, n))
    o, n = matching.unmatched(o, first, "old"), matching.unmatched(n, first, "new")
    second = stage(matching.by_hash(o, n))
    return first.unionByName(second), matching.unmatched(o, second, "old"), matching.unmatched(n, second, "new")


_FUZZY = (
    f"p AS (SELECT ou.sym_id AS old_id, nu.sym_id AS new_id, ou.norm AS a, nu.norm AS b, CASE WHEN ou.name = nu.name THEN 1.0 ELSE 1 - levenshtein(ou.name, nu.name) / greatest(strlen(ou.name), strlen(nu.name)) END AS s FROM ou JOIN nu USING (file_path, kind)), "
    f"c AS ({_WHOLE}, greatest(0.5 - s * 0.4, 0) / 0.6 AS t FROM p), d AS (SELECT old_id, new_id, s * 0.4 + ({_SIM.format(t='t')}) * 0.6 AS score FROM c)"
)


@query(f"WITH {MATCH_SQL}, {_FUZZY} SELECT old_id, new_id, round(score, 6)::DOUBLE AS score FROM d WHERE score > 0.5")
def within_fuzzy_candidates(spark, sf_dir):
    _, o, n = _left(spark, sf_dir)
    return matching.fuzzy_candidates(o, n).select("old_id", "new_id", r6(F.col("score")).alias("score"))


@query()
def greedy_assignment(spark, sf_dir):
    _, o, n = _left(spark, sf_dir)
    return matching.greedy_assignment(matching.fuzzy_candidates(o, n), "o_file_path")


@query(f"WITH {MATCH_SQL} SELECT sym_id FROM ou")
def unmatched_old(spark, sf_dir):
    return _left(spark, sf_dir)[1].select("sym_id")


@query(f"WITH {MATCH_SQL} SELECT sym_id FROM nu")
def unmatched_new(spark, sf_dir):
    return _left(spark, sf_dir)[2].select("sym_id")


@query(f"WITH {MATCH_SQL} SELECT * FROM m3")
def moved_exact(spark, sf_dir):
    _, o, n = _left(spark, sf_dir)
    return matching.moved_exact(o, n).drop("match_type")


@query(
    f"WITH {MATCH_SQL}, p AS (SELECT ou3.sym_id AS old_id, nu3.sym_id AS new_id, ou3.norm AS a, nu3.norm AS b FROM ou3 JOIN nu3 USING (name, kind) WHERE ou3.file_path <> nu3.file_path), "
    f"c AS ({_CMP} FROM p), d AS (SELECT old_id, new_id, {_SIM.format(t=0.5)} AS score FROM c) SELECT old_id, new_id, round(score, 6)::DOUBLE AS score FROM d WHERE score > 0.5"
)
def moved_by_name_candidates(spark, sf_dir):
    _, o, n = _left(spark, sf_dir)
    found = stage(matching.moved_exact(o, n))
    o, n = matching.unmatched(o, found, "old"), matching.unmatched(n, found, "new")
    return matching.name_candidates(o, n, textjoin.FIRST).select("old_id", "new_id", r6(F.col("score")).alias("score"))


@query(
    f"WITH {MATCH_SQL}, p AS (SELECT ou3.sym_id AS old_id, nu3.sym_id AS new_id, ou3.norm AS a, nu3.norm AS b FROM ou3 JOIN nu3 USING (kind) WHERE ou3.file_path <> nu3.file_path), "
    f"c AS ({_WHOLE} FROM p), d AS (SELECT old_id, new_id, {_SIM.format(t=0.7)} AS score FROM c) SELECT old_id, new_id, round(score, 6)::DOUBLE AS score FROM d WHERE score > 0.7"
)
def moved_fuzzy_candidates(spark, sf_dir):
    return matching.similar_candidates(*_left_after_moves(spark, sf_dir)).select("old_id", "new_id", r6(F.col("score")).alias("score"))


def _printed(spark, sf_dir):
    """Two snapshots of the parts as functions with fingerprints: the 3-grams of a text of each, in which the new ones carry another number; bodies of other lengths."""
    p = spread(table(spark, sf_dir, "part"), "p_partkey")

    def of(number, body, name, path):
        chars = F.col("chars")  # a column of its own: within the lambda the text would be split again for each gram
        grams = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(chars) - 3), lambda i: (chars[i] * 65536 + chars[i + 1] * 256 + chars[i + 2]).cast("bigint")))
        split = p.withColumn("chars", F.transform(F.split(F.concat_ws(" ", "p_name", "p_type", F.col("p_brand"), number.cast("string")), ""), F.ascii))
        return split.select(F.col("p_partkey").alias("sym_id"), F.col("p_brand").alias("kind"), F.concat(F.lit(name), "p_partkey").alias("name"), F.concat(F.lit("src/"), path % 7).alias("file_path"), body.alias("normalized_body"), grams.alias("ast_fingerprint"))

    key = F.col("p_partkey")
    return of(key, F.concat("p_name", F.lit(" "), key.cast("string")), "f", key), of(key + 3, F.concat(F.repeat(F.concat("p_type", F.lit(" ")), F.lit(9)), key.cast("string")), "g", key + 1)


_PRINTS = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: ascii(substr({0}, i, 1))::BIGINT * 65536 + ascii(substr({0}, i + 1, 1)) * 256 + ascii(substr({0}, i + 2, 1))))"


@query(
    f"WITH s AS (SELECT p_partkey AS id, p_brand AS kind, p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_partkey AS a, p_name || ' ' || p_type || ' ' || p_brand || ' ' || (p_partkey + 3) AS b FROM part), "
    f"f AS (SELECT id, kind, {_PRINTS.format('a')} AS x, {_PRINTS.format('b')} AS y FROM s), "
    "j AS (SELECT o.id AS old_id, n.id AS new_id, len(list_intersect(o.x, n.y)) AS c, len(o.x) + len(n.y) AS z FROM f o JOIN f n ON o.kind = n.kind AND o.id % 7 <> (n.id + 1) % 7) SELECT old_id, new_id, round(c / (z - c), 6)::DOUBLE AS score FROM j WHERE c / (z - c) > 0.7"
)
def moved_fingerprint_candidates(spark, sf_dir):
    """Functions in other files with similar fingerprints, though names differ and bodies are of far lengths."""
    return matching.similar_candidates(*_printed(spark, sf_dir)).select("old_id", "new_id", r6(F.col("score")).alias("score"))


@query()
def moved_by_name(spark, sf_dir):
    _, o, n = _left(spark, sf_dir)
    found = stage(matching.moved_exact(o, n))
    # by the first bytes of bodies, as the SQL of moved_by_name_candidates has it; match_across compares whole ones
    return matching.moved_by_name(matching.unmatched(o, found, "old"), matching.unmatched(n, found, "new"), textjoin.FIRST).drop("match_type")


@query()
def cross_file_matches(spark, sf_dir):
    _, o, n = _left(spark, sf_dir)
    return matching.match_across(o, n)


def _containment(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("sym_id"), text.normalize_body("text").alias("normalized_body"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("sym_id"), text.normalize_body("text").alias("normalized_body"))
    return d, b


_HELD = f"WITH d AS (SELECT doc_id, {NORMALIZE.format('text')} AS x FROM documents), b AS (SELECT item_id, {NORMALIZE.format('text')} AS y FROM benchmark), p AS (SELECT * FROM d, b WHERE strlen(x) >= 50 AND strlen(y) >= 20 AND contains(x, y) AND strlen(y) / strlen(x) > 0.15)"


@query(_HELD + " SELECT min(doc_id) AS old_id, item_id AS new_id, 0.7::DOUBLE AS confidence FROM p GROUP BY item_id")
def extracted(spark, sf_dir):
    return matching.extracted(*_containment(spark, sf_dir)).drop("match_type")


@query(_HELD + " SELECT item_id AS old_id, doc_id AS new_id, 0.65::DOUBLE AS confidence FROM p")
def inlined(spark, sf_dir):
    d, b = _containment(spark, sf_dir)
    return matching.inlined(b, d).drop("match_type")


def _left_after_moves(spark, sf_dir):
    _, o, n = _left(spark, sf_dir)
    found = stage(matching.moved_exact(o, n))
    return matching.unmatched(o, found, "old"), matching.unmatched(n, found, "new")


@query(f"WITH {MATCH_SQL} SELECT sym_id, qualified_name FROM ou3")
def unmatched_old_after_moves(spark, sf_dir):
    """What equal names, equal bodies and exact moves leave over; the later phases may still match it."""
    return _left_after_moves(spark, sf_dir)[0].select("sym_id", "qualified_name")


@query(f"WITH {MATCH_SQL} SELECT sym_id, qualified_name FROM nu3")
def unmatched_new_after_moves(spark, sf_dir):
    return _left_after_moves(spark, sf_dir)[1].select("sym_id", "qualified_name")


def _changes(spark, sf_dir):
    return diff.changes(*(stage(x, "snapshot") for x in snapshots(spark, sf_dir)))


@query()
def deleted(spark, sf_dir):
    """What no phase matches."""
    return _changes(spark, sf_dir).where("kind = 'Deleted'").select("old.sym_id", "old.qualified_name")


@query()
def added(spark, sf_dir):
    return _changes(spark, sf_dir).where("kind = 'Added'").select("new.sym_id", "new.qualified_name")


# Classification

_KIND = "CASE WHEN o.name <> n.name THEN 'Renamed' WHEN o.visibility <> n.visibility THEN 'VisibilityChanged' ELSE 'BodyChanged' END"
_CHANGED = f"{MATCH_SQL}, k AS (SELECT old_id, new_id, {_KIND} AS kind FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2) m JOIN o ON o.sym_id = old_id JOIN n ON n.sym_id = new_id WHERE NOT (o.norm = n.norm AND o.name = n.name AND o.visibility = n.visibility))"


def _classified(spark, sf_dir):
    o, n = snapshots(spark, sf_dir)
    found, _, _ = _left(spark, sf_dir)
    return diff.matched_pairs(found, o, n).where(~classify.unchanged()).withColumn("kind", classify.change_kind())


@query(f"WITH {_CHANGED} SELECT old_id, new_id, kind, CASE kind WHEN 'Renamed' THEN 'REN' WHEN 'VisibilityChanged' THEN 'VIS' ELSE 'MOD' END AS label FROM k")
def classify_changes(spark, sf_dir):
    return _classified(spark, sf_dir).select("old_id", "new_id", "kind", report.label(F.col("kind")).alias("label"))


_ALL = f"{_CHANGED}, every AS (SELECT kind FROM k UNION ALL SELECT 'Moved' FROM m3 UNION ALL SELECT 'Deleted' FROM ou3 UNION ALL SELECT 'Added' FROM nu3)"


@query(
    f"WITH {_ALL} SELECT count(*) AS total_changes, count(*) FILTER (kind = 'Added') AS added, count(*) FILTER (kind = 'Deleted') AS deleted, count(*) FILTER (kind IN ('BodyChanged', 'VisibilityChanged')) AS modified, "
    "count(*) FILTER (kind = 'Renamed') AS renamed, count(*) FILTER (kind = 'Moved') AS moved, 0::BIGINT AS extracted, 0::BIGINT AS inlined, 0::BIGINT AS signature_changed FROM every"
)
def change_summary_exact(spark, sf_dir):
    """Counts after the phases that SQL can follow: equal names, equal bodies, exact moves."""
    _, o, n = _left(spark, sf_dir)
    moved = stage(matching.moved_exact(o, n))
    o, n = matching.unmatched(o, moved, "old"), matching.unmatched(n, moved, "new")
    of = lambda df, kind: df.select(F.lit(kind).alias("kind"))
    return classify.summary(_classified(spark, sf_dir).select("kind").unionByName(of(moved, "Moved")).unionByName(of(o, "Deleted")).unionByName(of(n, "Added")))


@query()
def change_summary(spark, sf_dir):
    """The counts of all changes, after all phases in files and across them."""
    return classify.summary(_changes(spark, sf_dir).select("kind"))


@query(
    "WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS a, list_reverse(string_split(p_name, ' ')) || [p_brand] AS b FROM part), c AS (SELECT *, list_filter(a, lambda x: list_contains(b, x)) AS k FROM p) "
    "SELECT p_partkey, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS n_added, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS n_removed, "
    "len(k) >= 2 AND list_transform(k, lambda x: list_position(a, x)) <> list_transform(k, lambda x: list_position(b, x)) AS reordered FROM c"
)
def signature_delta(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    params = lambda words: F.transform(words, lambda w: F.struct(w.alias("name"), F.lit(None).cast("string").alias("type_annotation")))
    a, b = params(F.split("p_name", " ")), params(F.concat(F.reverse(F.split("p_name", " ")), F.array("p_brand")))
    d = p.withColumn("d", classify.signature_delta(a, b, F.col("p_brand"), F.col("p_brand")))
    return d.select("p_partkey", F.size("d.params_added").cast("long").alias("n_added"), F.size("d.params_removed").cast("long").alias("n_removed"), F.col("d.params_reordered").alias("reordered"))


@query(
    "WITH c AS (SELECT doc_id AS id, 'd' || (doc_id % 50) || '_' || (doc_id // 500) AS name, doc_id % 3 = 0 AS x FROM documents), p AS (SELECT a.id, min(b.id) AS y FROM c a JOIN c b ON a.name = b.name AND a.id <> b.id WHERE a.x GROUP BY a.id) "
    "SELECT id, y AS related_id FROM p UNION ALL SELECT y, id FROM p"
)
def related_changes(spark, sf_dir):
    c = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "Extracted").otherwise("BodyChanged").alias("kind"), F.concat(F.lit("d"), F.col("doc_id") % 50, F.lit("_"), F.floor(F.col("doc_id") / 500)).alias("old_name"))
    return classify.related_changes(c)


# Differences and intent


def _edited(spark, sf_dir):
    o, n = snapshots(spark, sf_dir)
    p = o.select("sym_id", F.col("body_text").alias("a"), F.col("qualified_name").alias("q")).join(n.select("sym_id", F.col("body_text").alias("b"), "qualified_name"), "sym_id")
    return p.where("q = qualified_name AND a <> b")


@query(
    "WITH d AS (SELECT doc_id, text, CASE WHEN ends_with(text, chr(10)) OR text = '' THEN 0 ELSE 1 END AS open, len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) OR text = '' THEN 1 ELSE 0 END AS lines FROM documents WHERE doc_id % 5 = 0 AND doc_id % 10 <> 7) "
    "SELECT doc_id AS sym_id, lines - open AS n_equal, open::BIGINT AS n_delete, 1::BIGINT AS n_insert FROM d"
)
def line_diff(spark, sf_dir):
    d = _edited(spark, sf_dir).select("sym_id", linediff.body_diff("a", "b").alias("lines"))
    n = lambda tag: F.size(F.filter("lines", lambda x: x["tag"] == tag)).cast("long").alias(f"n_{tag.lower()}")
    return d.select("sym_id", n("Equal"), n("Delete"), n("Insert"))


@query(
    "WITH d AS (SELECT doc_id, text, CASE WHEN ends_with(text, chr(10)) OR text = '' THEN 0 ELSE 1 END AS open, len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) OR text = '' THEN 1 ELSE 0 END AS lines, "
    "len(string_split(regexp_replace(text, '\\n\\z', ''), chr(10))) AS own FROM documents WHERE doc_id % 5 = 0 AND doc_id % 10 <> 7) "
    "SELECT doc_id AS sym_id, (doc_id % 10) * 10 + 10 - greatest(own, 1) AS body_start, (doc_id % 10) * 10 + 10 - greatest(own, 1) + lines - open AS first_changed FROM d"
)
def changed_lines(spark, sf_dir):
    """Where the old body of each edited symbol starts, by its last line, and its first changed line."""
    d = _edited(spark, sf_dir).select("sym_id", "a", linediff.body_diff("a", "b").alias("lines"))
    start = linediff.body_start(((F.col("sym_id") % 10) * 10 + 9).cast("long"), F.col("a"))
    d = d.withColumn("body_start", start.cast("long"))
    return d.select("sym_id", "body_start", linediff.first_changed_line(F.col("lines"), F.col("body_start")).cast("long").alias("first_changed"))


@query()
def aligned_rows(spark, sf_dir):
    d = _edited(spark, sf_dir).select(F.col("sym_id").alias("id"), linediff.body_diff("a", "b").alias("lines"))
    return linediff.numbered(d)


@query(
    "SELECT doc_id, " + ", ".join(f"({' + '.join(f'CASE WHEN contains(t, $${p}$$) THEN {w} ELSE 0 END' for p, _ in words)})::DOUBLE AS {i.lower()}" for i, (w, words) in intent.KEYWORDS.items()) + " FROM (SELECT doc_id, lower(replace(text, chr(10), ' ')) AS t FROM documents)"
)
def intent_keywords(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.transform(F.split("text", "\n"), F.lower).alias("added"), F.array().cast("array<string>").alias("removed"))
    rules = [r for r in intent.line_rules(F.col("added"), F.col("removed"), F.lit(0)) if r[3] and r[3].startswith("added ")]
    s = intent.scores(rules)
    return d.select("doc_id", *(s[i].alias(i.lower()) for i in intent.KEYWORDS))


@query(f"WITH {_CHANGED} SELECT old_id, new_id, CASE kind WHEN 'Renamed' THEN 'Refactoring' WHEN 'VisibilityChanged' THEN 'ApiChange' ELSE 'BugFix' END AS primary_intent, CASE kind WHEN 'Renamed' THEN 4.0 WHEN 'VisibilityChanged' THEN 3.0 ELSE 1.0 END::DOUBLE AS raw_score FROM k")
def intent_structural(spark, sf_dir):
    c = _classified(spark, sf_dir)
    return intent.classify(c, intent.structural_rules(F.col("kind"), None)).select("old_id", "new_id", F.col("primary").alias("primary_intent"), "raw_score")


@query()
def intent_primary(spark, sf_dir):
    return _details(spark, sf_dir).select("id", "kind", "name", "primary", "intent_confidence", "raw_score")


# Similar code


def _index(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select(F.col("doc_id").alias("key"), F.concat(F.lit("d"), "doc_id").alias("qualified_name"), F.concat(F.lit("d"), "doc_id").alias("name"), F.col("lang").alias("kind"), F.col("source").alias("file_path"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"), text.normalize_body("text").alias("normalized_body")).withColumn("body_hash", text.body_hash("normalized_body"))


_INDEX = f"i AS (SELECT doc_id AS key, lang AS kind, {NORMALIZE.format('text')} AS norm FROM documents), c AS (SELECT * FROM i WHERE key % 20 = 0)"


@query(f"WITH {_INDEX} SELECT c.key AS changed_key, i.key AS key FROM c JOIN i ON c.norm = i.norm AND c.key <> i.key")
def similar_exact(spark, sf_dir):
    i = _index(spark, sf_dir)
    return similar.exact_duplicates(i.where("key % 20 = 0"), i).select("changed_key", "key")


@query(f"WITH {_INDEX} SELECT key, min(key) OVER (PARTITION BY norm) AS class_key, count(*) OVER (PARTITION BY norm) AS copies FROM i")
def similar_exact_classes(spark, sf_dir):
    """Every symbol with the class of its body, in place of all pairs of a class."""
    return similar.exact_classes(_index(spark, sf_dir).select("key", "body_hash")).select("key", "class_key", "copies")


_UNCHANGED = "u AS (SELECT *, min(key) OVER (PARTITION BY norm) AS class_key, count(*) OVER (PARTITION BY norm) AS copies, count(*) FILTER (key % 20 = 0) OVER (PARTITION BY norm) AS mine FROM i)"


@query(f"WITH {_INDEX}, {_UNCHANGED} SELECT DISTINCT 'd' || class_key AS changed_symbol, mine AS changed, copies - mine AS unchanged, (copies - mine) || ' exact duplicates of ''d' || class_key || ''' were not changed' AS message FROM u WHERE mine > 0 AND copies > mine")
def class_warnings(spark, sf_dir):
    """Of each class with changed members, how many copies stayed as they were."""
    i = _index(spark, sf_dir).select("key", "body_hash")
    return graph.class_warnings(similar.unchanged_copies(i.where("key % 20 = 0"), similar.exact_classes(i)).select(F.concat(F.lit("d"), "class_key").alias("changed_symbol"), "changed", "unchanged"))


@query(f"WITH {_INDEX}, {_UNCHANGED} SELECT key, class_key FROM u WHERE mine > 0 AND key % 20 > 0")
def class_copies(spark, sf_dir):
    i = _index(spark, sf_dir).select("key", "body_hash")
    return similar.copies_of(i.where("key % 20 = 0"), similar.exact_classes(i))


@query(
    f"WITH {_INDEX}, g AS (SELECT key, unnest(list_distinct(list_transform(range(1, length(norm) - 2), lambda p: substr(norm, p, 4)))) AS s FROM i), z AS (SELECT key, count(*) AS n FROM g GROUP BY key), "
    "q AS (SELECT a.key AS ck, b.key AS k, count(*) AS cnt FROM g a JOIN g b ON a.s = b.s WHERE a.key % 20 = 0 AND a.key <> b.key GROUP BY a.key, b.key), "
    "j AS (SELECT ck, k, cnt / (x.n + y.n - cnt) AS s FROM q JOIN z x ON x.key = ck JOIN z y ON y.key = k JOIN i a ON a.key = ck JOIN i b ON b.key = k WHERE a.kind = b.kind AND a.norm <> b.norm AND x.n >= 3 AND y.n >= 3), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY s DESC, k) AS rn FROM j WHERE s >= 0.6 AND s < 1) SELECT ck AS changed_key, k AS key, round(s, 6)::DOUBLE AS similarity FROM r WHERE rn <= 10"
)
def similar_structural(spark, sf_dir):
    i = _index(spark, sf_dir)
    return similar.structurally_similar(i.where("key % 20 = 0"), i).select("changed_key", "key", r6(F.col("similarity")).alias("similarity"))


@query(
    f"WITH RECURSIVE {_SIGNATURES}, q AS (SELECT a.doc_id AS ck, b.doc_id AS k, count(*) / {features.SIGNATURE} AS approx FROM sig a JOIN sig b USING (position, value) WHERE a.doc_id % 20 = 0 AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING count(*) / {features.SIGNATURE} >= 0.5), "
    f"c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY approx DESC, k) AS rn FROM q) WHERE rn <= {similar.CANDIDATES}), "
    "j AS (SELECT ck, k, approx, len(list_intersect(x.grams, y.grams)) AS common, len(x.grams) AS n, len(y.grams) AS o FROM c JOIN s x ON x.doc_id = ck JOIN s y ON y.doc_id = k JOIN t a ON a.doc_id = ck JOIN t b ON b.doc_id = k WHERE a.lang = b.lang AND a.norm <> b.norm AND len(x.grams) >= 3 AND len(y.grams) >= 3), "
    f"r AS (SELECT *, common / (n + o - common) AS s, row_number() OVER (PARTITION BY ck ORDER BY approx DESC, k) AS rn FROM j WHERE common / (n + o - common) >= 0.6 AND common / (n + o - common) < 1) SELECT ck AS changed_key, k AS key, round(s, 6)::DOUBLE AS similarity FROM r WHERE rn <= {similar.PER_SYMBOL}"
)
def similar_structural_compat(spark, sf_dir):
    i = _index(spark, sf_dir)
    return similar.structurally_similar_compat(i.where("key % 20 = 0"), i).select("changed_key", "key", r6(F.col("similarity")).alias("similarity"))


def _parts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    body = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    return p.select(F.col("p_partkey").alias("key"), F.concat(F.lit("p"), "p_partkey").alias("qualified_name"), F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_g"), F.floor(F.col("p_partkey") / 8) + 1000).alias("name"), F.col("p_brand").alias("kind"), F.col("p_brand").alias("file_path"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"), body.alias("normalized_body")).withColumn("body_hash", text.body_hash("normalized_body"))


@query(
    "WITH i AS (SELECT p_partkey AS key, p_brand AS kind, replace(p_name, ' ', '_') || '_g' || (p_partkey // 8 + 1000) AS name, concat_ws(' ', p_name, p_type, p_brand) AS body FROM part), "
    "s AS (SELECT key, kind, body, unnest(list_distinct(list_transform(list_filter(string_split(name, '_'), lambda x: x <> '') || [name], lambda x: lower(x)))) AS stem FROM i), "
    "u AS (SELECT stem FROM s WHERE strlen(stem) >= 4 GROUP BY stem HAVING count(*) <= 50), r AS (SELECT s.* FROM s JOIN u USING (stem)), "
    "p AS (SELECT c.key AS ck, r.key AS k, min(c.stem) AS stem, min(c.body) AS a, min(r.body) AS b FROM r c JOIN r ON c.stem = r.stem AND c.key <> r.key AND c.kind = r.kind GROUP BY c.key, r.key), "
    "v AS (SELECT *, CASE WHEN a = b THEN 1.0 ELSE 1 - levenshtein(a, b) / greatest(strlen(a), strlen(b)) END AS s FROM p), w AS (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY stem, k) AS rn FROM v WHERE s > 0.3) "
    "SELECT ck AS changed_key, k AS key, round(s, 6)::DOUBLE AS similarity FROM w WHERE rn <= 5"
)
def similar_name_pattern(spark, sf_dir):
    i = _parts(spark, sf_dir)
    return similar.name_patterns(i, i).select("changed_key", "key", r6(F.col("similarity")).alias("similarity"))


# Graph and impact

_CALLS = "e AS (SELECT 'f' || l_suppkey AS caller, 'f' || (l_partkey % 97) AS callee, l_returnflag AS file_path, min(l_linenumber) AS line FROM lineitem GROUP BY 1, 2, 3), c AS (SELECT 'f' || s_suppkey AS name FROM supplier)"


def _calls(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    e = li.groupBy(F.concat(F.lit("f"), "l_suppkey").alias("caller"), F.concat(F.lit("f"), F.col("l_partkey") % 97).alias("callee"), F.col("l_returnflag").alias("file_path")).agg(F.min("l_linenumber").alias("line"))
    changed = table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), "s_suppkey").alias("name"))
    return graph.edges(e), changed


@query(f"WITH {_CALLS} SELECT * FROM e")
def call_edges(spark, sf_dir):
    return _calls(spark, sf_dir)[0]


@query(f"WITH {_CALLS} SELECT name, caller, file_path, line FROM c JOIN e ON name = callee")
def callers_of(spark, sf_dir):
    e, c = _calls(spark, sf_dir)
    return graph.callers_of(c, e)


_REACH = f"WITH RECURSIVE {_CALLS}, d AS (SELECT DISTINCT caller, callee FROM e), r(name, node, depth) AS (SELECT name, name, 0 FROM c UNION SELECT r.name, d.caller, depth + 1 FROM r JOIN d ON d.callee = r.node WHERE depth < 2), m AS (SELECT name, node, min(depth) AS depth FROM r GROUP BY name, node), t AS (SELECT m.name, e.callee, e.caller, e.file_path, e.line, m.depth FROM m JOIN e ON e.callee = m.node WHERE m.depth > 0 OR e.caller <> m.name)"


@query(f"{_REACH} SELECT name, callee, caller, file_path, line, depth::INTEGER AS depth FROM t")
def transitive_callers(spark, sf_dir):
    e, c = _calls(spark, sf_dir)
    return graph.transitive_callers(c, e)


@query()
def transitive_callers_dfs(spark, sf_dir):
    e, c = _calls(spark, sf_dir)
    return graph.transitive_callers_dfs(c, e.withColumn("line", F.col("line").cast("long")))


_AFFECTED = f"{_REACH}, a AS (SELECT caller AS caller_symbol, file_path AS caller_file, line AS caller_line, name AS changed_callee, 'signature changed' AS change_description, CASE WHEN depth = 0 THEN 'High' ELSE 'Medium' END AS risk, depth::INTEGER AS depth, row_number() OVER (PARTITION BY caller, file_path, name ORDER BY depth, line) AS rn FROM t)"


def _affected(spark, sf_dir):
    e, c = _calls(spark, sf_dir)
    return graph.affected_callers(c.select("name", F.lit("signature changed").alias("description"), F.lit("High").alias("risk")), e)


@query(f"{_AFFECTED} SELECT * EXCLUDE (rn) FROM a WHERE rn = 1")
def affected_callers(spark, sf_dir):
    return _affected(spark, sf_dir)


def _found(spark, sf_dir):
    i = _index(spark, sf_dir)
    names = i.select(F.col("key").alias("changed_key"), F.col("qualified_name").alias("changed_symbol"))
    other = i.select("key", F.col("qualified_name").alias("similar_symbol"), "file_path", "line_start", "line_end")
    return similar.exact_duplicates(i.where("key % 20 = 0"), i).join(names, "changed_key").join(other, "key").drop("key", "changed_key")


_WARNED = f"WITH {_INDEX} SELECT 'Exact duplicate of ''d' || c.key || ''' exists but was not changed' AS message, 'd' || c.key AS changed_symbol, 'd' || i.key AS related_symbol, s.source AS file_path, 1 AS line_start, 2 AS line_end, 1.0::DOUBLE AS similarity FROM c JOIN i ON c.norm = i.norm AND c.key <> i.key JOIN documents s ON s.doc_id = i.key"


@query(_WARNED)
def pattern_warnings(spark, sf_dir):
    return graph.pattern_warnings(_found(spark, sf_dir))


@query(f"{_AFFECTED}, w AS ({_WARNED}) SELECT (SELECT count(*) FROM a WHERE rn = 1) AS total_affected_callers, (SELECT count(*) FROM a WHERE rn = 1 AND risk = 'High') AS high_risk_count, (SELECT count(*) FROM a WHERE rn = 1 AND risk = 'Medium') AS medium_risk_count, 0::BIGINT AS low_risk_count, (SELECT count(*) FROM w) AS total_similar_code, (SELECT count(*) FROM w) AS total_pattern_warnings")
def risk_summary(spark, sf_dir):
    found = _found(spark, sf_dir)
    return graph.risk_summary(_affected(spark, sf_dir), found, graph.pattern_warnings(found))


# Sources


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""")
def href_refs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query("SELECT page_id, array_to_string(regexp_extract_all(html, '<script[^>]*>((?:.|\\n)*?)</script>', 1), chr(10)) AS script FROM pages")
def script_blocks(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.script_blocks("html").alias("script"))


def _snippets(spark, sf_dir):
    """Source files made of the parts: one function each, in four languages by turns, that calls the function of the next part."""
    p = table(spark, sf_dir, "part")
    name = lambda k: F.concat(F.lit("f_"), k.cast("string"))
    me, callee, n = name(F.col("p_partkey")), name(F.col("p_partkey") + 1), F.col("p_size").cast("string")
    rust = F.format_string("pub fn %s(x: i32) -> i32 {\n    %s(x + %s)\n}\n", me, callee, n)
    go = F.format_string("package p\n\nfunc %s(x int) int {\n\treturn %s(x + %s)\n}\n", me, callee, n)
    ts = F.format_string("export function %s(x: number): number {\n  return %s(x + %s);\n}\n", me, callee, n)
    py = F.format_string("def %s(x: int) -> int:\n    return %s(x + %s)\n", me, callee, n)
    turn = F.col("p_partkey") % 4
    ext = F.when(turn == 0, ".rs").when(turn == 1, ".go").when(turn == 2, ".ts").otherwise(".py")
    body = F.when(turn == 0, rust).when(turn == 1, go).when(turn == 2, ts).otherwise(py)
    return p.select(F.concat(F.lit("src/"), F.col("p_brand"), F.lit("/"), me, ext).alias("path"), body.alias("content"))


@query(
    "SELECT 'src/' || p_brand || '/f_' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.rs' WHEN 1 THEN '.go' WHEN 2 THEN '.ts' ELSE '.py' END AS file_path, 'Function' AS kind, 'f_' || p_partkey AS name, CASE p_partkey % 4 WHEN 1 THEN 'Private' ELSE 'Public' END AS visibility, "
    "'f_' || p_partkey || '(x: ' || CASE p_partkey % 4 WHEN 0 THEN 'i32' WHEN 2 THEN 'number' ELSE 'int' END || ') -> ' || CASE p_partkey % 4 WHEN 0 THEN 'i32' WHEN 2 THEN 'number' ELSE 'int' END AS signature, "
    "CASE p_partkey % 4 WHEN 1 THEN 3 ELSE 1 END AS line_start, CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 3 ELSE 2 END AS line_end FROM part"
)
def extract_symbols(spark, sf_dir):
    return extract.extract_symbols(_snippets(spark, sf_dir)).select("file_path", "kind", "name", "visibility", "signature", "line_start", "line_end")


@query("SELECT 'f_' || p_partkey AS caller, 'f_' || (p_partkey + 1) AS callee, CASE p_partkey % 4 WHEN 1 THEN 4 ELSE 2 END AS line FROM part")
def extract_calls(spark, sf_dir):
    return extract.extract_calls(_snippets(spark, sf_dir)).select("caller", "callee", "line")


@query("SELECT doc_id, len(list_distinct(list_transform(range(1, length(text) - 2), lambda i: substr(text, i, 4)))) AS shingles, 64::BIGINT AS minhash FROM documents")
def index_roundtrip(spark, sf_dir):
    """Features of all documents, written as an index and read back."""
    d = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("file_path"), F.lit("d").alias("qualified_name"), F.lit("d").alias("name"), F.col("text").alias("normalized_body"), F.sha2("text", 256).alias("body_hash"))
    got = stage(index.similarity_features(d), "index")
    return got.select(F.substring_index("key", ":", 1).cast("long").alias("doc_id"), F.size("shingles").cast("long").alias("shingles"), F.size("minhash").cast("long").alias("minhash"))


# Views


def _spans(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.concat_ws("/", "p_brand", F.floor(F.col("p_partkey") / 40).cast("string")).alias("file_path"), F.col("p_partkey").alias("id"), F.col("p_size").alias("line_start"), (F.col("p_size") + F.length("p_name")).cast("int").alias("line_end"))


_SPANS = "s AS (SELECT p_brand || '/' || (p_partkey // 40) AS file_path, p_partkey AS id, p_size AS line_start, p_size + length(p_name) AS line_end FROM part)"


@query(f"WITH {_SPANS} SELECT id, file_path AS file_info, row_number() OVER (PARTITION BY file_path ORDER BY line_start, id) AS place FROM s")
def nav_order(spark, sf_dir):
    s = _spans(spark, sf_dir).withColumn("file_info", F.col("file_path"))
    return views.nav_order(s).select("id", "file_info", F.col("place").cast("long").alias("place"))


@query(f"WITH {_SPANS} SELECT file_path AS file_info, count(*) AS changes, bool_and(id % 2 = 0) AS only_added, bool_and(id % 2 = 1) AS only_deleted FROM s GROUP BY file_path")
def file_groups(spark, sf_dir):
    s = _spans(spark, sf_dir).select(F.col("file_path").alias("file_info"), F.when(F.col("id") % 2 == 0, "Added").otherwise("Deleted").alias("kind"))
    return views.file_groups(s)


@query(
    f"WITH RECURSIVE {_SPANS}, o AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line_start, line_end DESC, id) AS i FROM s), "
    "r AS (SELECT file_path, i, id, 0 AS depth, [{'e': line_end, 'd': 0}] AS st FROM o WHERE i = 1 UNION ALL SELECT file_path, i, id, depth, list_append(p, {'e': line_end, 'd': depth}) FROM (SELECT *, CASE WHEN len(p) > 0 THEN p[len(p)].d + 1 ELSE 0 END AS depth FROM "
    "(SELECT o.*, r.st[1:coalesce(list_max(list_filter(range(1, len(r.st) + 1), lambda k: r.st[k].e >= o.line_start)), 0)] AS p FROM r JOIN o ON o.file_path = r.file_path AND o.i = r.i + 1) x) y) SELECT file_path, id, depth FROM r"
)
def nesting_depth(spark, sf_dir):
    return views.nesting_depth(_spans(spark, sf_dir))


@query(f"WITH {_SPANS}, l AS (SELECT file_path, id, line_end - line_start AS size, unnest(range(line_start, line_end + 1)) AS line FROM s) SELECT file_path, line::INTEGER AS line, string_agg(id::VARCHAR, ',' ORDER BY size DESC, id) AS regions FROM l GROUP BY file_path, line")
def region_lines(spark, sf_dir):
    return views.region_lines(_spans(spark, sf_dir)).select("file_path", "line", F.array_join(F.col("regions").cast("array<string>"), ",").alias("regions"))


@query(f"WITH {_SPANS}, l AS (SELECT file_path, id, line_end - line_start AS size, unnest(range(line_start, line_end + 1)) AS line FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY file_path, line ORDER BY size, id) AS rn FROM l), p AS (SELECT DISTINCT file_path, line_start AS line FROM s) SELECT p.file_path, p.line::INTEGER AS line, r.id FROM p JOIN r ON r.file_path = p.file_path AND r.line = p.line AND rn = 1")
def innermost(spark, sf_dir):
    s = _spans(spark, sf_dir)
    return views.innermost(s.select("file_path", F.col("line_start").alias("line")).distinct(), s)


@query(f"WITH {_CHANGED} SELECT old_id, CASE k.kind WHEN 'VisibilityChanged' THEN 'VIS ' || o.name || ' (' || o.visibility || ' -> ' || n.visibility || ')' ELSE '~ ' || n.name END AS label FROM k JOIN o ON o.sym_id = old_id JOIN n ON n.sym_id = new_id")
def block_labels(spark, sf_dir):
    c = _classified(spark, sf_dir)
    return c.select("old_id", report.block_label(F.col("kind"), F.col("new.name"), F.col("old"), F.col("new"), F.lit(""), True).alias("label"))


# Reports


@query("SELECT conv_id, turn, text AS summary, 'Low' AS risk_level FROM conversations")
def parse_review(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("r", report.parse_review(F.col("text")))
    return c.select("conv_id", "turn", F.col("r.summary").alias("summary"), F.col("r.risk_level").alias("risk_level"))


def _details(spark, sf_dir):
    return diff.diff(*snapshots(spark, sf_dir))


@query()
def text_report(spark, sf_dir):
    return report.text_entries(_details(spark, sf_dir))


@query()
def json_report(spark, sf_dir):
    return report.json_lines(_details(spark, sf_dir))


@query()
def review_prompt(spark, sf_dir):
    return report.review_prompt(_details(spark, sf_dir))


@query()
def summary_prompt(spark, sf_dir):
    return report.summary_prompt(_details(spark, sf_dir))

