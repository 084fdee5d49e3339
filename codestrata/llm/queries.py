"""The queries of the training-data operators: thin bindings to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, licenses, neardup, packing, pii, quality_classifier, quality_rules, secrets, substring_dedup, url_filter, whitening
from .common import table


def op1_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pii_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents")).drop("spans_list")


def op3_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op4_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return d.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("findings")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_digests(table(spark, sf_dir, "documents"))


def op8_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_language_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components_of(table(spark, sf_dir, "embeddings"))


def op12_url_language_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).withColumn("score", F.round("score", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def _spans_sql() -> str:
    """The secrets of the texts: places are running lengths of the pieces between matches and of the matches. RE2 has no look-behind, so
    the character before is matched too and left out of the span."""
    before = {"github": "[A-Za-z0-9_]", "jwt": "[A-Za-z0-9_-]"}
    kinds = []
    for i, (kind, pattern) in enumerate((secrets.BASE | secrets.MORE).items()):
        lead = before.get(kind)
        plain = pattern.replace(f"(?<!{lead})", "").replace("++", "+").replace("*+", "*").replace("}+", "}").replace("'", "''")
        whole = f"(?:^|{lead.replace('[', '[^')})(?:{plain})" if lead else f"(?:{plain})"
        kinds.append((i, kind, whole, f"(?:{plain})"))
    parts = " UNION ALL ".join(
        f"SELECT r, {i} AS o, '{kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) + length(m[i]) - length(regexp_extract(m[i], '{plain}$')), 'm': regexp_extract(m[i], '{plain}$')}})) AS x "
        f"FROM (SELECT r, regexp_extract_all(t, '{whole}') AS m, string_split_regex(t, '{whole}') AS p FROM t WHERE regexp_matches(t, '{whole}'))"
        for i, kind, whole, plain in kinds
    )
    key = secrets._KEY.replace("'", "''")
    value = rf"""^{key}["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$"""
    n = len(secrets.KINDS)
    text = "kind || ':' || s || ':' || e"
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT r, o, kind, x.s::BIGINT AS s, (x.s + length(x.m))::BIGINT AS e FROM ({parts}) WHERE o > 0 OR length(regexp_extract(x.m, '{value}', 1)) >= 6),
g AS (SELECT r, string_agg({text}, ',' ORDER BY s, o, e) AS spans, string_agg({text}, ',' ORDER BY s, o, e) FILTER (o < {n}) AS base, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.KINDS)} FROM f GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (r)"""


def _quality_sql() -> str:
    """The counts, histograms, references, distances and limits of the quality rules."""
    ws = r"[\x20\x09-\x0D]+"
    taken = lambda p: f"length(t) - length(regexp_replace(t, '{p}', '', 'g'))"
    common = ", ".join(f"len(list_filter(c, lambda x: x = '{w}'))" for w in quality_rules.COMMON)
    nc, nw = len(quality_rules._CHARS), len(quality_rules.COMMON) + 1
    sums = lambda c, n: "[" + ", ".join(f"coalesce(sum({c}[{i}]), 0)::DOUBLE" for i in range(1, n + 1)) + "]"
    share = lambda c, n: f"list_transform({c}, lambda x: (x + 0.5) / (list_sum({c}) + {n / 2}))"
    js = lambda n: f"sqrt(greatest(0.0, list_sum(list_transform(range(1, {n + 1}), lambda i: (p[i] * log2(2 * p[i] / (p[i] + q[i])) + q[i] * log2(2 * q[i] / (p[i] + q[i]))) / 2))))"
    at = lambda q: f"min(CASE WHEN upto >= {q} * n_all THEN bin END) * {quality_rules.BIN}"
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{ws}'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w))),
rep AS (SELECT r, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS covered FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM g WHERE n > 1) GROUP BY r),
c AS (SELECT *, list_filter(list_transform(w, lambda x: lower(x)), lambda x: x IN ({", ".join(f"'{x}'" for x in quality_rules.COMMON)})) AS c FROM w),
d0 AS (SELECT r, doc_id, lang, len(w) AS n_words, length(regexp_replace(t, '{ws}', '', 'g')) AS word_chars, length(t) AS n, {taken('[#*$%&|<>]+')} AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(covered, 0) AS n_repeat_words,
  {taken(chr(92) + 'p{Lu}+')} AS up, {taken('[0-9]+')} AS dig, {taken("[.,;:!?''" + '"' + "()" + chr(92) + "[" + chr(92) + "]_-]+")} AS mark, {taken("[^" + chr(92) + "p{L}" + chr(92) + "p{N}" + chr(92) + "x09-" + chr(92) + "x0D" + chr(92) + "x20.,;:!?''" + '"' + "()" + chr(92) + "[" + chr(92) + "]_-]+")} AS sym, [{common}] AS words, len(c) AS n_common FROM c LEFT JOIN rep USING (r)),
d AS (SELECT r, doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n AS chars_all,
  [greatest(0, n - (n - word_chars) - up - dig - mark - sym), up, dig, n - word_chars, mark, sym]::DOUBLE[] AS chars, list_append(words, n_words - n_common)::DOUBLE[] AS common FROM d0),
refs AS (SELECT lang, {sums('chars', nc)} AS ref_chars, {sums('common', nw)} AS ref_common FROM d WHERE NOT base_failed AND lang IS NOT NULL GROUP BY lang),
pooled AS (SELECT {sums('chars', nc)} AS all_chars, {sums('common', nw)} AS all_common FROM d WHERE NOT base_failed),
e AS (SELECT d.*, refs.lang IS NULL AS alone, coalesce(ref_chars, all_chars) AS rc, coalesce(ref_common, all_common) AS rw FROM d LEFT JOIN refs USING (lang) CROSS JOIN pooled),
jc AS (SELECT r, {js(nc)} AS char_distance FROM (SELECT r, {share('chars', nc)} AS p, {share('rc', nc)} AS q FROM e)),
jw AS (SELECT r, {js(nw)} AS word_distance FROM (SELECT r, {share('common', nw)} AS p, {share('rw', nw)} AS q FROM e)),
f AS (SELECT e.*, char_distance, word_distance, CASE WHEN alone THEN '-' ELSE '=' || lang END AS grp, floor(log2(greatest(1, n_words)))::INT AS len2, least({quality_rules.BINS}, floor(word_distance * sqrt(n_words) / {quality_rules.BIN}))::BIGINT AS bin FROM e JOIN jc USING (r) JOIN jw USING (r)),
sound AS (SELECT * FROM f WHERE NOT base_failed AND n_words >= {quality_rules.MIN_WORDS}),
lev AS (SELECT grp, len2, bin, count(*) AS n FROM sound GROUP BY ALL UNION ALL SELECT grp, -1, bin, count(*) FROM sound GROUP BY ALL UNION ALL SELECT '*', -1, bin, count(*) FROM sound WHERE grp <> '-' GROUP BY bin),
cum AS (SELECT *, sum(n) OVER (PARTITION BY grp, len2 ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY grp, len2) AS n_all FROM lev),
lim AS (SELECT grp, len2, mid + {quality_rules.BIN} + {quality_rules.DEVIATIONS} * greatest({quality_rules.LEAST_SPREAD}, mid - low) AS lim FROM (SELECT grp, len2, {at(0.1587)} AS low, {at(0.5)} AS mid FROM cum WHERE n_all >= {quality_rules.LEAST_DOCS} GROUP BY grp, len2)),
h AS (SELECT f.*, coalesce(a.lim, b.lim, CASE WHEN f.grp <> '-' THEN (SELECT max(lim) FROM lim WHERE grp = '*') END) / sqrt(n_words) AS lim FROM f LEFT JOIN lim a ON a.grp = f.grp AND a.len2 = f.len2 LEFT JOIN lim b ON b.grp = f.grp AND b.len2 = -1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (list_sum(chars) >= {quality_rules.MIN_CHARS} AND char_distance > {quality_rules.MAX_CHAR_DISTANCE} OR n_words >= {quality_rules.MIN_WORDS} AND word_distance > coalesce(lim, {quality_rules.MAX_WORD_DISTANCE})) AS kept,
  round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance FROM h"""


def _url_sql() -> str:
    """The models of URLs, level by level, the threshold of the held-out sites, and the rules."""
    u = url_filter
    lower = lambda c: f"translate({c}, '{u._UPPER}', '{u._LOWER}')"
    levels = "".join(
        f"""
l{k} AS (SELECT right(g, {k}) AS g, sum(a)::BIGINT AS a, sum(r)::BIGINT AS r FROM c GROUP BY 1),
w{k} AS (SELECT *, sum(a) OVER q AS na, sum(r) OVER q AS nr, count(*) FILTER (a > 0) OVER q AS ta, count(*) FILTER (r > 0) OVER q AS tr FROM l{k} WINDOW q AS (PARTITION BY left(g, {k - 1}))),
p{k} AS MATERIALIZED (SELECT w.g, CASE WHEN na > 0 THEN (w.a + ta * p.a) / (na + ta) ELSE p.a END AS a, CASE WHEN nr > 0 THEN (w.r + tr * p.r) / (nr + tr) ELSE p.r END AS r FROM w{k} w JOIN p{k - 1} p ON right(w.g, {k - 1}) = p.g),"""
        for k in range(1, u.ORDER + 1)
    )
    fits = [(x, f"(host = '{x.host}' OR ends_with(host, '.{x.host}')) AND starts_with(path, '{x.path}')") for x in sorted(u.RULES, key=lambda x: (-len(x.name), -len(x.host), x.verdict != "block"))]
    pick = lambda f: "CASE " + " ".join(f"WHEN {cond} THEN '{f(x)}'" for x, cond in fits) + " END"
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS i FROM pages),
h AS (SELECT *, CASE WHEN i > 0 THEN {lower("regexp_extract(substr(url, i + 3), '^[^/?#]*')")} ELSE '' END AS host, CASE WHEN i > 0 THEN regexp_extract(substr(url, i + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
t AS (SELECT *, regexp_replace({lower("CASE WHEN i > 0 THEN host || path ELSE regexp_extract(url, '^[^?#]*') END")}, '[0-9]+', '0', 'g') AS text FROM h),
x AS MATERIALIZED (SELECT text, CASE WHEN regexp_matches(site, '(^|[.-])({"|".join(u.REJECTED)})([.-]|$)') THEN true WHEN NOT regexp_matches(site, '{"|".join(x for x in u.REJECTED if len(x) >= u.WITHIN)}') THEN false END AS rejected, md5(site) < '4' AS held FROM (SELECT DISTINCT text, regexp_extract(text, '^[^/]*') AS site FROM t WHERE text <> '')),
g AS MATERIALIZED (SELECT text, rejected, held, substr(p, i, {u.ORDER}) AS g FROM (SELECT *, repeat(chr(2), {u.ORDER - 1}) || text AS p, unnest(range(1, length(text) + 1)) AS i FROM x)),
c AS MATERIALIZED (SELECT g, count(*) FILTER (NOT held AND NOT rejected) AS a, count(*) FILTER (NOT held AND rejected) AS r FROM g GROUP BY g),
z AS (SELECT sum(a) AS a, sum(r) AS r, count(DISTINCT right(g, 1)) AS letters FROM c),
p0 AS (SELECT '' AS g, 1.0::DOUBLE / letters AS a, 1.0::DOUBLE / letters AS r FROM z),{levels}
o AS (SELECT p{u.ORDER}.g, CASE WHEN z.a > 0 AND z.r > 0 THEN round((ln(p{u.ORDER}.r) - ln(p{u.ORDER}.a)) * {u.UNIT})::BIGINT ELSE 0 END AS ratio FROM p{u.ORDER}, z),
s AS MATERIALIZED (SELECT text, any_value(rejected) AS rejected, any_value(held) AS held, sum(ratio)::DOUBLE / (count(*) * {u.UNIT}::DOUBLE) AS score FROM g JOIN o USING (g) GROUP BY text),
b AS MATERIALIZED (SELECT *, greatest(-{u.WIDEST}, least({u.WIDEST}, floor(score * {u.BINS})))::INTEGER AS bin FROM s),
k AS (SELECT bin, count(*) FILTER (NOT rejected)::DOUBLE AS a, count(*) FILTER (rejected)::DOUBLE AS r FROM b WHERE held GROUP BY bin),
m AS (SELECT bin, lag(bin) OVER (ORDER BY bin) AS prev, sum(a) OVER () AS sa, sum(r) OVER () AS sr, coalesce(sum(r) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS missed, sum(a) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lost FROM k),
f AS (SELECT CASE WHEN (SELECT count(*) FROM m WHERE sa > 0 AND sr > 0) = 0 THEN 0 ELSE (SELECT floor((coalesce(prev + 1, bin) + bin) / 2) FROM m WHERE missed / sr + {u.FALSE_COST} * lost / sa < 1 ORDER BY missed / sr + {u.FALSE_COST} * lost / sa, bin DESC LIMIT 1) END AS least),
j AS (SELECT t.page_id, host, path, coalesce(score, 0.0) AS score, CASE WHEN coalesce(bin >= f.least, false) THEN 'block' ELSE 'allow' END AS by_model FROM t LEFT JOIN b USING (text) CROSS JOIN f)
SELECT page_id, host, path, {pick(lambda x: x.name)} AS rule, coalesce({pick(lambda x: x.verdict)}, by_model) AS verdict, round(score, 6) AS score, by_model FROM j"""


#: Queries whose results don't hang on a model or a tokenizer; the others are held against plain Python in tests/llm.
SQL = {
    "op5_quality_divergence": _quality_sql(),
    "op6_secret_ledger": _spans_sql(),
    "op12_url_language_ratio": _url_sql(),
    "op7_suffix_dedup": """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, doc_id, p, b[p + 1:p + 50] AS s FROM (SELECT r, doc_id, b, unnest(range(0, octet_length(b) - 49)) AS p FROM t)),
m AS (SELECT s, min(doc_id) AS d FROM w GROUP BY s),
g AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS q FROM w JOIN m USING (s) WHERE d < doc_id),
k AS (SELECT r, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS k FROM g),
j AS (SELECT r, min(p) AS s, max(p) + 50 AS e FROM k GROUP BY r, k),
l AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS a FROM j),
o AS (SELECT r, string_agg(CASE WHEN s > a THEN hex(b[a + 1:s]) ELSE '' END, '' ORDER BY s) AS x, sum(e - s) AS n, count(*) AS c, max(e) AS e FROM l JOIN t USING (r) GROUP BY r)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(c, 0) AS n_spans,
  sha256(unhex(coalesce(x, '') || CASE WHEN octet_length(b) > coalesce(e, 0) THEN hex(b[coalesce(e, 0) + 1:octet_length(b)]) ELSE '' END)) AS kept_sha256 FROM t LEFT JOIN o USING (r)""",
    "op4_setsketch_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r(d, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT link.a, r.c FROM r JOIN link ON link.b = r.d),
m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT s.doc_id, len(s.s) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept FROM s JOIN m ON m.d = s.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return SQL
