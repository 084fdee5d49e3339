"""Scalar functions of symbol comparison as Spark columns. Lengths and edit distances are over UTF-8 bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

def bound(value: Column, use) -> Column:
    """use(value) with value computed once: a lambda's variable, where a repeated expression would be computed per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def over(score: Column, least: Column | float) -> Column:
    """Rows of the score where it is over least, none elsewhere. A filter on a column would compute it a second time."""
    return F.explode(F.filter(F.array(score), lambda s: s > least))


def running(values: Column, op) -> Column:
    """The running op (associative) of an array of int, by doubling: an aggregate() that appends would copy the array at each step."""
    shifts = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(shifts, values, lambda acc, shift: F.transform(acc, lambda x, i: F.when(i >= shift, op(F.get(acc, i - shift), x)).otherwise(x)))


_MARK = "\x01"
_COMMENTS = r"//[^\n]*?(?:(\x01)\n|\z)|/\*[\s\S]*?(?:\*/|\z)|\x01(\n)"
_LITERALS = r""""(?:\\[\s\S]|[^"\\])*+(?:"|\\?\z)|'(?:\\[\s\S]|[^'\\])*+(?:'|\\?\z)|[0-9][0-9._]*"""


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_body(c: ColumnOrName) -> Column:
    """Drops // and /* */ comments (a line comment leaves a space), collapses white space, trims. Not aware of strings."""
    c = col(c)
    t = F.replace(c, F.lit("\n"), F.lit(_MARK + "\n"))
    t = F.regexp_replace(t, _COMMENTS, "$1$2")
    t = F.when(F.contains(c, F.lit("//")) | F.contains(c, F.lit("/*")), t).otherwise(c)  # the search for comments is half the work
    t = F.regexp_replace(t, r"(?U)\s+", " ")
    t = F.replace(F.replace(t, F.lit(_MARK + " "), F.lit(_MARK)), F.lit(_MARK), F.lit(" "))
    return F.trim(t)


def body_hash(normalized: ColumnOrName) -> Column:
    return F.sha2(col(normalized), 256)


def as_bytes(c: ColumnOrName) -> Column:
    """One character per byte, so that string functions count bytes."""
    return F.decode(F.encode(col(c), "UTF-8"), "ISO-8859-1")


def byte_prefix(c: ColumnOrName, n: int) -> Column:
    """The longest prefix of at most n bytes that ends between characters."""
    cut = F.decode(F.substring(F.encode(col(c), "UTF-8"), 1, n), "ISO-8859-1")
    # a cut sequence at the end: a lead byte with too few followers
    whole = F.regexp_replace(cut, r"(?:[\xC0-\xFF]|[\xE0-\xFF][\x80-\xBF]|[\xF0-\xFF][\x80-\xBF]{2})\z", "")
    return F.when(F.octet_length(col(c)) <= n, col(c)).otherwise(F.decode(F.encode(whole, "ISO-8859-1"), "UTF-8"))


def levenshtein(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.levenshtein(as_bytes(a), as_bytes(b))


def levenshtein_bounded(a: ColumnOrName, b: ColumnOrName, most: int) -> Column:
    """The byte edit distance, or most + 1 where it is larger."""
    d = F.levenshtein(as_bytes(a), as_bytes(b), most)
    return F.when(d < 0, most + 1).otherwise(d)


def body_similarity(a: ColumnOrName, b: ColumnOrName, threshold: Column | float = 0.0) -> Column:
    """Similarity of normalised bodies: 1 - distance / longer, on their first 1000 bytes where one is longer.

    0 where the lengths alone rule the threshold out; a distance over the threshold's bound counts as that bound plus one."""
    a, b = col(a), col(b)
    threshold = F.lit(threshold) if isinstance(threshold, float | int) else threshold
    la, lb = F.octet_length(a), F.octet_length(b)
    most, least = F.greatest(la, lb), F.least(la, lb)
    x, y = (F.when(most > 1000, byte_prefix(c, 1000)).otherwise(c) for c in (a, b))
    bound = F.floor((1 - threshold) * most).cast("int")
    # -1 beyond the bound, which the modulus turns into bound + 1; said once, as branches would compute it again
    distance = F.pmod(F.call_function("levenshtein", as_bytes(x), as_bytes(y), bound), bound + 2)
    longer = F.greatest(F.octet_length(x), F.octet_length(y))
    return F.when(a == b, 1.0).when(least == 0, 0.0).when(least / most < threshold, 0.0).when(x == y, 1.0).otherwise(1 - distance / longer)


def name_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    a, b = col(a), col(b)
    longer = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(a == b, 1.0).when(longer == 0, 1.0).otherwise(1 - levenshtein(a, b) / longer)


def jaccard(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Of two arrays as sets: 1 if both are empty, 0 if one is."""
    a, b = col(a), col(b)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def structural_similarity(a_body: ColumnOrName, b_body: ColumnOrName, a_print: ColumnOrName, b_print: ColumnOrName, threshold: Column | float = 0.0, bodies: Column | None = None) -> Column:
    """Jaccard similarity of syntax fingerprints; of bodies where one has none (bodies: their similarity, if it is at hand)."""
    x, y = col(a_print), col(b_print)
    t = F.lit(threshold) if isinstance(threshold, float | int) else threshold
    upper = F.least(F.size(x), F.size(y)) / F.greatest(F.size(x), F.size(y), F.lit(1))
    return (
        F.when(col(a_body) == col(b_body), 1.0)
        .when((F.size(x) == 0) | (F.size(y) == 0), body_similarity(a_body, b_body, threshold) if bodies is None else bodies)
        .when(upper < t, 0.0)
        .otherwise(jaccard(x, y))
    )


def normalized_signature(parameters: ColumnOrName, return_type: ColumnOrName) -> Column:
    """(types or names) -> return type, without the function's name."""
    shown = F.transform(col(parameters), lambda p: F.coalesce(p["type_annotation"], p["name"]))
    return F.concat(F.lit("("), F.array_join(shown, ", "), F.lit(") -> "), F.coalesce(col(return_type), F.lit("")))


def strip_literals(c: ColumnOrName) -> Column:
    """Quoted strings and numbers become an underscore."""
    return F.regexp_replace(col(c), _LITERALS, "_")


def words(c: ColumnOrName) -> Column:
    return F.filter(F.split(col(c), r"(?U)\s+"), lambda w: w != "")


def line_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Words of a that occur in b, over the larger word count; words of a count each time."""
    wa, wb = words(a), words(b)
    longer = F.greatest(F.size(wa), F.size(wb))
    return F.when(longer == 0, 1.0).otherwise(F.size(F.filter(wa, lambda w: F.array_contains(wb, w))) / longer)


def formatting_only(a: ColumnOrName, b: ColumnOrName) -> Column:
    bare = lambda c: F.regexp_replace(col(c), r"(?U)\s", "")
    return bare(a) == bare(b)


def expand_tabs(c: ColumnOrName, width: int = 4) -> Column:
    """Tabs filled to the next multiple of width, per line."""

    def line(x: Column) -> Column:
        parts = F.split(x, "\t")
        filled = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.rpad(p, (F.floor(F.length(p) / width) + 1).cast("int") * width, " "))
        return F.concat(F.array_join(filled, ""), F.element_at(parts, -1))

    return F.array_join(F.transform(F.split(col(c), "\n"), line), "\n")


def shorten_path(c: ColumnOrName) -> Column:
    """The last three components."""
    parts = F.split(col(c), "/")
    return F.when(F.size(parts) <= 3, col(c)).otherwise(F.array_join(F.slice(parts, F.size(parts) - 2, 3), "/"))


def path_key(c: ColumnOrName) -> Column:
    """Sorts paths by lower-cased component, shallower first."""
    return F.transform(F.split(col(c), "/"), F.lower)


def glob_regex(glob: str) -> str | None:
    """A shell glob as a regular expression whose * crosses slashes; None for an invalid one."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            end = glob.find("]", i + 1 + (glob[i : i + 1] == "!"))
            if end < 0:
                return None
            body = glob[i:end].replace("\\", "\\\\")
            out += f"[^{body[1:]}]" if body.startswith("!") else f"[{body}]"
            i = end + 1
        else:
            out += "\\" + c if c in r"\.^$+{}()|]" else c
    return f"(?s)^{out}$"


def excluded(path: ColumnOrName, globs: list[str]) -> Column:
    found = F.lit(False)
    for g in globs:
        if (r := glob_regex(g)) is not None:
            found = found | col(path).rlike(r)
    return found


def language(path: ColumnOrName) -> Column:
    """The language of a file by its extension; null if unsupported."""
    ext = F.regexp_extract(col(path), r"\.([^./]+)$", 1)
    return (
        F.when(ext == "rs", "rust").when(ext == "go", "go").when(ext == "ts", "typescript").when(ext.isin("tsx", "svelte"), "tsx")
        .when(ext.isin("js", "mjs", "cjs"), "javascript").when(ext == "py", "python")
    )


def script_blocks(c: ColumnOrName) -> Column:
    """The bodies of <script…>…</script> joined by newlines; null without one or with an unclosed tag."""
    t = col(c)
    blocks = F.regexp_extract_all(t, F.lit(r"<script[^>]*>([\s\S]*?)</script>"), F.lit(1))
    opened = F.regexp_count(t, F.lit("<script"))
    rest = F.regexp_replace(t, r"<script[^>]*>[\s\S]*?</script>", "")
    return F.when((opened > 0) & (F.size(blocks) > 0) & ~F.contains(rest, F.lit("<script")), F.array_join(blocks, "\n"))
