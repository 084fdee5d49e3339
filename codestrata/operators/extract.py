"""Symbols and call references of source files: table-valued, one file to any number of rows.

There is no grammar library here: brace languages are read by blanking comments, strings and regular expressions and matching brackets, Python
by its own parser, or by indentation where a file has a syntax error. Fingerprints are windows of (depth, token class) of these tokens.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.stage import spread, stage

RAW = "file_path string, ord int, kind string, name string, qualified_name string, line_start int, line_end int, signature string, body_text string, parent string, visibility string, parameters array<struct<name:string,type_annotation:string>>, return_type string, ast_fingerprint array<bigint>"
CALLS = "caller string, callee string, file_path string, line int"
# Words that stand before a bracket without being called.
NOT_CALLED = frozenset("if for while match switch catch return func fn function loop else in of typeof new await async def class lambda not and or print_ super_ sizeof select go defer range case var let const type struct enum impl trait interface where elif except with assert yield del is".split())
#: A regular expression of TypeScript or JavaScript, after what can't end a value.
_REGEX = r"(?P<pre>(?:[(,=:\[!&|?{;~^+\-*%<>]|\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do|await|yield)\b)\s*)/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
_TOKEN = re.compile(r"[A-Za-z_]\w*|\d[\w.]*|\S")
_KEYWORDS = {w: k + 10 for k, w in enumerate(sorted("if else for while loop match switch case return break continue let const var mut fn func function def class struct enum trait impl interface type import use from pub async await try catch finally except raise throw new in of as and or not is lambda with yield go defer select range map".split()))}
#: Files whose rows are handed on together.
FILES = 256


def blank(src: str, lang: str) -> str:
    """The source with comments and the insides of strings as spaces, newlines kept."""
    quotes = {"rust": r'"(?:\\.|[^"\\])*"|r(#*)".*?"\1' + r"|'(?:\\.|[^'\\\n])'", "go": r'"(?:\\.|[^"\\\n])*"|`[^`]*`|' + r"'(?:\\.|[^'\\\n])+'"}.get(lang, r'"(?:\\.|[^"\\\n])*"|' + r"'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`")
    regex = f"|{_REGEX}" if lang in ("typescript", "tsx", "javascript") else "|(?P<pre>(?!))"
    found = re.compile(rf"//[^\n]*|/\*.*?(?:\*/|\Z)|{quotes}{regex}", re.S)
    return found.sub(lambda m: (m["pre"] or "") + re.sub(r"[^\n]", " ", m[0][len(m["pre"] or "") :]), src)


def blank_python(src: str) -> str:
    triple = "|".join(q * 3 + r"(?:\\.|.)*?(?:" + q * 3 + r"|\Z)" for q in "\"'")
    single = "|".join(q + rf"(?:\\.|[^{q}\\\n])*{q}?" for q in "\"'")
    return re.compile(rf"#[^\n]*|{triple}|{single}", re.S).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), src)


#: A line that starts an item, by which brackets that don't balance are repaired.
_ITEM = re.compile(r"(?:(?:pub(?:\s*\([^)\n]*\))?|export|default|async|unsafe|abstract|declare)\s+)*(?:fn|func|function|class|impl|struct|enum|trait|interface|mod|type)\b")
_BRACKET = re.compile(r"[()\[\]{}]")


def _matched(b: str) -> tuple[dict[int, int], bool]:
    """The place after the bracket that closes each one; whether all balance."""
    ends, open_, strays = {}, [], False
    for m in _BRACKET.finditer(b):
        if m[0] in "([{":
            open_.append(m.start())
        elif open_:
            ends[open_.pop()] = m.end()
        else:
            strays = True
    return ends, not open_ and not strays


def _repaired(b: str) -> dict[int, int]:
    """The same by indentation: where an item or a line's closing bracket starts, what was opened on lines that are indented as far (further, for a bracket) has ended, and
    a closing bracket that is indented further than what is open closes nothing. So a bracket too few or too many ends with its item."""
    ends, open_, at = {}, [], 0  # open_: place, indent of its line

    def end_before(place: int) -> None:
        end = at
        while end > place + 1 and b[end - 1].isspace():
            end -= 1
        ends[place] = end

    for line in b.splitlines(keepends=True):
        indent = len(line) - len(line.lstrip(" \t"))
        if item := bool(_ITEM.match(line, indent)):
            while open_ and open_[-1][1] >= indent:
                end_before(open_.pop()[0])
        elif closes := line[indent : indent + 1] in ")]}" and line[indent : indent + 1] != "":
            while open_ and open_[-1][1] > indent:
                end_before(open_.pop()[0])
        for m in _BRACKET.finditer(line):
            if m[0] in "([{":
                open_.append((at + m.start(), indent))
            elif open_ and (item or not (closes and m.start() == indent) or open_[-1][1] >= indent):
                ends[open_.pop()[0]] = at + m.end()
        at += len(line)
    return ends


@lru_cache(maxsize=2)
def _ends(b: str) -> dict[int, int]:
    ends, whole = _matched(b)
    return ends if whole else _repaired(b)


def close(b: str, at: int) -> int:
    """The place after the bracket that closes the one at `at`; brackets of a text are matched once."""
    return _ends(b).get(at, len(b))


def end_of(b: str, at: int, stop: str = ";{") -> tuple[int, int]:
    """The end of an item that starts at `at`, and the place of its block's brace (-1 without one)."""
    i = at
    while i < len(b):
        c = b[i]
        if c == "{" and "{" in stop:
            return close(b, i), i
        if c in stop:
            return i + 1, -1
        if c in "([{":
            i = close(b, i)
            continue
        if c in ")]}":
            return i, -1
        i += 1
    return len(b), -1


def split_top(s: str, b: str, sep: str = ",") -> list[str]:
    """Parts of s between separators outside brackets (by its blanked form b)."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(b):
        depth += (c in "([{<") - (c in ")]}" or (c == ">" and b[i - 1 : i] not in "-="))
        if c == sep and depth == 0:
            out.append(s[last:i])
            last = i + 1
    return [x.strip() for x in [*out, s[last:]] if x.strip()]


def fingerprint(blanked: str) -> list[int]:
    trail, depth = [], 0
    for t in _TOKEN.findall(blanked):
        depth -= t in ")]}"
        kind = _KEYWORDS.get(t) or (1 if t[0].isalpha() or t[0] == "_" else 2 if t[0].isdigit() else 100 + ord(t[0]) % 800)
        trail.append((min(max(depth, 0), 63) << 10) | (kind & 0x3FF))
        depth += t in "([{"
    return sorted({_window(*w) for w in zip(trail, trail[1:], trail[2:], strict=False)})


@lru_cache(maxsize=1 << 16)
def _window(*values: int) -> int:
    """FNV-1a of the values, as a signed long."""
    h = 0xCBF29CE484222325
    for v in values:
        h = (h ^ v) * 0x100000001B3 % 2**64
    return h - 2**64 if h >= 2**63 else h


class File:
    def __init__(self, path: str, src: str, lang: str):
        self.path, self.src, self.lang = path, src, lang
        self.b = blank_python(src) if lang == "python" else blank(src, lang)
        self.rows: list[dict] = []
        self.spans: list[tuple[int, int, str]] = []  # of functions: start, end, what callers are called
        self.names: set[int] = set()  # where functions' names stand in their definitions
        self.lines = src.split("\n")
        self.starts = list(accumulate((len(x) + 1 for x in self.lines), initial=0))

    def line(self, at: int) -> int:
        return min(bisect_right(self.starts, at), len(self.lines))

    def defines(self, start: int, end: int, caller: str, name_at: int) -> None:
        self.spans.append((start, end, caller))
        self.names.add(name_at)

    def emit(self, kind: str, name: str, start: int, end: int, parent: str | None = None, visibility: str = "Unknown", params: list | None = None, ret: str | None = None, sep: str = "::", first: int | None = None, print_: bool = True) -> None:
        params = params or []
        shown = ", ".join(n + (f": {t}" if t else "") for n, t in params)
        self.rows.append({
            "file_path": self.path, "ord": len(self.rows), "kind": kind, "name": name, "qualified_name": f"{parent}{sep}{name}" if parent else name, "line_start": first or self.line(start), "line_end": self.line(max(start, end - 1)),
            "signature": f"{name}({shown})" + (f" -> {ret}" if ret else "") if kind in ("Function", "Method") else "", "body_text": self.src[start:end], "parent": parent, "visibility": visibility,
            "parameters": [{"name": n, "type_annotation": t} for n, t in params], "return_type": ret, "ast_fingerprint": fingerprint(self.b[start:end]) if print_ else [],
        })

    def parens(self, at: int) -> tuple[int, int]:
        s = self.b.find("(", at)
        return (s, close(self.b, s)) if s >= 0 else (at, at)


# Rust

_RUST = re.compile(r"(?P<vis>\bpub(?:\s*\([^)]*\))?\s+)?(?:(?:default|async|unsafe|const|extern(?:\s+\"[^\"]*\")?)\s+)*\b(?P<what>fn|struct|enum|trait|impl|const|static|type|mod|union)\b(?:\s+mut\b)?(?=[\s<])")


def rust(f: File, s: int, e: int, parent: str | None = None) -> None:
    at = s
    while m := _RUST.search(f.b, at, e):
        what, start = m["what"], m.start()
        end, brace = end_of(f.b, m.end(), ";" if what in ("const", "static", "type") else ";{")
        at = max(end, m.end())
        vis = "Crate" if m["vis"] and "crate" in m["vis"] else "Public" if m["vis"] else "Private"
        named = re.compile(r"\s*([A-Za-z_]\w*)").match(f.b, m.end())
        if what == "impl":
            head = f.src[m.end() : brace if brace >= 0 else end]
            if head.lstrip().startswith("<"):
                lead = len(head) - len(head.lstrip())
                depth, i = 0, lead
                while i < len(head):
                    depth += (head[i] == "<") - (head[i] == ">" and head[i - 1] != "-")
                    i += 1
                    if depth == 0:
                        break
                head = head[i:]
            kind = re.split(r"\bwhere\b", re.split(r"\bfor\b(?!\s*<)", head)[-1])[0].strip()
            rust(f, brace + 1, end - 1, kind)
        elif what == "mod":
            if brace >= 0:
                rust(f, brace + 1, end - 1, parent)
        elif named and what == "fn":
            o, c = f.parens(named.end())
            params = []
            for p in split_top(f.src[o + 1 : c - 1], f.b[o + 1 : c - 1]):
                n, _, t = p.partition(":")
                params.append((n.strip(), t.strip() or None))
            arrow = re.compile(r"\s*->\s*").match(f.b, c)
            stop = brace if brace >= 0 else end - 1
            ret = re.split(r"\bwhere\b", f.src[arrow.end() : stop])[0].strip() if arrow else None
            f.emit("Method" if parent else "Function", named[1], start, end, parent, vis, params, ret)
            f.defines(start, end, f"{parent}::{named[1]}" if parent else named[1], named.start(1))
            if brace >= 0:
                rust(f, brace + 1, end - 1, parent)
        elif named:
            kind = {"struct": "Struct", "union": "Struct", "enum": "Enum", "trait": "Trait", "const": "Constant", "static": "Constant", "type": "TypeAlias"}[what]
            f.emit(kind, named[1], start, end, parent if kind == "Constant" else None, vis)
            if what == "trait" and brace >= 0:
                rust(f, brace + 1, end - 1, named[1])


# Go

_GO = re.compile(r"\b(?P<what>func|type|const|var)\b")


def go(f: File, s: int, e: int) -> None:
    seen = lambda n: "Public" if n[:1].isupper() else "Private"
    at = s
    while m := _GO.search(f.b, at, e):
        at = m.end()
        if m["what"] == "func":
            n = re.compile(r"\s*(?:\((?P<recv>[^)]*)\)\s*)?(?P<name>[A-Za-z_]\w*)\s*(?=[(\[])").match(f.b, m.end())
            if not n:
                continue
            o, c = f.parens(n.end() - 1)
            end, brace = end_of(f.b, c, "\n{")
            params = []
            for p in split_top(f.src[o + 1 : c - 1], f.b[o + 1 : c - 1]):
                w = p.split(None, 1)
                params.append((w[0], w[1] if len(w) > 1 else None))
            ret = f.src[c : brace if brace >= 0 else end].strip() or None
            recv = n["recv"].split()[-1].lstrip("*").split("[")[0] if n["recv"] and n["recv"].strip() else None
            f.emit("Method" if recv else "Function", n["name"], m.start(), end, recv, seen(n["name"]), params, ret)
            f.defines(m.start(), end, f"{recv}::{n['name']}" if recv else n["name"], n.start("name"))
            if brace >= 0:
                go(f, brace + 1, end - 1)
            at = max(end, at)
            continue
        group = re.compile(r"\s*\(").match(f.b, m.end())
        parts = []
        if group:
            stop = close(f.b, group.end() - 1)
            i = group.end()
            while i < stop - 1:
                j, _ = end_of(f.b, i, ";\n")
                parts.append((i, min(j, stop - 1)))
                i = max(j, i + 1)
            at = stop
        else:
            j, _ = end_of(f.b, m.end(), ";\n")
            parts.append((m.end(), j))
            at = max(j, at)
        for i, j in parts:
            n = re.compile(r"\s*([A-Za-z_]\w*)(?:\s*\[[^\]]*\])?\s*(=\s*)?(struct|interface)?").match(f.b, i, j)
            if not n:
                continue
            end = len(f.src[:j].rstrip(" \n;"))
            if m["what"] == "type":
                f.emit({"struct": "Struct", "interface": "Interface"}.get(n[3], "TypeAlias"), n[1], n.start(1), end, None, seen(n[1]))
            else:
                f.emit("Constant", n[1], n.start(1), end)


# TypeScript and JavaScript

_TS = re.compile(r"(?P<export>\bexport\s+(?P<default>default\s+)?)?(?:(?:declare|abstract|async)\s+)*\b(?P<what>function\b\s*\*?|class\b|interface\b|type\b(?=\s+\w+[\s<=])|enum\b|const\s+enum\b|const\b|let\b)|(?P<only>\bexport\s+default\s+)")
_METHOD = re.compile(r"(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s+)*\*?\s*(?P<name>#?[A-Za-z_$][\w$]*)\s*(?:<[^>(]*>)?(?=\()")


def _comment_line(f: File, start: int) -> int:
    """The line of a comment that ends right before an item, else the item's own."""
    end = start
    while end and f.src[end - 1].isspace():
        end -= 1
    if end > 1 and f.src.startswith("*/", end - 2) and (head := f.src.rfind("/*", 0, end)) >= 0:
        return f.line(head)
    at = f.line(start)
    while at > 1 and f.lines[at - 2].lstrip().startswith("//"):
        at -= 1
    return at


def _ts_params(f: File, o: int, c: int) -> tuple[list, str | None]:
    params = []
    if f.lang != "javascript":
        for p in split_top(f.src[o + 1 : c - 1], f.b[o + 1 : c - 1]):
            n, _, t = p.partition("=")[0].partition(":")
            params.append((n.strip().rstrip("?").strip(), t.strip() or None))
    m = re.compile(r"\s*:\s*").match(f.b, c)
    if not m:
        return params, None
    i = m.end()
    while i < len(f.b) and not (f.b[i] == "{" and f.b[m.end() : i].strip()) and f.b[i] not in ";\n" and f.b[i : i + 2] != "=>":
        i = close(f.b, i) if f.b[i] in "([{" else i + 1
    return params, f.src[m.end() : i].strip() or None


def typescript(f: File) -> None:
    at = 0
    while m := _TS.search(f.b, at):
        start = m.start()
        vis = "Public" if m["export"] or m["only"] else "Private"
        first = _comment_line(f, start)
        if m["only"]:
            end, _ = end_of(f.b, m.end(), ";")
            f.emit("Constant", "default", start, end, None, vis, first=first)
            at = max(end, m.end())
            continue
        what = m["what"].split()[-1].rstrip("*").strip() or "function"
        n = re.compile(r"\s*([A-Za-z_$][\w$]*)").match(f.b, m.end())
        own = m.end("export") if m["export"] else start
        if what in ("function", "class", "interface", "enum"):
            name = n[1] if n else "default"
            end, brace = end_of(f.b, m.end())
            if what == "function":
                o, c = f.parens(m.end())
                params, ret = _ts_params(f, o, c)
                end, brace = end_of(f.b, c)
                f.emit("Function", name, own, end, None, vis, params, ret, first=first)
                f.defines(own, end, name, n.start(1) if n else own)
            else:
                f.emit({"class": "Class", "interface": "Interface", "enum": "Enum"}[what], name, own, end, None, vis, first=first)
                i = brace + 1
                while what == "class" and brace >= 0 and i < end - 1:
                    k = _METHOD.match(f.b, i)
                    if not k or k["name"] in NOT_CALLED:
                        i = close(f.b, i) if f.b[i] in "([{" else i + 1
                        continue
                    o, c = f.parens(k.end("name"))
                    params, ret = _ts_params(f, o, c)
                    stop, _ = end_of(f.b, c)
                    f.emit("Method", k["name"], k.start(), stop, name, "Public", params, ret, ".", _comment_line(f, k.start()))
                    f.defines(k.start(), stop, k["name"], k.start("name"))
                    i = max(stop, i + 1)
            at = max(end, m.end())
            continue
        end, _ = end_of(f.b, m.end(), ";\n" if what != "type" else ";")
        while what != "type" and end < len(f.b) and f.b[end - 1] == "\n" and re.search(r"(=>|=|,|\()\s*$", f.b[m.end() : end]):
            end, _ = end_of(f.b, end, ";\n")
        stop = len(f.src[:end].rstrip("\n"))
        if what == "type":
            if n:
                f.emit("TypeAlias", n[1], own, stop, None, vis, first=first)
        else:
            for part in split_top(f.src[m.end() : stop], f.b[m.end() : stop]):
                d = re.match(r"([A-Za-z_$][\w$]*)", part)
                if not d:
                    continue
                value = part.partition("=")[2].lstrip()
                called = re.match(r"(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]*)?=>|[A-Za-z_$][\w$]*\s*=>)", value)
                params, ret = [], None
                if called and "(" in called[0]:
                    o, c = f.parens(f.b.find("=", m.end()))
                    params, ret = _ts_params(f, o, c)
                f.emit("Function" if called else "Constant", d[1], own, stop, None, vis, params, ret, first=first)
                if called:
                    f.spans.append((own, stop, d[1]))
        at = max(stop, m.end())


# Python


def python(f: File) -> list[tuple[str, str, int]]:
    tree = ast.parse(f.src)
    lines = f.src.splitlines(keepends=True)
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x))
    seen = lambda n: "Private" if n.startswith("_") else "Public"

    def place(line: int, col: int) -> int:
        return starts[line - 1] + len(lines[line - 1].encode()[:col].decode(errors="ignore"))

    def add(node: ast.stmt, parent: str | None) -> None:
        s, e = place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset)
        if isinstance(node, ast.ClassDef):
            f.emit("Class", node.name, s, e, None, seen(node.name))
            for x in node.body:
                add(x, node.name)
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            every = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
            params = [(a.arg, ast.unparse(a.annotation) if a.annotation else None) for a in every if a.arg not in ("self", "cls")]
            f.emit("Method" if parent else "Function", node.name, s, e, parent, seen(node.name), params, ast.unparse(node.returns) if node.returns else None, ".")

    for x in tree.body:
        add(x, None)
    calls = []

    class Visit(ast.NodeVisitor):
        inside: list[str] = []

        def visit_FunctionDef(self, node):
            self.inside = [*self.inside, node.name]
            self.generic_visit(node)
            self.inside = self.inside[:-1]

        visit_AsyncFunctionDef = visit_FunctionDef

        def visit_Call(self, node):
            callee = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
            if self.inside and callee:
                calls.append((self.inside[-1], callee, node.lineno))
            self.generic_visit(node)

    Visit().visit(tree)
    return calls


def python_text(f: File) -> None:
    """Symbols of a file that doesn't parse: def and class lines, each with the lines after it that are indented further."""
    width = lambda line: len(line[: len(line) - len(line.lstrip())].expandtabs(8))
    blanked = f.b.split("\n")
    open_: list[tuple[int, str, str]] = []  # indent, kind and name of the blocks around

    def end_of_block(indent: int, at: int) -> int:
        """The end of the last line after the one of at that is indented further, without those that hold nothing."""
        last = n = f.line(at)
        while n < len(blanked) and (not blanked[n].strip() or width(blanked[n]) > indent):
            n += 1
            last = n if f.lines[n - 1].strip() else last
        return f.starts[last] - 1

    for m in re.finditer(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+([A-Za-z_]\w*)([ \t]*\([^\n]*)?", f.b, re.M):
        indent, name = width(m[0]), m[3]
        open_ = [x for x in open_ if x[0] < indent]
        o = m.end(3) + len(m[4]) - len(m[4].lstrip()) if m[4] else m.end(3)
        c = close(f.b, o) if m[4] else o
        if f.b.find("\n", o, c) >= 0 and re.search(r"\n[ \t]*(def|class)\b", f.b[o:c]):  # the bracket isn't closed
            c = f.starts[f.line(o)] - 1
        inside = [k for _, k, _ in open_]
        parent = open_[-1][2] if inside and inside[-1] == "class" else None
        start, end, vis = m.end(1), end_of_block(indent, max(c - 1, o)), "Private" if name.startswith("_") else "Public"
        if m[2] == "class" and "def" not in inside:
            f.emit("Class", name, start, end, None, vis)
        elif m[2] == "def":
            if "def" not in inside:
                params = []
                for x in split_top(f.src[o + 1 : c - 1], f.b[o + 1 : c - 1]):
                    n, _, t = x.partition("=")[0].partition(":")
                    if re.fullmatch(r"[A-Za-z_]\w*", n.strip()) and n.strip() not in ("self", "cls"):
                        params.append((n.strip(), t.strip() or None))
                arrow = re.compile(r"\s*->\s*([^:\n]+):").match(f.src, c)
                f.emit("Method" if parent else "Function", name, start, end, parent, vis, params, arrow[1].strip() if arrow else None, ".")
            f.defines(start, end, name, m.start(3))
        open_.append((indent, m[2], name))


def _calls(f: File) -> list[tuple[str, str, int]]:
    generic = r"::<[^<>()]*(?:<[^<>()]*>[^<>()]*)*>"
    scoped = rf"(?:[A-Za-z_]\w*(?:{generic})?::)*" if f.lang == "rust" else ""
    call = re.compile(rf"\b(?P<name>{scoped}[A-Za-z_$][\w$]*)\s*(?:{generic}|<[^<>()]*>)?\((?<!!\()")
    braces = f.lang in ("typescript", "tsx", "javascript")
    rows, around, spans = [], [], sorted(f.spans, key=lambda x: (x[0], -x[1]))
    at = 0
    for m in call.finditer(f.b):
        p, name = m.start("name"), m["name"]
        while at < len(spans) and spans[at][0] <= p:
            around.append(spans[at])
            at += 1
        around = [x for x in around if x[1] > p]
        if not around or p in f.names or name.split("::")[-1] in NOT_CALLED or re.search(r"\b(?:fn|func|function|def|class)\s*\*?\s*$", f.b[max(0, p - 12) : p]):
            continue
        if braces and re.compile(r"\s*\{").match(f.b, close(f.b, m.end() - 1)):  # a method of an object literal
            continue
        rows.append((around[-1][2], name, f.line(p)))
    return rows


def parse(path: str, src: str, lang: str) -> tuple[list[dict], list[tuple[str, str, int]]]:
    """Symbols and calls of a file; both empty if it can't be read."""
    try:
        f = File(path, src, lang)
        if lang == "python":
            try:
                calls = python(f)
            except (SyntaxError, ValueError, RecursionError):
                f = File(path, src, lang)
                python_text(f)
                calls = _calls(f)
            return f.rows, calls
        {"rust": lambda: rust(f, 0, len(f.b)), "go": lambda: go(f, 0, len(f.b))}.get(lang, lambda: typescript(f))()
        return f.rows, _calls(f)
    except (SyntaxError, ValueError, RecursionError):
        return [], []


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple[str, str, str]]]:
    """path, content and language of FILES files at a time, so that no batch's rows are held together."""
    for pdf in batches:
        for at in range(0, len(pdf), FILES):
            yield list(_each(pdf.iloc[at : at + FILES]))


def _each(pdf: pd.DataFrame):
    for path, content, lang in zip(pdf["path"], pdf["content"], pdf["language"], strict=True):
        raw = bytes(content).decode("utf-8", "replace") if not isinstance(content, str) else content
        yield path, raw, lang


def _sources(files: DataFrame) -> DataFrame:
    """Supported files only, over all cores, before any Python runs; scripts of Svelte files stand for the whole."""
    known = spread(files.select("path", "content", text.language("path").alias("language")).where("language IS NOT NULL"), "path")
    svelte = F.col("path").endswith(".svelte")
    script = text.script_blocks(F.decode("content", "UTF-8") if dict(files.dtypes)["content"] == "binary" else F.col("content"))
    body = F.when(svelte, F.coalesce(script, F.col("content").cast("string"))).otherwise(F.col("content").cast("string"))
    return known.select("path", body.alias("content"), "language")


def extract_symbols(files: DataFrame) -> DataFrame:
    """files: path, content. All symbols with normalised bodies and hashes; sym_id is unique and numbers a file's in their order.

    They are written once, so that the numbers, which are given out by partition, stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _parts(batches):
            if rows := [r for x in part for r in parse(*x)[0]]:
                yield pd.DataFrame(rows)

    raw = _sources(files).mapInPandas(run, RAW)
    norm = raw.withColumn("normalized_body", text.normalize_body("body_text")).withColumn("body_hash", text.body_hash("normalized_body"))
    return stage(norm.withColumn("sym_id", F.monotonically_increasing_id()), "symbols")


def extract_calls(files: DataFrame) -> DataFrame:
    """caller, callee, file_path, line of all calls inside functions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _parts(batches):
            if rows := [(a, b, x[0], n) for x in part for a, b, n in parse(*x)[1]]:
                yield pd.DataFrame(rows, columns=["caller", "callee", "file_path", "line"])

    return _sources(files).mapInPandas(run, CALLS)
