import time

from codestrata.operators import extract

RUST = '''
use x::y;
/// doc { not a brace
pub struct P { a: i32 }
pub(crate) enum E { A, B }
const N: usize = 3;
impl<T: Clone> Shape for P<T> {
    pub fn area(&self, w: i32) -> i32 { helper(w) + self.scale(w) + m::n::k(1) }
}
trait Tr { fn req(&self) -> bool; }
mod inner { fn helper(v: i32) -> i32 { println!("{}", v); fn nested() {} v } }
'''
GO = '''package main
import "fmt"
const A, B = 1, 2
type (
	S struct { x int }
	I interface { M() }
)
type Name string
func (s *S) Do(a int, b string) error { fmt.Println(a); var local = 1; return helper(local) }
func helper(x int) error { return nil }
'''
TS = '''
/** doc */
export function add(a: number, b?: string): number { return mul(a, 1); }
export const twice = (x: number) => add(x, x);
let limit = 5;
class Box { private n = 1; get(k: string): number { return this.find(k); } static make() { return new Box(); } }
export interface Shape { area(): number }
type Id = string;
enum Color { Red }
export default limit;
'''
PY = '''
@deco
def top(a, b: int = 1) -> str:
    def inner():
        return other(a)
    return inner()
class C:
    def m(self, x): return self.top(x)
    def _p(self): pass
'''


def names(path, src, lang):
    rows, calls = extract.parse(path, src, lang)
    return [(r["kind"], r["qualified_name"], r["visibility"]) for r in rows], [(a, b) for a, b, _ in calls], rows


def test_rust():
    syms, calls, rows = names("a.rs", RUST, "rust")
    assert syms == [("Struct", "P", "Public"), ("Enum", "E", "Crate"), ("Constant", "N", "Private"), ("Method", "P<T>::area", "Public"), ("Trait", "Tr", "Private"), ("Method", "Tr::req", "Private"), ("Function", "helper", "Private"), ("Function", "nested", "Private")]
    assert ("P<T>::area", "helper") in calls and ("P<T>::area", "scale") in calls and ("P<T>::area", "m::n::k") in calls
    area = rows[3]
    assert area["signature"] == "area(&self, w: i32) -> i32" and area["return_type"] == "i32" and area["line_start"] == 8
    assert rows[5]["return_type"] == "bool" and len(area["ast_fingerprint"]) > 5


def test_go():
    syms, calls, rows = names("a.go", GO, "go")
    assert syms == [("Constant", "A", "Unknown"), ("Struct", "S", "Public"), ("Interface", "I", "Public"), ("TypeAlias", "Name", "Public"), ("Method", "S::Do", "Public"), ("Constant", "local", "Unknown"), ("Function", "helper", "Private")]
    assert calls == [("S::Do", "Println"), ("S::Do", "helper")]
    assert [p["name"] for p in rows[4]["parameters"]] == ["a", "b"] and rows[4]["return_type"] == "error"


def test_typescript():
    syms, calls, rows = names("a.ts", TS, "typescript")
    assert syms == [("Function", "add", "Public"), ("Function", "twice", "Public"), ("Constant", "limit", "Private"), ("Class", "Box", "Private"), ("Method", "Box.get", "Public"), ("Method", "Box.make", "Public"), ("Interface", "Shape", "Public"), ("TypeAlias", "Id", "Private"), ("Enum", "Color", "Private"), ("Constant", "default", "Public")]
    assert ("add", "mul") in calls and ("twice", "add") in calls and ("get", "find") in calls
    assert rows[0]["line_start"] == 2 and rows[0]["return_type"] == "number" and [p["name"] for p in rows[0]["parameters"]] == ["a", "b"]


def test_python():
    syms, calls, rows = names("a.py", PY, "python")
    assert syms == [("Function", "top", "Public"), ("Class", "C", "Public"), ("Method", "C.m", "Public"), ("Method", "C._p", "Private")]
    assert calls == [("inner", "other"), ("top", "inner"), ("m", "top")]
    assert rows[0]["body_text"].startswith("def top") and rows[0]["return_type"] == "str"
    assert extract.parse("b.py", "def (", "python") == ([], [])


def test_frames(spark):
    files = spark.createDataFrame([("a.rs", RUST.encode()), ("b.py", PY.encode()), ("c.txt", b"x"), ("d.py", b"def ("), ("e.svelte", b"<script>function s(){t()}</script>")], "path string, content binary")
    s = extract.extract_symbols(files).collect()
    assert len(s) == 8 + 4 + 1 and len({r.sym_id for r in s}) == len(s)
    assert ("s", "t") in {(r.caller, r.callee) for r in extract.extract_calls(files).collect()}


def calls_of(path, src, lang):
    return [(a, b) for a, b, _ in extract.parse(path, src, lang)[1]]


def names_of(path, src, lang):
    return [(r["kind"], r["qualified_name"]) for r in extract.parse(path, src, lang)[0]]


def test_definitions_are_not_calls():
    go = "package p\nfunc (s *S[T]) M(x int) int { return s.N(x) }\nfunc f() { g(M) }\n"
    assert calls_of("a.go", go, "go") == [("S::M", "N"), ("f", "g")]
    ts = "class A {\n  get v() { return this.w(); }\n  async run(x) { const o = { inner() { return launch(x); } }; return o; }\n}\n"
    assert calls_of("a.ts", ts, "typescript") == [("v", "w"), ("run", "launch")]


def test_regular_expressions_hide_their_brackets():
    ts = "function t() { return /[{]/.test('a') }\nfunction u(s) { const r = s.replace(/\\/\"{/g, ''); return a / b / c(r) }\n"
    assert names_of("a.ts", ts, "typescript") == [("Function", "t"), ("Function", "u")]
    assert calls_of("a.ts", ts, "typescript") == [("t", "test"), ("u", "replace"), ("u", "c")]


def test_scoped_paths_keep_their_segments():
    rust = "impl P { fn m(&self) { Foo::<u8>::a(1); Self::b(); crate::x::y(); self.c::<Vec<u8>>(); mac!(no) } }\n"
    assert calls_of("a.rs", rust, "rust") == [("P::m", "Foo::<u8>::a"), ("P::m", "Self::b"), ("P::m", "crate::x::y"), ("P::m", "c")]


BROKEN = '''import os

def one(a: int, b='x(') -> int:
    return two(a)

class C(Base):
    def m(self, k):
        def inner():
            return deep()
        return self.n(k)

    async def n(self):
        pass

def broken(:
    x = = 1
    call(1)

def last():
    """def no(): pass"""
    return one(1)
'''


def test_python_with_a_syntax_error_keeps_its_symbols():
    assert names_of("a.py", BROKEN, "python") == [("Function", "one"), ("Class", "C"), ("Method", "C.m"), ("Method", "C.n"), ("Function", "broken"), ("Function", "last")]
    rows = {r["name"]: r for r in extract.parse("a.py", BROKEN, "python")[0]}
    assert rows["one"]["signature"] == "one(a: int, b) -> int" and (rows["one"]["line_start"], rows["one"]["line_end"]) == (3, 4)
    assert rows["m"]["body_text"].endswith("return self.n(k)") and rows["last"]["line_end"] == 21
    assert calls_of("a.py", BROKEN, "python") == [("one", "two"), ("inner", "deep"), ("m", "n"), ("broken", "call"), ("last", "one")]


def test_time_grows_with_the_functions():
    def took(n):
        src = "".join(f"// c\nexport function f{i}(x: number): number {{\n  return f{i + 1}(x);\n}}\n" for i in range(n))
        began = time.perf_counter()
        rows, calls = extract.parse("a.ts", src, "typescript")
        assert len(rows) == len(calls) == n
        return time.perf_counter() - began

    took(200)
    assert took(4000) < 14 * took(500)


def kept_names(path, src, lang):
    return [r["name"] for r in extract.parse(path, src, lang)[0]]


UNBALANCED = {
    "rust": ("a.rs", "fn one(a: i32) -> i32 {\n    if a > 0 {\n        a\n    \n}\n\npub fn two() { one(1) }\n\nimpl S {\n    fn three(&self) -> i32 {\n        while x {\n            y(z);\n    }\n\n    pub fn four(&self) { two() }\n}\n\nstruct Five { a: u8 }\n", ["one", "two", "three", "four", "Five"]),
    "go": ("a.go", "package p\n\nfunc One(a int) int {\n\tif a > 0 {\n\t\treturn a\n\treturn 1\n}\n\nfunc Two() int { return One(1) }\n\ntype Three struct {\n\tx int\n\nfunc Four() {\n\tTwo()\n}\n", ["One", "Two", "Three", "Four"]),
    "typescript": ("a.ts", "export function one(a: number) {\n  if (a) {\n    return two(\n  }\n}\n\nclass Three {\n  four(): number {\n    for (;;) {\n    return 1;\n  }\n\n  five() { return one(1); }\n}\n\nexport function six() { return 6; }\n", ["one", "Three", "four", "five", "six"]),
}


def test_a_missing_bracket_keeps_the_other_symbols():
    for lang, (path, src, want) in UNBALANCED.items():
        assert kept_names(path, src, lang) == want, lang


def test_a_stray_bracket_keeps_the_other_symbols():
    assert kept_names("a.rs", "impl S {\n    fn one(&self) {\n        x();\n        }\n    }\n\n    fn two(&self) { y(); }\n}\n\nfn three() {}\n", "rust") == ["one", "two", "three"]
    assert kept_names("a.rs", "}\nfn one() {}\n)\nfn two() { one() }\n", "rust") == ["one", "two"]


def test_nested_calls_take_linear_time():
    took = {}
    for n in (4000, 32_000):
        src = "function f(): number {\n  return " + "g(" * n + "1" + ")" * n + ";\n}\n"
        began = time.monotonic()
        rows, calls = extract.parse("a.ts", src, "typescript")
        took[n] = time.monotonic() - began
        assert len(rows) == 1 and len(calls) == n
    assert took[32_000] < 10
