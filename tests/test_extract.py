import pytest

from strataquery.sources import extract, extract_lexical, extract_python


def python(code):
    defined, found, errors = extract_python.extract(code.encode())
    assert not errors
    data = code.encode()
    for r in [*defined, *found]:
        assert 0 <= r["start"] <= r["end"] <= len(data)
    return defined, found


def kinds(found):
    return [(r["kind"], r["target"]) for r in found]


def test_python_definitions():
    code = "import x\n\n@deco\nclass A(B):\n    def m(self, a, /, b, *c, d, e=1, **f):\n        def inner():\n            pass\n\nasync def top(): pass\n"
    defined, _ = python(code)
    assert [(d["kind"], d["qualified"], d["parent"]) for d in defined] == [("class", "A", None), ("method", "A.m", "A"), ("function", "A.m.inner", "A.m"), ("function", "top", None)]
    assert code[defined[0]["start"] :].startswith("@deco")
    assert [(p["name"], p["kind"], p["required"]) for p in defined[1]["parameters"]] == [("self", "positional_only", True), ("a", "positional_only", True), ("b", "positional", True), ("c", "variadic", False), ("d", "keyword_only", True), ("e", "keyword_only", False), ("f", "keyword_variadic", False)]


def test_python_references():
    code = "import a.b as c, d\nfrom ..e import f as g, h\n__all__ = ['z']\nx: List[int] = g(1, *y, k=2, **w)\nself.q = c.r\n@dec(1)\nclass K(Base, mod.Other[T]): pass\n"
    _, found = python(code)
    rows = {(r["kind"], r["target"]): r for r in found}
    assert rows["import", "a.b"]["alias"] == "c" and rows["import", "f"]["module"] == "..e" and rows["import", "f"]["written"] == "g"
    assert rows["call", "g"]["shape"] == {"positional_count": 1, "keywords": ["k"], "has_positional_spread": True, "has_keyword_spread": True, "type_argument_count": 0, "is_constructor": False}
    assert ("export", "z") in rows and ("type_use", "List") in rows and ("write", "self.q") in rows and rows["read", "c.r"]["receiver"] == "c"
    assert ("inheritance", "Base") in rows and ("inheritance", "mod.Other") in rows and ("decorator", "dec") in rows


def test_python_offsets_are_bytes():
    code = "é = 'ü'\nname(é)\n"
    _, found = python(code)
    call = next(r for r in found if r["kind"] == "call")
    assert code.encode()[call["start"] : call["end"]] == b"name"


@pytest.mark.parametrize("data", [b"def x(:", b"\xef\xbb\xbfdef f(): pass", b"", b"\r\nclass A:\r\n  x = 1\r\n"])
def test_python_odd_sources(data):
    defined, found, errors = extract_python.extract(data)
    assert errors == (data == b"def x(:")
    if b"def f" in data:
        assert data[defined[0]["start"] :].startswith(b"def f")


def test_script_facts():
    code = """
import def, { a as b, type C } from './m';
import * as ns from "../n";
export { b as default, q } from './r';
export * from './s';
@Comp()
export class K extends ns.Base implements I, J<T> {
  m(x: Foo, { y }, z = 1, ...rest) { return new Thing(x, ...rest); }
}
const fn = async (p) => { ns.call(p); fn.count = 1; };
// import fake from 'no'
const s = "class NotOne {}";
export default function main<T>(v?: T) { return b(v); }
"""
    defined = extract_lexical.definitions(code, "typescript")
    assert [(d["kind"], d["qualified"]) for d in defined] == [("class", "K"), ("method", "K.m"), ("function", "fn"), ("function", "main")]
    assert [(p["name"], p["kind"], p["destructured"]) for p in defined[1]["parameters"]] == [("x", "positional", False), ("{ y }", "positional", True), ("z", "positional", False), ("rest", "variadic", False)]
    rows = {(r["kind"], r["target"], r["written"]): r for r in extract_lexical.references(code, "typescript", defined)}
    for key in [("import", "a", "b"), ("import", "def", "def"), ("import", "*", "ns"), ("export", "b", "default"), ("export", "*", "*"), ("decorator", "Comp", "Comp"), ("inheritance", "ns.Base", "ns.Base"), ("type_use", "I", "I"), ("call", "Thing", "Thing"), ("call", "ns.call", "ns.call"), ("write", "fn.count", "fn.count"), ("type_use", "Foo", "Foo"), ("call", "b", "b")]:
        assert key in rows, (key, sorted(rows))
    assert rows["call", "Thing", "Thing"]["shape"]["is_constructor"] and rows["call", "Thing", "Thing"]["shape"]["has_positional_spread"]
    assert not any(r["module"] == "no" for r in rows.values())


@pytest.mark.parametrize(
    "language,code,names",
    [
        ("go", "package p\nfunc F(x int) {}\nfunc (r *T) M() { }\ntype T struct {\n a int\n}\n", ["F", "M", "T"]),
        ("rust", "struct S;\nimpl S {\n fn new() -> S { S }\n}\nfn main() {}\n", ["S", "S", "S.new", "main"]),
        ("java", "public class A {\n  public int f(int x) { return x; }\n  enum E { X }\n}\n", ["A", "A.f", "A.E"]),
        ("c", "int add(int a, int b) {\n return a + b;\n}\nstruct P { int x; };\n", ["add", "P"]),
        ("lua", "function a.b(x)\n if x then return 1 end\nend\n", ["a.b"]),
        ("sql", "CREATE TABLE t (a int);\nCREATE VIEW v AS SELECT 1;\n", ["t", "v"]),
        ("yaml", "a: 1\nb:\n  c: 2\n", ["a", "b"]),
        ("json", '{\n  "k": 1,\n  "l": [2]\n}\n', ["k", "l"]),
        ("terraform", 'resource "x" "y" {\n a = 1\n}\nvariable "z" {}\n', ["y", "z"]),
        ("gdscript", "class_name A\nsignal hit\nfunc go():\n  pass\nvar x = 1\n", ["A", "hit", "go", "x"]),
        ("csharp", "public class A {\n  public int P { get; set; }\n  public void M() { }\n}\n", ["A", "A.P", "A.M"]),
        ("cpp", "class A {\n};\nint A::f(int x) {\n return x;\n}\n", ["A", "A::f"]),
    ],
)
def test_other_languages(language, code, names):
    assert [d["qualified"] for d in extract_lexical.definitions(code, language)] == names


@pytest.mark.parametrize("language", sorted(extract_lexical.HEADS))
@pytest.mark.parametrize("code", ["", "\n", "{" * 50, "'\"`", "é" * 10, "func class function struct", "/* open", "x" * 10_000])
def test_odd_sources_never_fail(language, code):
    extract_lexical.extract(code.encode(), language)


def test_chunks_cover_the_file():
    code = b"import a\n\nclass A:\n    x = 1\n    def m(self):\n        return 1\n\ny = 2\n" + b"def long():\n" + b"    z = 1\n" * 900
    defined, _, _ = extract_python.extract(code)
    chunks = extract.chunks_of(code, defined)
    covered = set()
    for c in chunks:
        covered.update(range(c["start_byte"], c["end_byte"]))
        assert len(c["content"]) <= 4096 and c["start_line"] <= c["end_line"]
    assert all(code[i : i + 1].isspace() for i in set(range(len(code))) - covered)
    assert {c["kind"] for c in chunks} == {"module", "class", "method", "function_part"}


def test_files_with_trouble_do_not_stop_others(spark):
    rows = [("1", "p", "a.py", "python", b"x = f(1)\n"), ("2", "p", "b.py", "python", b"a\0b"), ("3", "p", "c.py", "python", b"\xff\xfe"), ("4", "p", "d.py", "python", None), ("5", "p", "e.py", "python", b"def (:"), ("6", "p", "f.go", "go", b"func F() {}\n")]
    parsed = extract.extract(spark.createDataFrame(rows, "file_id string, project_id string, path string, language string, content binary"))
    got = {r["file_id"]: r for r in parsed.collect()}
    assert got["2"]["error"] == "rejected: binary" and got["3"]["error"] == "rejected: encoding" and got["4"]["error"] and got["5"]["has_errors"] and got["5"]["rows"] == [] and len(got["5"]["chunks"]) == 1
    assert got["1"]["rows"][-1]["record_kind"] == "coverage" and got["6"]["rows"] == [] and got["6"]["chunks"][0]["symbol"] == "F"
    ids = [r["chunk_id"] for r in extract.chunk_rows(parsed, "s").collect()]
    assert len(set(ids)) == len(ids) == 3 and all(i.startswith("p:") for i in ids)
