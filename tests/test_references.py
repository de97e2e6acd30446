"""Resolution over small repositories, written for these tests."""

import json

import pytest
from pyspark.sql import functions as F

from strataquery.operators import references
from strataquery.sources import extract


def index(spark, sources):
    rows = [(p, "proj", p, "python" if p.endswith(".py") else "typescript" if p.endswith(".ts") else "javascript", code.encode()) for p, code in sources.items()]
    parsed = extract.extract(spark.createDataFrame(rows, "file_id string, project_id string, path string, language string, content binary"))
    return extract.reference_rows(parsed).persist(), spark.createDataFrame([(p,) for p in sources], "path string")


def selected(rows, path, symbol):
    (row,), _ = references.declaration_matches(rows.where("record_kind = 'declaration'"), path, symbol)
    return references.Selected(row["file_id"], path, row["language"], row["kind"], row["written_name"], row["target_name"])


def resolve(spark, sources, path, symbol, kind="call"):
    rows, files = index(spark, sources)
    hits = references.find_references(rows, files, selected(rows, path, symbol)).collect()
    return {(r["path"], r["start_line"]): (r["resolution"], r["reason"]) for r in hits if kind is None or r["kind"] == kind}


def test_direct_alias_and_same_file(spark):
    got = resolve(spark, {"lib/a.py": "def load(): pass\nload()\n", "lib/__init__.py": "", "m.py": "from lib.a import load as l\nl()\n", "n.py": "import lib.a as x\nx.load()\n"}, "lib/a.py", "load")
    assert got == {("lib/a.py", 2): ("exact", "same_file_symbol"), ("m.py", 2): ("exact", "direct_import_alias"), ("n.py", 2): ("exact", "known_namespace_member")}


def test_relative_imports_and_reexports(spark):
    sources = {"p/__init__.py": "from .a import load\n", "p/a.py": "def load(): pass\n", "p/q/__init__.py": "from .. import load as again\n", "u.py": "from p import load\nload()\n", "v.py": "from p.q import again\nagain()\n", "w.py": "from p.q import other\nother()\n"}
    got = resolve(spark, sources, "p/a.py", "load")
    assert got == {("u.py", 2): ("exact", "reexport_chain"), ("v.py", 2): ("exact", "reexport_chain")}


def test_unproven_wildcard_and_ambiguous(spark):
    sources = {"a.py": "def load(): pass\n", "b.py": "def load(): pass\n", "c.py": "from elsewhere import load\nload()\n", "d.py": "from a import *\nload()\n", "e.py": "load()\n", "f.py": "x.load()\n"}
    got = resolve(spark, sources, "a.py", "load")
    assert got == {("c.py", 2): ("likely", "unproven_reexport"), ("d.py", 2): ("unresolved", "wildcard_import"), ("e.py", 1): ("unresolved", "ambiguous_symbol"), ("f.py", 1): ("likely", "unknown_receiver")}


def test_only_name(spark):
    assert resolve(spark, {"a.py": "def sole(): pass\n", "e.py": "sole()\n"}, "a.py", "sole") == {("e.py", 1): ("likely", "name_only_candidate")}


def test_owner_and_receivers(spark):
    code = "class A:\n    def run(self): pass\n    def go(self):\n        self.run()\n\nclass B:\n    def go(self):\n        self.run()\n"
    got = resolve(spark, {"a.py": code}, "a.py", "A.run")
    assert got == {("a.py", 4): ("exact", "known_owner_member"), ("a.py", 8): ("likely", "unknown_receiver")}


def test_a_nearer_declaration_shadows(spark):
    code = "def f(): pass\ndef outer():\n    def f(): pass\n    f()\nf()\n"
    assert resolve(spark, {"a.py": code}, "a.py", "f") == {("a.py", 5): ("exact", "same_file_symbol")}


def test_scripts(spark):
    sources = {"src/a.ts": "export function load() {}\n", "src/index.ts": "export { load as fetchIt } from './a';\n", "m.ts": "import { load } from './src/a';\nload();\n", "n.ts": "import { fetchIt } from './src';\nfetchIt();\n", "o.ts": "import * as ns from './src/a';\nns.load();\n"}
    got = resolve(spark, sources, "src/a.ts", "load")
    assert got[("m.ts", 2)] == ("exact", "direct_import_alias") and got[("n.ts", 2)] == ("exact", "reexport_chain") and got[("o.ts", 2)] == ("exact", "known_namespace_member")


def test_no_false_exact_after_leaving_the_chain(spark):
    sources = {"a.py": "def load(): pass\n", "b.py": "from a import load\n", "c.py": "from b import other as load\nload()\n", "other.py": "def other(): pass\n"}
    got = resolve(spark, sources, "a.py", "load")
    assert got[("c.py", 2)][0] != "exact"


def overriding(spark, sources, path="a.py", symbol="Base.run"):
    rows, files = index(spark, sources)
    return sorted((r["path"], r["target_name"]) for r in references.overrides(rows, files, selected(rows, path, symbol)).collect())


BASE = "class Base:\n    def run(self): pass\n"
SUB = "    def run(self): pass\n"


def test_overrides_follow_all_subclasses(spark):
    sources = {"a.py": BASE + "class B(Base):\n    pass\n", "b.py": "from a import B\nclass C(B):\n" + SUB, "c.py": "class D:\n" + SUB}
    assert overriding(spark, sources) == [("b.py", "C.run")]


def test_overrides_go_by_the_binding_of_the_base(spark):
    sources = {
        "a.py": BASE,
        "b.py": "from a import Base as B\nclass C(B):\n" + SUB,
        "n.py": "import a as space\nclass N(space.Base):\n" + SUB + "class O(other.Base):\n" + SUB,
        "z.py": BASE + "class Un(Base):\n" + SUB,
        "y.py": "from z import Base\nclass Y(Base):\n" + SUB,
        "x.py": "from a import Other as Base\nclass X(Base):\n" + SUB,
    }
    assert overriding(spark, sources) == [("b.py", "C.run"), ("n.py", "N.run")]


def test_overrides_of_classes_of_one_name_and_cycles(spark):
    sources = {"a.py": BASE + "class In:\n    class Base(Base):\n        def run(self): pass\n", "b.py": "from a import Base\nfrom c import Loop\nclass Mid(Base, Loop):\n    pass\n", "c.py": "from b import Mid\nclass Loop(Mid):\n" + SUB}
    assert ("c.py", "Loop.run") in overriding(spark, sources)


def test_overrides_more_than_fifty_classes_down(spark):
    chain = "".join(f"class C{i}(C{i - 1}):\n    pass\n" for i in range(1, 60))
    got = overriding(spark, {"a.py": "class C0:\n    def run(self): pass\n" + chain + "class End(C59):\n" + SUB}, symbol="C0.run")
    assert got == [("a.py", "End.run")]


def test_overrides_of_scripts(spark):
    sources = {"src/a.ts": "export default class Base {\n  run() {}\n}\n", "m.ts": "import Mine from './src/a';\nclass C extends Mine {\n  run() {}\n}\n", "n.ts": "class Base {}\nclass D extends Base {\n  run() {}\n}\n"}
    assert overriding(spark, sources, "src/a.ts") == [("m.ts", "C.run")]


def test_overrides_send_no_table_that_grows_to_the_driver(spark):
    sources = {"a.py": BASE, "b.py": "from a import Base\nclass C(Base):\n" + SUB, "n.py": "import a as space\nclass N(space.Base):\n" + SUB}
    rows, files = index(spark, sources)
    classes = rows.where("kind = 'class'").select("path", F.col("target_name").alias("class"))
    for out, count in ((references.inheritance_edges(rows, files, classes), 2), (references.overrides(rows, files, selected(rows, "a.py", "Base.run")), 2)):
        for _ in range(2):  # as planned, and as run
            assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
            assert len(out.collect()) == count


def test_reexports_send_no_table_that_grows_to_the_driver(spark, monkeypatch):
    rows, files = index(spark, {"a.py": "def load(): pass\n", "b.py": "from a import load\n", "c.py": "from b import load\n"})
    imports, seen, reach = rows.where("kind = 'import'"), [], references.reach
    monkeypatch.setattr(references, "reach", lambda starts, edges, hops: seen.extend((starts, edges)) or reach(starts, edges, hops))
    found = references.reexport_chains(imports, imports, references.module_targets(imports, files), selected(rows, "a.py", "load"))
    assert found.count() == 1 and len(seen) == 2
    for out in seen:
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_near_misses(spark):
    rows, _ = index(spark, {"a.py": "class A:\n    def run(self): pass\n"})
    assert references.declaration_matches(rows.where("record_kind = 'declaration'"), "x.py", "B.run") == ([], ["A.run"])


P = lambda name, kind="positional", required=True: {"name": name, "kind": kind, "required": required, "position": 0, "destructured": False}


@pytest.mark.parametrize(
    "call,old,new,overloads,bound,issue",
    [
        (None, [], [], 1, False, None),
        ({"has_positional_spread": True}, [P("a")], [], 1, False, "spread_uncertainty"),
        ({"positional_count": 1}, [P("a")], [P("a")], 2, False, "overload_ambiguity"),
        ({"positional_count": 1}, [P("a")], [P("a")], 0, False, None),
        ({"positional_count": 1}, [P("a")], [P("a"), P("k", "keyword_only")], 1, False, "missing_required_parameter"),
        ({"positional_count": 0, "keywords": ["z"]}, [P("a")], [P("a", required=False)], 1, False, "invalid_keyword"),
        ({"positional_count": 0, "keywords": ["a"]}, [P("a")], [P("a", "positional_only")], 1, False, "parameter_mode_change"),
        ({"positional_count": 1}, [P("a")], [P("a"), P("b")], 1, False, "missing_required_parameter"),
        ({"positional_count": 1, "keywords": ["b"]}, [P("a")], [P("a"), P("b")], 1, False, None),
        ({"positional_count": 2}, [P("a"), P("b")], [P("a"), P("b", "keyword_only", False)], 1, False, "parameter_mode_change"),
        ({"positional_count": 2}, [P("a"), P("b")], [P("a")], 1, False, "removed_positional_parameter"),
        ({"positional_count": 2}, [P("a"), P("b")], [P("a"), P("r", "variadic", False)], 1, False, None),
        ({"positional_count": 2}, [P("a"), P("b")], [P("b"), P("a")], 1, False, "positional_order_change"),
        ({"positional_count": 1}, [P("a"), P("b", required=False)], [P("a"), P("c", required=False)], 1, False, None),
        ({"positional_count": 1}, [P("self"), P("a")], [P("self"), P("a")], 1, True, None),
        ({"positional_count": 1}, [P("self"), P("a")], [P("self")], 1, True, "removed_positional_parameter"),
    ],
)
def test_signatures(spark, call, old, new, overloads, bound, issue):
    df = spark.createDataFrame([(json.dumps({"keywords": [], "positional_count": 0} | call) if call is not None else None, json.dumps(old), json.dumps(new))], "c string, o string, n string")
    made = references.signature_issue(F.from_json("c", references.CALL_SHAPE), F.from_json("o", references.PARAMETERS), F.from_json("n", references.PARAMETERS), overloads=F.lit(overloads), bound=F.lit(bound))
    assert df.select(made).first()[0] == issue
