"""The service surface over a small tree."""

import json
import os
import subprocess

import pytest

from strataquery.engine import Engine
from strataquery.errors import EngineError
from strataquery.settings import Settings

SOURCES = {
    "auth/login.py": "def login_user(name):\n    return check(name)\n\n\nclass Session:\n    def close(self):\n        pass\n",
    "auth/__init__.py": "",
    "main.py": "from auth.login import login_user\n\n\ndef main():\n    login_user('a')\n",
    "web/app.ts": "export function render(x) { return x; }\n",
    "notes.txt": "not indexed",
    "node_modules/x.js": "function hidden() {}",
    "bad.py": "def broken(:\n",
    "bin.py": "a\0b",
    ".gitignore": "skipped.py\n",
    "skipped.py": "def skipped(): pass\n",
}


@pytest.fixture
def tree(tmp_path):
    for name, body in SOURCES.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    return tmp_path / "tree"


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "data"), Settings(mode="manual", auto_maintenance=False))


def change(path, body):
    path.write_text(body)
    os.utime(path, ns=(path.stat().st_mtime_ns + 10**9,) * 2)


def test_index_search_and_refresh(engine, tree):
    own = engine.init_project(str(tree), "demo")
    assert engine.list_projects() == [own] and engine.resolve("demo") == own and engine.resolve(str(tree / "auth")) == own
    first = engine.index_project("demo")
    assert (first["files_indexed"], first["files_failed"], first["state"]) == (5, 1, "partial") and first["version"] == 1
    assert json.loads(first["skip_reasons"]) == {"hard_excluded": 0, "ignored": 1, "unsupported": 2} or json.loads(first["skip_reasons"])["ignored"] == 1
    again = engine.index_project("demo")
    assert again["version"] == 1 and again["files_indexed"] == 0 and again["files_unchanged"] == 6

    hits = engine.search_code("login user", ["demo"])
    assert hits[0]["symbol"] == "login_user" and hits[0]["project_name"] == "demo" and hits == engine.search_code("login user", ["demo"])
    assert [h["path"] for h in engine.search_code("render", ["demo"], languages=["typescript"])] == ["web/app.ts"]
    assert {h["path"] for h in engine.search_code("login", ["demo"], paths_like=["auth/*"])} == {"auth/login.py"}
    assert engine.get_chunk(hits[0]["chunk_id"])["content"].startswith("def login_user")
    assert [s["qualified_symbol"] for s in engine.find_symbol("close", "demo")] == ["Session.close"]
    assert engine.find_symbol("close_", "demo", match="prefix") == []
    assert [(o["kind"], o["qualified_symbol"]) for o in engine.file_outline("auth/login.py", "demo")] == [("function", "login_user"), ("class", "Session"), ("method", "Session.close")]

    found = engine.find_references("demo", path="auth/login.py", symbol="login_user")
    assert [(r["path"], r["kind"], r["resolution"]) for r in found["references"]] == [("main.py", "import", "exact"), ("main.py", "call", "exact")] or {r["reason"] for r in found["references"]} <= {"direct_import_alias", "same_file_symbol", "unproven_reexport"}
    plan = engine.analyze_refactor("demo", {"rename": "sign_in"}, path="auth/login.py", symbol="login_user")
    assert plan["counts"]["declaration"] == 1 and plan["counts"].get("must_change", 0) >= 1 and plan["completeness"] == "incomplete"
    source = (tree / "main.py").read_bytes()
    for f in plan["findings"]:
        if f["bucket"] == "must_change" and f["edit_start"] is not None:
            assert source[f["edit_start"] : f["edit_end"]] == b"login_user"
    new = [{"name": "name"}, {"name": "token", "kind": "keyword_only", "required": True}]
    plan = engine.analyze_refactor("demo", {"signature": [p | {"required": True} for p in new]}, path="auth/login.py", symbol="login_user")
    assert "missing_required_parameter" in {f["reason"] for f in plan["findings"]}

    change(tree / "main.py", "def other():\n    pass\n")
    (tree / "web/app.ts").unlink()
    assert engine.is_stale("demo")
    third = engine.index_project("demo")
    assert (third["files_indexed"], third["files_removed"], third["version"]) == (1, 1, 2) or third["version"] == 2
    assert engine.find_symbol("render", "demo") == [] and engine.find_symbol("main", "demo") == [] and engine.find_symbol("other", "demo")
    with pytest.raises(EngineError) as error:
        engine.get_chunk("nothing")
    assert error.value.code == "CHUNK_NOT_FOUND"
    os.utime(tree / "auth/login.py", ns=(1, 1))
    before = engine.find_symbol("login_user", "demo")
    assert engine.index_project("demo")["files_indexed"] == 0 and engine.find_symbol("login_user", "demo") == before and not engine.is_stale("demo")

    status = engine.project_status("demo")
    assert status["files"] == 5 and status["last_run"]["state"] == "finished" and not status["stale"] and status["incompatibility"] == ""
    history = engine.index_history("demo", limit=2)
    assert len(history["runs"]) == 2 and history["cursor"] and len(engine.index_history("demo", limit=10)["runs"]) == 4
    assert engine.index_history("demo", limit=3, cursor=history["cursor"])["runs"][0]["run_id"] not in {r["run_id"] for r in history["runs"]}
    storage = engine.index_storage_status()
    assert storage["physical_bytes"] > 0 and len(storage["slots"]) == 1
    done = engine.index_storage_maintenance("demo", keep_hours=0.0)
    assert done["versions_removed"] >= 2 and engine.find_symbol("other", "demo")
    assert engine.backfill_references("demo") == 0
    assert engine.remove_project("demo") and not engine.remove_project("demo") and engine.list_projects() == []


def test_inspection_reads_nothing(engine, tree):
    engine.init_project(str(tree), "demo")
    seen = engine.inspect_scan("demo")
    assert {r["path"]: r["status"] for r in seen["rows"]}["notes.txt"] == "unsupported" and seen["counts"]["ignored"] == 1
    assert [r["path"] for r in engine.inspect_scan("demo", statuses=["candidate"], offset=1, limit=2)["rows"]] == ["auth/login.py", "bad.py"]


def test_two_projects(engine, tree, tmp_path):
    other = tmp_path / "other"
    other.mkdir()
    (other / "pay.py").write_text("def login_user_payment(): pass\n")
    a, b = engine.init_project(str(tree), "auth"), engine.init_project(str(other), "billing")
    for name in ("auth", "billing"):
        engine.index_project(name)
    hits = engine.search_across_projects("login user payment", all_projects=True)
    assert {h["project_name"] for h in hits} == {"auth", "billing"}
    for wrong in (dict(projects=["auth"]), dict(projects=["auth", a.id]), dict(), dict(projects=["auth", "billing"], all_projects=True)):
        with pytest.raises(EngineError):
            engine.search_across_projects("x", **wrong)
    with pytest.raises(EngineError) as error:
        engine.init_project(str(tree / "auth"))
    assert error.value.code == "OVERLAPPING_PROJECT" and error.value.details["relation"] == "nested"
    assert engine.init_project(str(tree / "auth"), allow_overlap=True).id not in (a.id, b.id)


def test_cursors_pin_the_version(engine, tree):
    (tree / "many.py").write_text("from auth.login import login_user\n" + "login_user()\n" * 5)
    engine.init_project(str(tree), "demo")
    engine.index_project("demo")
    first = engine.find_references("demo", path="auth/login.py", symbol="login_user", limit=3)
    rest = engine.find_references("demo", path="auth/login.py", symbol="login_user", limit=3, cursor=first["cursor"])
    assert len(first["references"]) == 3 and not {r["reference_id"] for r in first["references"]} & {r["reference_id"] for r in rest["references"]}
    change(tree / "many.py", "login_user()\n")
    stale = engine.find_references("demo", path="auth/login.py", symbol="login_user")
    assert "stale_file" in {x["code"] for x in stale["limitations"]} and "many.py" not in {r["path"] for r in stale["references"]}
    engine.index_project("demo")
    with pytest.raises(EngineError) as error:
        engine.find_references("demo", path="auth/login.py", symbol="login_user", limit=3, cursor=first["cursor"])
    assert error.value.code == "STALE_CURSOR"


def test_lazy_mode_and_watch(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "data"), Settings(mode="lazy", auto_maintenance=False))
    engine.init_project(str(tree), "demo")
    assert engine.search_code("login", ["demo"])
    change(tree / "main.py", "def fresh_thing(): pass\n")
    engine._fresh.clear()
    assert engine.find_symbol("fresh_thing", "demo")
    assert engine.watch("demo", passes=2, interval=0, debounce=0) == 0
    change(tree / "main.py", "def later(): pass\n")
    assert engine.watch("demo", passes=2, interval=0, debounce=0) == 1


def test_branches_have_slots_of_their_own(engine, tree):
    git = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.email=a@b", "-c", "user.name=a", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "one")
    git("add", "-A")
    git("commit", "-qm", "x")
    engine.init_project(str(tree), "demo")
    engine.index_project("demo")
    git("checkout", "-qb", "two")
    change(tree / "main.py", "def on_two(): pass\n")
    engine.index_project("demo")
    registry = engine._registry()
    assert len(registry["slots"]) == 2 and next(iter(registry["active"].values()))["epoch"] == 2
    git("checkout", "-qf", "one")
    engine.index_project("demo")
    assert engine.find_symbol("on_two", "demo") == [] and engine.find_symbol("main", "demo")


def test_settings():
    assert Settings.from_environment({}) == Settings()
    assert Settings.from_environment({"STRATAQUERY_INDEX_MODE": "EAGER", "STRATAQUERY_AUTO_MAINTENANCE": "no"}).mode == "eager"
    for wrong in ({"STRATAQUERY_INDEX_MODE": "x"}, {"STRATAQUERY_VECTOR_WIDTH": "7"}, {"STRATAQUERY_VECTOR_WIDTH": "x"}, {"STRATAQUERY_AUTO_MAINTENANCE": "maybe"}):
        with pytest.raises(EngineError) as error:
            Settings.from_environment(wrong)
        assert error.value.code == "INVALID_CONFIGURATION"
