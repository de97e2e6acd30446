import json

import pytest
from pyspark.sql import functions as F

from strataquery import __main__ as cli
from strataquery.operators import changes
from strataquery.sources import files, project, synthetic
from strataquery.sources.hadoop import Folder
from strataquery.sources.progress import ProbeCache, Progress


def test_progress_is_throttled_and_expires(spark, tmp_path):
    now = [100.0]
    own = Progress(Folder(spark, str(tmp_path)), "p", clock=lambda: now[0])
    assert own.read() is None and own.update("scan", 1, 4) and not own.update("scan", 2, 4)
    assert own.read()["fraction"] == 0.25
    now[0] += 0.3
    assert own.update("scan", 9, 4) and own.read()["fraction"] == 1.0 and own.update("scan", 9, force=True)
    now[0] += 61
    assert own.read() is None
    own.clear()
    own.clear()


def test_probe_cache_keeps_the_newest(spark, tmp_path):
    cache = ProbeCache(Folder(spark, str(tmp_path)))
    for i in range(40):
        cache.store(f"k{i}", {"rate": i})
    assert cache.get("k39")["rate"] == 39 and cache.get("k8")["rate"] == 8 and cache.get("k7") is None


def test_documents_are_replaced_at_once(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "new"))
    assert folder.read_json("a.json") is None and folder.names("x") == [] and folder.size("x") == 0
    for value in ({"a": "é"}, [1, None]):
        folder.write_json("a.json", value)
        assert folder.read_json("a.json") == value
    assert [n for n in folder.names() if not n.endswith(".crc")] == ["a.json"]


def test_nested_ignore_rules(tmp_path):
    for name, body in {".gitignore": "*.log\n/top.py\n", "a/.gitignore": "!keep.log\nx/\n", "a/keep.log": "", "a/b.log": "", "top.py": "", "a/top.py": "", "a/x/y.py": "", "venv/z.py": "", "sub/.git/config": "", "sub/in.py": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    got = dict(files.walk_paths(tmp_path))
    assert got == {".gitignore": False, "a/.gitignore": False, "a/keep.log": False, "a/b.log": True, "top.py": True, "a/top.py": False, "a/x/y.py": True}


def test_scan_of_a_store_lists_without_reading(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "b.py").write_text("x = 1")
    row = files.scan_store(spark, str(tmp_path)).first()
    assert (row["path"], row["size"]) == ("a/b.py", 5)
    assert files.has_source(files.scan_store(spark, str(tmp_path)))


def test_changes(spark):
    stored = spark.createDataFrame([("a", 1, 1, "h"), ("b", 1, 1, "h"), ("c", 1, 1, "h"), ("d", 1, 1, "h")], "path string, size long, mtime_ns long, content_hash string")
    scanned = spark.createDataFrame([("a", 1, 1, "h", None), ("b", 1, 2, "h", None), ("c", 2, 2, "i", None), ("e", 1, 1, "h", None), ("f", 1, 1, None, "binary")], "path string, size long, mtime_ns long, content_hash string, rejected string")
    got = {r["path"]: r["change"] for r in changes.classify_changes(stored, scanned).collect()}
    assert got == {"a": "unchanged", "b": "metadata_only", "c": "changed", "d": "removed", "e": "added", "f": "rejected"}


def test_rejections(spark):
    rows = [(b"ok",), (b"a\0b",), (b"\xff\xfe",), (b"",), ("é".encode(),)]
    assert [r[0] for r in spark.createDataFrame(rows, "c binary").select(changes.rejection(F.col("c"))).collect()] == [None, "binary", "encoding", None, None]


def test_incompatibility(spark):
    got = spark.range(1).select(changes.incompatibility(F.lit("m"), F.lit(3), F.lit(None).cast("int"), F.lit("x"), want=("m", 4, 5, "x"))).first()[0]
    assert got == "vector dimension 3 is not 4; schema version missing is not 5"


def test_markers_and_slots(tmp_path):
    own = project.write_marker(tmp_path, "x")
    assert project.write_marker(tmp_path) == own == project.read_marker(tmp_path)
    assert project.write_marker(tmp_path, force_new_id=True).id != own.id
    (tmp_path / "deep" / "er").mkdir(parents=True)
    assert project.find_root(tmp_path / "deep" / "er") == tmp_path
    state = project.git_state(tmp_path)
    assert project.slot_id("p", state) == project.slot_id("p", state) != project.slot_id("q", state)
    assert len(project.partition_id(project.slot_id("p", state))) == 37
    assert project.overlap(str(tmp_path), str(tmp_path / "deep")) == "contains" and project.overlap(str(tmp_path), str(tmp_path) + "x") is None


def test_generated_corpora(spark):
    assert synthetic.indexing_corpus(spark, 20, 3).where(F.col("content").contains("function_19_2")).count() == 1
    rows, asked = synthetic.judged_corpus(spark, 24)
    assert rows.count() == 24 and asked.count() == 8 and rows.select("content").distinct().count() == 24
    assert synthetic.calibration_passages(spark, 5, 40).select("text").distinct().count() == 5
    assert synthetic.memory_shapes(spark, 4096).count() == 4


def test_command_line():
    class Fake:
        def search_code(self, query, projects, **options):
            return [query, projects, options["limit"]]

        def list_projects(self):
            return [project.Project("i", "n", "/r")]

    a = cli.parser().parse_args(["--data", "d", "search", "find it", "--project", "p", "--limit", "3"])
    assert cli.run(Fake(), a) == ["find it", ["p"], 3]
    assert json.loads(json.dumps(cli.run(Fake(), cli.parser().parse_args(["--data", "d", "projects"])), default=cli.plain))[0]["name"] == "n"
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["search"])
