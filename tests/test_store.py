import pytest

from strataquery.errors import EngineError
from strataquery.operators import mutations
from strataquery.sources.store import PartitionStore

TABLES = {"files": "file_id string, path string", "chunks": "file_id string, chunk_id string"}


@pytest.fixture
def store(spark, tmp_path):
    return PartitionStore(spark, str(tmp_path / "partition"), TABLES)


def files(spark, *ids):
    return spark.createDataFrame([(i, f"{i}.py") for i in ids], TABLES["files"])


def chunks(spark, *pairs):
    return spark.createDataFrame(list(pairs), TABLES["chunks"])


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "file_id string")


def content(store, version=None):
    return sorted(tuple(r) for r in store.read("chunks", version).collect())


def test_reading_creates_nothing(store, tmp_path):
    assert store.read("files").count() == 0 and not store.exists and not (tmp_path / "partition").exists()


def test_replace_removes_old_children_only(spark, store):
    store.commit({"files": files(spark, "a", "b"), "chunks": chunks(spark, ("a", "1"), ("a", "2"), ("b", "3"))})
    second = store.commit({"files": files(spark, "a"), "chunks": chunks(spark, ("a", "9"))}, replaced=ids(spark, "a"))
    assert content(store) == [("a", "9"), ("b", "3")] and content(store, 1) == [("a", "1"), ("a", "2"), ("b", "3")]
    assert store.versions() == [0, 1, 2] and store.version == second == 2
    store.commit({}, removed=ids(spark, "b", "none"))
    assert content(store) == [("a", "9")]


def test_replaced_beats_removed(spark, store):
    store.commit({"chunks": chunks(spark, ("a", "1"))})
    store.commit({"chunks": chunks(spark, ("a", "2"))}, replaced=ids(spark, "a"), removed=ids(spark, "a"))
    assert content(store) == [("a", "2")]


def test_an_empty_commit_makes_no_version(spark, store):
    store.commit({"chunks": chunks(spark, ("a", "1"))})
    assert store.commit({"chunks": chunks(spark, *[("a", "1")]).limit(0)}, removed=ids(spark, "a").limit(0)) == 1
    assert store.versions() == [0, 1]


def test_deletes_of_one_table(spark, store):
    store.commit({"files": files(spark, "a"), "chunks": chunks(spark, ("a", "1"))})
    store.commit({"files": spark.createDataFrame([("a", "new.py")], TABLES["files"])}, only={"files": ids(spark, "a")})
    assert content(store) == [("a", "1")] and [r["path"] for r in store.read("files").collect()] == ["new.py"]


def test_a_failed_commit_leaves_the_old_version(spark, store):
    store.commit({"chunks": chunks(spark, ("a", "1"))})
    with pytest.raises(Exception):
        store.commit({"chunks": chunks(spark, ("a", "2"))}, replaced=ids(spark, "a").selectExpr("raise_error('x') as file_id"))
    assert content(store) == [("a", "1")] and store.version == 1
    assert store.pending() and store.recover() == 1 and len(store.folder.names("segments")) == 1
    assert content(store) == [("a", "1")] and not store.pending()


def test_a_published_commit_is_not_undone(spark, store):
    store.commit({"chunks": chunks(spark, ("a", "1"))})
    store.commit({"chunks": chunks(spark, ("b", "2"))})
    base = store._manifest()["versions"]["2"]["tables"]["chunks"]["segments"][-1][1].rpartition("/")[0]
    store.folder.write_json("journals/2.json", {"phase": "committing", "version": 1, "number": 2, "base": base, "attempts": 0})
    assert store.recover() == 1 and content(store) == [("a", "1"), ("b", "2")]


def test_a_commit_fails_if_another_was_published(spark, store, tmp_path):
    store.commit({"chunks": chunks(spark, ("a", "1"))})
    other, real = PartitionStore(spark, str(tmp_path / "partition"), TABLES), store._written

    def late(*args):
        store._written = real
        other.commit({"chunks": chunks(spark, ("b", "2"))})
        return real(*args)

    store._written = late
    with pytest.raises(EngineError) as error:
        store.commit({"chunks": chunks(spark, ("c", "3"))})
    assert error.value.code == "INDEX_BUSY" and content(store) == [("a", "1"), ("b", "2")]


def test_many_commits_are_folded(spark, store, monkeypatch):
    from strataquery.sources import store as module

    monkeypatch.setattr(module, "SEGMENTS", 3)
    want = {}
    for i in range(9):
        one = str(i % 4)
        want[one] = str(i)
        store.commit({"chunks": chunks(spark, (one, str(i)))}, replaced=ids(spark, one))
        assert content(store) == sorted(want.items()) and store.stats()["tables"]["chunks"]["segments"] <= 4
    assert content(store, 2) == [("0", "0"), ("1", "1")]


def test_restore_is_idempotent_and_time_travel_works(spark, store):
    store.commit({"chunks": chunks(spark, ("a", "1"))})
    store.commit({"chunks": chunks(spark, ("b", "2"))})
    assert store.restore(1) and store.restore(1) and content(store) == [("a", "1")]
    assert content(store, 2) == [("a", "1"), ("b", "2")] and not store.restore(7)
    with pytest.raises(EngineError):
        store.read("chunks", 7)
    assert store.commit({"chunks": chunks(spark, ("c", "3"))}) == 3 and content(store) == [("a", "1"), ("c", "3")]


def test_recovery_undoes_what_a_dead_writer_left(spark, store):
    store.commit({"chunks": chunks(spark, ("a", "1"))})
    base = "segments/00000002-dead"
    chunks(spark, ("x", "9")).write.parquet(store.folder.at(f"{base}/chunks"))
    store.folder.write_json("journals/2.json", {"phase": "committing", "version": 1, "base": base, "attempts": 0})
    assert store.pending() and store.recover() == 1 and not store.pending() and store.recover() == 0
    assert content(store) == [("a", "1")] and not store.folder.exists(base)


def test_recovery_gives_up_after_three_attempts(spark, store):
    store.commit({"chunks": chunks(spark, ("a", "1"))})
    store.folder.write_json("journals/9.json", {"phase": "committing", "version": 8, "base": "segments/none", "attempts": 0})
    assert [store.recover() for _ in range(3)] == [0, 0, 1] and not store.pending()


def test_compaction_and_vacuum(spark, store):
    for i in range(4):
        store.commit({"files": files(spark, "a"), "chunks": chunks(spark, ("a", str(i)))}, replaced=ids(spark, "a"))
    before = store.stats()
    assert before["tables"]["chunks"]["segments"] == 4
    store.compact()
    assert content(store) == [("a", "3")] and store.stats()["tables"]["chunks"] == store.stats()["tables"]["chunks"] | {"segments": 1, "deletes": 0}
    assert store.vacuum(keep_hours=1) == 1 and content(store, 2) == [("a", "1")]
    import time

    assert store.vacuum(keep_hours=1, now=time.time() + 7200) == 4
    assert content(store) == [("a", "3")] and len(store.folder.names("segments")) == 2 and store.stats()["physical_bytes"] < before["physical_bytes"]


def test_a_store_that_loses_siblings_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(PartitionStore, "_checked", False)
    PartitionStore.check_merge(spark, str(tmp_path))
    assert PartitionStore._checked and not [p for p in tmp_path.iterdir() if p.name.startswith("merge-")]
    monkeypatch.setattr(PartitionStore, "_checked", False)
    monkeypatch.setattr(PartitionStore, "read", lambda self, table: spark.createDataFrame([("a", "4")], "file_id string, chunk_id string"))
    with pytest.raises(EngineError) as error:
        PartitionStore.check_merge(spark, str(tmp_path))
    assert error.value.code == "INDEX_INCOMPATIBLE"


def test_one_writer_at_a_time(store):
    store.lock()
    with pytest.raises(EngineError) as error:
        store.lock()
    assert error.value.code == "INDEX_BUSY"
    store.unlock()
    store.lock()


def test_a_dead_writers_lock_is_taken_over_once(spark, store, tmp_path, monkeypatch):
    import time

    from strataquery.sources import store as module

    store.lock()
    other = PartitionStore(spark, str(tmp_path / "partition"), TABLES)
    monkeypatch.setattr(module, "LOCK_SECONDS", 0.2)
    store.renew()
    with pytest.raises(EngineError):
        other.lock()
    time.sleep(0.3)
    other.lock()
    with pytest.raises(EngineError):
        store.commit({"chunks": chunks(spark, ("a", "1"))})  # its lock is gone
    store.unlock()
    assert store.folder.exists("lock.json") and other.commit({"chunks": chunks(spark, ("b", "2"))}) == 1


def test_versions_do_not_grow_with_files(spark, store):
    store.commit({"files": files(spark, *map(str, range(500)))})
    assert store.versions() == [0, 1]


def test_upsert_and_no_change(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, None, 1)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "a", 2), (2, "None", 2), (3, "c", 2)], "k int, v string, t int")
    assert sorted(tuple(r) for r in mutations.upsert(old, new.where("k = 3"), "k").collect()) == [(1, "a", 1), (2, None, 1), (3, "c", 2)]
    assert sorted(r["k"] for r in mutations.changed_rows(old, new, "k", ignore=["t"]).collect()) == [2, 3]
    assert mutations.changed_rows(old, old, "k").isEmpty()
