"""Versioned tables of one partition: snapshots, time travel, rollback, compaction.

A commit adds a segment (a Parquet folder of new rows) to each table, and the
ids of replaced and removed files to a delete set; both are immutable. One
manifest names the segments and delete sets of every retained version and the
live version; replacing that small document is the only commit point. A reader
resolves it once and has a snapshot. A commit writes what changed, whatever
the table's size, and then folds its newest segments once there are many of
them that are small beside those before; ``compact`` folds segments and
deletes into one segment.

A writer holds the lock document, which only one can create and which it
renews; besides, a commit fails if the manifest is no longer the one that it
started from. The journal of a commit goes away with its success only, so
``recover`` finds what a failed or dead writer left.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.errors import EngineError
from strataquery.sources.hadoop import Folder

FILES = "file_id string, project_id string, path string, language string, size long, mtime_ns long, content_hash string, has_errors boolean, error string, indexed_at long"
CHUNKS = (
    "chunk_id string, file_id string, path string, language string, kind string, symbol string, qualified_symbol string, parent_symbol string, start_byte long, end_byte long, "
    "start_line int, end_line int, content string, identifier_terms string, content_hash string, part_index int, vector array<float>, content_length int, identifier_length int"
)
#: The text index: a row a distinct term of a chunk's content or identifier terms.
POSTINGS = "file_id string, chunk_id string, field string, term string, tf int, length int"
#: Tables that are sorted otherwise than by path.
SORTED = {"postings": ("term", "chunk_id")}


def _references() -> str:
    from strataquery.operators.references import SCHEMA

    return SCHEMA


TABLES = {"files": FILES, "chunks": CHUNKS, "references": _references(), "postings": POSTINGS}
#: Seconds after which the lock of a writer that died may be taken over.
LOCK_SECONDS = 3600
#: Segments of a table beyond which its newest ones are folded, and how many times larger than all behind it a segment has to be to stay.
SEGMENTS, TIER = 12, 4


class PartitionStore:
    _checked = False

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, str] | None = None, parent: str = "file_id"):
        self.spark, self.folder, self.tables, self.parent = spark, Folder(spark, root), tables or TABLES, parent
        self._token: str | None = None

    # -- manifest ---------------------------------------------------------

    def _manifest(self) -> dict:
        return self.folder.read_json("manifest.json") or {"live": 0, "next": 1, "versions": {"0": {"created": 0, "tables": {t: {"segments": [], "deletes": []} for t in self.tables}}}}

    @property
    def exists(self) -> bool:
        return self.folder.exists("manifest.json")

    @property
    def version(self) -> int:
        return self._manifest()["live"]

    def versions(self) -> list[int]:
        return sorted(map(int, self._manifest()["versions"]))

    # -- reads ------------------------------------------------------------

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """Rows of a table as of a version, the live one by default; reading creates nothing."""
        manifest = self._manifest()
        state = manifest["versions"].get(str(manifest["live"] if version is None else version))
        if state is None:
            raise EngineError("STALE_CURSOR", f"version {version} is no longer kept", version=version)
        return self._rows(table, state["tables"][table])

    def _rows(self, table: str, layers: dict) -> DataFrame:
        schema = self.tables[table]
        if not layers["segments"]:
            return self.spark.createDataFrame([], schema)
        parts = [self._segment(p, schema).withColumn("_seq", F.lit(s)) for s, p in layers["segments"]]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        newest = max(s for s, _ in layers["segments"])
        gone = [(s, p) for s, p in layers["deletes"] if s > min(x for x, _ in layers["segments"])]
        if gone and (len(layers["segments"]) > 1 or gone[-1][0] > newest):
            ids = [self._segment(p, f"{self.parent} string").withColumn("_until", F.lit(s)) for s, p in gone]
            deleted = ids[0]
            for part in ids[1:]:
                deleted = deleted.unionByName(part)
            deleted = deleted.groupBy(F.col(self.parent).alias("_gone")).agg(F.max("_until").alias("_until"))
            rows = rows.join(deleted, (F.col(self.parent) == F.col("_gone")) & (F.col("_seq") < F.col("_until")), "left_anti")
        return rows.drop("_seq")

    def _segment(self, path: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.folder.at(path))

    # -- writes -----------------------------------------------------------

    def commit(self, rows: dict[str, DataFrame], *, replaced: DataFrame | None = None, removed: DataFrame | None = None, only: dict[str, DataFrame] | None = None, journal: str | None = None) -> int:
        """Publish new rows and retire those of replaced and removed files; the new version, or the live one if nothing changed.

        ``replaced`` and ``removed`` have the parent id and hold for all tables,
        ``only`` has ids for single tables. A file in both is replaced. On any
        failure the manifest is as it was, so readers never see a part of a
        commit.
        """
        manifest = self._manifest()
        number = manifest["next"]
        base = f"segments/{number:08d}-{uuid.uuid4().hex[:8]}"
        note = {"phase": "committing", "version": manifest["live"], "number": number, "base": base, "attempts": 0}
        self.folder.write_json(f"journals/{journal or number}.json", note)
        gone = [d.select(self.parent) for d in (replaced, removed) if d is not None]
        deletes = None
        if gone:
            ids = gone[0]
            for d in gone[1:]:
                ids = ids.unionByName(d)
            deletes = self._written(ids.distinct(), f"{base}/deletes", f"{self.parent} string")
        empty = {"segments": [], "deletes": []}
        before = manifest["versions"][str(manifest["live"])]["tables"]
        state = {t: {k: list(map(list, v)) for k, v in before.get(t, empty).items()} for t in self.tables}
        changed = deletes is not None
        for table, schema in self.tables.items():
            if deletes:
                state[table]["deletes"].append([number, deletes])
            if only and table in only:
                own = self._written(only[table].select(self.parent).distinct(), f"{base}/deletes-{table}", f"{self.parent} string")
                if own:
                    state[table]["deletes"].append([number, own])
                    changed = True
            if table in rows:
                columns = self.spark.createDataFrame([], schema).columns
                if path := self._written(self._ordered(table, rows[table].select(*columns)), f"{base}/{table}", schema):
                    state[table]["segments"].append([number, path])
                    changed = True
        if changed:
            for table in self.tables:
                self._fold(table, state[table], number, base)
            self._publish(manifest, number, state)
        self.folder.delete(f"journals/{journal or number}.json")
        return manifest["live"]

    def _publish(self, manifest: dict, number: int, state: dict) -> None:
        """Replace the manifest, unless another writer has replaced it since it was read."""
        self.renew()
        now = self._manifest()
        if (now["next"], now["live"]) != (manifest["next"], manifest["live"]):
            raise EngineError("INDEX_BUSY", "another writer has published a version in the meantime")
        manifest["versions"][str(number)] = {"created": time.time(), "tables": state}
        manifest["live"], manifest["next"] = number, number + 1
        self.folder.write_json("manifest.json", manifest)

    def _ordered(self, table: str, rows: DataFrame) -> DataFrame:
        order = SORTED.get(table)
        return rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows

    def _fold(self, table: str, layers: dict, number: int, base: str) -> None:
        """Fold the newest segments of a table into one, less the rows that are deleted already.

        A segment stays apart if it is ``TIER`` times as large as all newer
        ones, so a row is written again a number of times that grows with the
        logarithm of the table.
        """
        segments = layers["segments"]
        if len(segments) <= SEGMENTS:
            return
        first, behind = len(segments) - 1, self.folder.size(segments[-1][1])
        while first and (size := self.folder.size(segments[first - 1][1])) < TIER * behind:
            first, behind = first - 1, behind + size
        own = self._rows(table, {"segments": segments[first:], "deletes": layers["deletes"]})
        path = self._written(self._ordered(table, own), f"{base}/{table}-folded", self.tables[table])
        layers["segments"] = segments[:first] + ([[number, path]] if path else [])
        if not first:
            layers["deletes"] = []

    def _written(self, rows: DataFrame, path: str, schema: str) -> str | None:
        """Write rows to a new folder; None (and no folder) if there are none."""
        rows.write.parquet(self.folder.at(path))
        if self.spark.read.schema(schema).parquet(self.folder.at(path)).limit(1).isEmpty():
            self.folder.delete(path)
            return None
        return path

    def restore(self, version: int) -> bool:
        """Make an earlier version live again; false if it is gone. Repeating it changes nothing."""
        manifest = self._manifest()
        if str(version) not in manifest["versions"] or not self.exists:
            return False
        if manifest["live"] != version:
            manifest["live"] = version
            self.folder.write_json("manifest.json", manifest)
        return True

    # -- recovery ---------------------------------------------------------

    def pending(self) -> bool:
        return any(n.endswith(".json") for n in self.folder.names("journals"))

    def recover(self, most_attempts: int = 3) -> int:
        """Undo what journals of dead writers left; the number of journals handled.

        Segments that no version names are deleted. A journal whose version
        can't be restored is tried ``most_attempts`` times.
        """
        handled = 0
        for name in self.folder.names("journals"):
            if not name.endswith(".json"):
                continue
            note = self.folder.read_json(f"journals/{name}")
            if note.get("phase") == "committing":
                if str(note.get("number")) not in self._manifest()["versions"]:  # else it was published, and only the journal is left
                    if note["version"] and not self.restore(note["version"]):
                        note["attempts"] += 1
                        self.folder.write_json(f"journals/{name}", note)
                        if note["attempts"] < most_attempts:
                            continue
                    self.folder.delete(note["base"])
            self.folder.delete(f"journals/{name}")
            handled += 1
        return handled

    def lock(self) -> None:
        """Become the only writer. The lock of a writer that hasn't renewed it for ``LOCK_SECONDS`` is put aside, which only one can do."""
        token = uuid.uuid4().hex
        document = {"at": time.time(), "token": token}
        if not self.folder.create_json("lock.json", document):
            held = self.folder.read_json("lock.json")
            aside = f"lock-{held['token'] if held else 'unknown'}.json"
            if not held or time.time() - held["at"] < LOCK_SECONDS or not self.folder.rename("lock.json", aside):
                raise EngineError("INDEX_BUSY", "another job writes to this partition")
            if not self.folder.create_json("lock.json", document):
                raise EngineError("INDEX_BUSY", "another job writes to this partition")
            self.folder.delete(aside)
        self._token = token

    def renew(self) -> None:
        """Say that this writer lives; an error if its lock was taken over. Nothing without a lock."""
        if self._token is None:
            return
        held = self.folder.read_json("lock.json")
        if not held or held.get("token") != self._token:
            raise EngineError("INDEX_BUSY", "the lock was taken over by another writer")
        self.folder.write_json("lock.json", {"at": time.time(), "token": self._token})

    def unlock(self) -> None:
        held = self.folder.read_json("lock.json")
        if held and held.get("token") == self._token:
            self.folder.delete("lock.json")
        self._token = None

    # -- maintenance ------------------------------------------------------

    def compact(self) -> int:
        """Fold each table into one segment sorted by path, and drop its delete sets."""
        manifest = self._manifest()
        number = manifest["next"]
        state = {}
        for table, schema in self.tables.items():
            rows = self.read(table)
            order = SORTED.get(table) or [c for c in ("path", "start_line", self.parent) if c in rows.columns]
            path = self._written(rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows, f"segments/{number:08d}-{uuid.uuid4().hex[:8]}/{table}", schema)
            state[table] = {"segments": [[number, path]] if path else [], "deletes": []}
        self._publish(manifest, number, state)
        return number

    @classmethod
    def check_merge(cls, spark: SparkSession, root: str) -> None:
        """Refuse to write where replacing one file's rows would touch another's. Done once a process, in a folder of its own."""
        if cls._checked:
            return
        own = cls(spark, f"{root.rstrip('/')}/merge-{uuid.uuid4().hex}", {"chunks": "file_id string, chunk_id string"})
        rows = lambda *pairs: spark.createDataFrame(list(pairs), "file_id string, chunk_id string")
        try:
            own.commit({"chunks": rows(("a", "1"), ("a", "2"), ("b", "3"))})
            own.commit({"chunks": rows(("a", "4"))}, replaced=rows(("a", "")).select("file_id"))
            kept = sorted(tuple(r) for r in own.read("chunks").collect())
        finally:
            own.drop()
        if kept != [("a", "4"), ("b", "3")]:
            raise EngineError("INDEX_INCOMPATIBLE", f"replacing a file's rows left {kept}")
        cls._checked = True

    def vacuum(self, keep_hours: float = 168, now: float | None = None) -> int:
        """Forget versions older than ``keep_hours`` but the live one and those that journals name; the number forgotten.

        Folders that no retained version names are deleted after the manifest
        no longer lists them.
        """
        manifest = self._manifest()
        limit = (time.time() if now is None else now) - keep_hours * 3600
        named = {self.folder.read_json(f"journals/{n}")["version"] for n in self.folder.names("journals") if n.endswith(".json")}
        old = [v for v, s in manifest["versions"].items() if s["created"] < limit and int(v) != manifest["live"] and int(v) not in named]
        for v in old:
            del manifest["versions"][v]
        self.folder.write_json("manifest.json", manifest)
        used = {path.split("/")[1] for s in manifest["versions"].values() for layers in s["tables"].values() for kind in layers.values() for _, path in kind}
        bases = {self.folder.read_json(f"journals/{n}").get("base", "").split("/")[-1] for n in self.folder.names("journals") if n.endswith(".json")}
        for name in self.folder.names("segments"):
            if name not in used | bases:
                self.folder.delete(f"segments/{name}")
        return len(old)

    def drop(self) -> bool:
        return self.folder.delete("")

    def stats(self) -> dict[str, dict]:
        """Physical bytes, and per table its live rows, segments and delete sets."""
        manifest = self._manifest()
        live = manifest["versions"][str(manifest["live"])]["tables"]
        out = {"physical_bytes": self.folder.size(""), "versions": len(manifest["versions"]), "tables": {}}
        for table, layers in live.items():
            out["tables"][table] = {"rows": self.read(table).count(), "bytes": sum(self.folder.size(p) for _, p in layers["segments"]), "segments": len(layers["segments"]), "deletes": len(layers["deletes"])}
        out["logical_bytes"] = sum(t["bytes"] for t in out["tables"].values())
        return out
