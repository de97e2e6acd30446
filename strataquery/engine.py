"""The engine's service surface: projects, indexing, search, references, history, storage.

Methods return plain values: rows are collected only where a page or a report
is the answer. Everything before that is DataFrame code of the operators.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Sequence
from datetime import UTC, datetime, timedelta
from pathlib import Path
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.errors import EngineError
from strataquery.functions import paths, text, vectors
from strataquery.operators import changes, paging, references, retrieval, textindex, windows
from strataquery.settings import Settings
from strataquery.sources import extract, files, history, project
from strataquery.sources.hadoop import Folder
from strataquery.sources.progress import Progress
from strataquery.sources.store import PartitionStore
from strataquery.streaming.watch import Watcher

#: Schema generation of the stored tables.
SCHEMA_VERSION = 6
#: Seconds for which a clean answer to "is the index fresh" holds.
FRESH_SECONDS = 5


class Embedder(Protocol):
    """What turns passages and queries into vectors; ``model`` names it, and rows of another model are rebuilt."""

    model: str

    def passages(self, text: Column) -> Column: ...

    def query(self, text: str) -> Sequence[float]: ...


class HashedWords:
    """The embedder without a model: hashed word counts."""

    def __init__(self, width: int):
        self.model, self.width = "hashed-words-v1", width

    def passages(self, text: Column) -> Column:
        return vectors.hash_embedding(text, self.width)

    def query(self, text: str) -> Sequence[float]:
        return vectors.hashed_words(text, self.width)


class Engine:
    """``root`` is a folder on any file system that Spark reaches; it holds the registry and all partitions."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, embedder: Embedder | None = None):
        self.spark, self.settings = spark, settings or Settings.from_environment()
        self.embedder = embedder or HashedWords(self.settings.vector_width)
        self.folder = Folder(spark, root)
        self._fresh: dict[str, tuple] = {}
        self._runs = PartitionStore(spark, self.folder.at("runs"), {"runs": history.RUNS}, parent="run_id")

    # -- registry ---------------------------------------------------------

    def _registry(self) -> dict:
        return self.folder.read_json("registry.json") or {"projects": {}, "slots": {}, "active": {}}

    def _save(self, registry: dict) -> None:
        """Write the registry unless it is as it was."""
        if registry != self.folder.read_json("registry.json"):
            self.folder.write_json("registry.json", registry)

    def list_projects(self) -> list[project.Project]:
        found = [project.Project(p["id"], p["name"], p["root"], tuple(p["include"]), tuple(p["exclude"]), p["largest"]) for p in self._registry()["projects"].values()]
        return sorted(found, key=lambda p: (p.name, p.id))

    def init_project(self, path: str, name: str | None = None, force_new_id: bool = False, allow_overlap: bool = False) -> project.Project:
        root = Path(path).expanduser().resolve()
        if not allow_overlap:
            for other in self.list_projects():
                how = project.overlap(str(root), other.root)
                marked = (root / project.MARKER).is_file() and project.read_marker(root).id == other.id
                if how and not (how == "same" and marked and not force_new_id):
                    raise EngineError("OVERLAPPING_PROJECT", f"the folder overlaps project {other.name}", relation=how, project_id=other.id)
        own = project.write_marker(root, name, force_new_id)
        registry = self._registry()
        known = registry["projects"].get(own.id)
        if known and project.overlap(known["root"], own.root) != "same" and Path(known["root"], project.MARKER).exists():
            raise EngineError("PROJECT_ID_CONFLICT", "another folder is registered under this id", root=known["root"])
        state = known["state"] if known else "new"
        registry["projects"][own.id] = {"id": own.id, "name": own.name, "root": own.root, "include": list(own.include), "exclude": list(own.exclude), "largest": own.largest, "model": self.embedder.model, "width": self.settings.vector_width, "schema": SCHEMA_VERSION, "storage": self.settings.vector_storage, "state": state}
        self._save(registry)
        return own

    def resolve(self, selector: str) -> project.Project:
        """A project by id, by its only name, or by a path inside it."""
        known = self.list_projects()
        direct = [p for p in known if selector in (p.id, p.name)]
        if len(direct) > 1:
            raise EngineError("AMBIGUOUS_PROJECT", f"several projects are named {selector}", projects=[p.id for p in direct])
        if direct:
            return direct[0]
        root = project.find_root(Path(selector)) if Path(selector).expanduser().exists() else None
        for p in known:
            if root is not None and Path(p.root).resolve() == root:
                return p
        raise EngineError("PROJECT_NOT_FOUND", f"unknown project: {selector}")

    def remove_project(self, selector: str) -> bool:
        try:
            own = self.resolve(selector)
        except EngineError:
            return False
        registry = self._registry()
        del registry["projects"][own.id]
        gone = [s for s, v in registry["slots"].items() if v["project_id"] == own.id]
        for slot in gone:
            self.folder.delete(f"partitions/{project.partition_id(slot)}")
            del registry["slots"][slot]
        registry["active"].pop(own.id, None)
        self._save(registry)
        return True

    # -- slots ------------------------------------------------------------

    def _activate(self, own: project.Project) -> str:
        """The slot of the project's present branch; the pointer's epoch rises when it moves."""
        state = project.git_state(Path(own.root))
        slot = project.slot_id(own.id, state)
        registry = self._registry()
        now = time.time_ns()
        registry["slots"].setdefault(slot, {"project_id": own.id, "kind": state.kind, "value": state.value, "created_at": now, "state": "new"})["last_used_at"] = now
        pointer = registry["active"].get(own.id, {"slot_id": None, "epoch": 0})
        if pointer["slot_id"] != slot:
            registry["active"][own.id] = {"slot_id": slot, "epoch": pointer["epoch"] + 1}
        self._save(registry)
        return slot

    def _partition(self, own: project.Project) -> PartitionStore:
        slot = self._registry()["active"].get(own.id, {}).get("slot_id") or project.slot_id(own.id, project.git_state(Path(own.root)))
        return self._store(slot)

    def _store(self, slot: str) -> PartitionStore:
        return PartitionStore(self.spark, self.folder.at(f"partitions/{project.partition_id(slot)}"))

    # -- indexing ---------------------------------------------------------

    def _scan(self, own: project.Project) -> DataFrame:
        return files.classified(files.scan(self.spark, own.root, excludes=own.exclude), includes=own.include, largest=own.largest)

    def index_project(self, selector: str, force: bool = False, trigger: str = "manual") -> dict:
        """Bring the index up to the files; a run without changes makes no version."""
        if trigger not in history.TRIGGERS:
            raise EngineError("INVALID_FILTER", f"unknown trigger {trigger}")
        own = self.resolve(selector)
        reason = self.incompatibility(own.id)
        slot = self._activate(own)
        store = self._store(slot)
        PartitionStore.check_merge(self.spark, self.folder.root)
        store.recover()
        store.lock()
        progress = Progress(self.folder, own.id)
        progress.update("indexing", 0, force=True)
        run = {"run_id": uuid.uuid4().hex, "project_id": own.id, "trigger": trigger, "pid": os.getpid(), "started_at": datetime.now(UTC), "config_hash": own.config_hash[:16], "slot_id": slot}
        began = time.monotonic()
        try:
            report = self._index(own, slot, store, force or bool(reason))
            state = "finished"
        except Exception as error:
            report, state = {"errors": json.dumps([str(error)[:500]])}, "failed"
            raise
        finally:
            store.unlock()
            progress.clear()
            self._audit(run | report | {"state": state, "finished_at": datetime.now(UTC), "duration_ms": int(1000 * (time.monotonic() - began))})
        self._fresh[own.id] = (time.monotonic(), slot, own.config_hash)
        registry = self._registry()
        entry = registry["projects"][own.id]
        entry |= {"state": changes.derived_state(store.read("files"), report["files_failed"]).first()["state"], "model": self.embedder.model, "width": self.settings.vector_width, "schema": SCHEMA_VERSION, "storage": self.settings.vector_storage}
        registry["slots"][slot]["state"] = entry["state"]
        self._save(registry)
        if self.settings.auto_maintenance:
            self._scheduled_maintenance(own.id)
        return report | {"project_id": own.id, "run_id": run["run_id"], "state": entry["state"]}

    def _index(self, own: project.Project, slot: str, store: PartitionStore, force: bool) -> dict:
        # the listing comes from this machine's tree, so it is made once and kept
        scanned = self._scan(own).persist()
        cached = [scanned]
        try:
            stored = store.read("files")
            old = stored.select("path", F.col("file_id").alias("old_id"), F.col("size").alias("old_size"), F.col("mtime_ns").alias("old_mtime"), F.col("content_hash").alias("old_hash"))
            wanted = scanned.where("status = 'candidate'").select("path", "language", "size", "mtime_ns").join(old, "path", "left")
            same = F.col("old_id").isNotNull() & (F.col("old_size") == F.col("size")) & (F.col("old_mtime") == F.col("mtime_ns"))
            moved = wanted if force else wanted.where(~F.coalesce(same, F.lit(False)))
            read = files.with_contents(self.spark, own.root, moved).withColumn("file_id", text.joined_hash(F.lit(own.id), F.col("path"))).withColumn("project_id", F.lit(own.id)).withColumn("hash", text.content_hash(F.col("content"))).persist()
            touched = F.col("old_hash").eqNullSafe(F.col("hash")) & F.col("old_id").isNotNull() & F.lit(not force)
            parsed = extract.extract(read.where(~touched)).persist()
            cached += [read, parsed]
            facts = read.select("file_id", "size", "mtime_ns")
            now = F.lit(time.time_ns())
            fresh = parsed.select("file_id", "project_id", "path", "language", "content_hash", "has_errors", "error").join(facts, "file_id").withColumn("indexed_at", now)
            again = read.where(touched).select("file_id", "size", F.col("mtime_ns").alias("m"), F.lit(True).alias("hit")).join(stored.drop("size", "mtime_ns", "indexed_at"), "file_id").withColumnRenamed("m", "mtime_ns").withColumn("indexed_at", now).drop("hit")
            gone = changes.removed(stored, scanned.where("status = 'candidate'"))
            chunk_rows = extract.chunk_rows(parsed, slot, self.embedder.passages)
            if self.settings.vector_storage == "float16":
                chunk_rows = chunk_rows.withColumn("vector", vectors.half_precision(F.col("vector")))
            rows = {"files": fresh.unionByName(again.select(*fresh.columns)), "chunks": chunk_rows, "references": extract.reference_rows(parsed), "postings": extract.posting_rows(chunk_rows)}
            phases = {}
            for phase, table in (("scan", scanned), ("read", read), ("extract", parsed)):
                began = time.monotonic()
                table.count()
                phases[phase] = int(1000 * (time.monotonic() - began))
            began = time.monotonic()
            version = store.commit(rows, replaced=parsed.select("file_id"), removed=gone.select("file_id"), only={"files": again.select("file_id")})
            phases["commit"] = int(1000 * (time.monotonic() - began))
            done = parsed.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNotNull()).alias("bad"), F.coalesce(F.sum(F.size("chunks")), F.lit(0)).alias("chunks"), F.coalesce(F.sum(F.size("rows")), F.lit(0)).alias("rows")).first()
            skipped = changes.skip_report(scanned.where("status != 'candidate'").select(F.col("status").alias("reason"), "path")).collect()
            seen = scanned.count()
            listed = wanted.count()
            errors = [f"{r['path']}: {r['error']}" for r in parsed.where("error is not null").orderBy("path").select("path", "error").limit(20).collect()]
            return {
                "files_seen": seen, "files_indexed": done["n"] - done["bad"], "files_unchanged": listed - done["n"], "files_removed": gone.count() if version else 0, "files_failed": done["bad"],
                "chunks": done["chunks"], "references": done["rows"], "skipped": sum(r["files"] for r in skipped), "skip_reasons": json.dumps({r["reason"]: r["files"] for r in skipped}),
                "skip_samples": json.dumps([p for r in skipped for p in r["sample"].split(" ")][:20]), "errors": json.dumps(errors), "version": version, "phase_durations": json.dumps(phases),
            }
        finally:
            for kept in cached:
                kept.unpersist()

    def backfill_references(self, selector: str) -> int:
        """Parse again the files without structural rows of this generation; the number of files."""
        own = self.resolve(selector)
        store = self._partition(own)
        stored = store.read("files").where("not has_errors").where(F.col("language").isin(list(extract.STRUCTURAL)))
        coverage = store.read("references").where("record_kind = 'coverage'")
        missing = changes.without_coverage(stored, coverage, references.GENERATION)
        read = files.with_contents(self.spark, own.root, missing.select("file_id", "project_id", "path", "language", F.col("content_hash").alias("known")))
        fresh = read.where(text.content_hash(F.col("content")) == F.col("known"))  # files that moved on wait for a run
        parsed = extract.extract(fresh).persist()
        count = parsed.count()
        if count:
            store.commit({"references": extract.reference_rows(parsed)}, only={"references": parsed.select("file_id")})
        parsed.unpersist()
        return count

    def incompatibility(self, project_id: str) -> str:
        """Why stored rows can't be used with these settings; empty if they can."""
        known = self._registry()["projects"][project_id]
        if known["state"] == "new":
            return ""
        row = self.spark.range(1).select(changes.incompatibility(F.lit(known["model"]), F.lit(known["width"]), F.lit(known["schema"]), F.lit(known["storage"]), want=(self.embedder.model, self.settings.vector_width, SCHEMA_VERSION, self.settings.vector_storage)).alias("r")).first()
        return row["r"]

    def is_stale(self, selector: str) -> bool:
        """Whether files differ from the index; a clean answer is remembered for a moment."""
        own = self.resolve(selector)
        slot = project.slot_id(own.id, project.git_state(Path(own.root)))
        seen = self._fresh.get(own.id)
        if seen and time.monotonic() - seen[0] < FRESH_SECONDS and seen[1:] == (slot, own.config_hash):
            return False
        stale = changes.is_stale(self._store(slot).read("files"), self._scan(own).where("status = 'candidate'"), "path", ["size", "mtime_ns", "language"]).first()["stale"]
        if not stale:
            self._fresh[own.id] = (time.monotonic(), slot, own.config_hash)
        return stale

    def _refresh(self, own: project.Project) -> None:
        """Before a query in lazy mode: index if the files moved on."""
        if self.settings.mode == "lazy" and self.is_stale(own.id):
            self.index_project(own.id, trigger="lazy-query")

    # -- history ----------------------------------------------------------

    def _audit(self, row: dict) -> None:
        """Add the run; trouble here never fails the run itself."""
        try:
            columns = self.spark.createDataFrame([], history.RUNS).columns
            one = self.spark.createDataFrame([tuple(row.get(c) for c in columns)], history.RUNS)
            runs = self._runs.read("runs").unionByName(one)
            kept = windows.retained_runs(runs, F.current_timestamp())
            stale = self._runs.read("runs").join(kept.select("run_id"), "run_id", "left_anti")
            self._runs.commit({"runs": one}, removed=stale.select("run_id"))
        except Exception as error:  # the audit is a record, not a condition
            print(f"run history was not written: {error}")

    def index_history(self, selector: str, limit: int = 20, cursor: str | None = None) -> dict:
        if not 1 <= limit <= 200:
            raise EngineError("INVALID_FILTER", "limit must be 1 to 200")
        own = self.resolve(selector)
        after = None
        if cursor:
            try:
                after = json.loads(paging.base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
                after = (datetime.fromisoformat(after[0]), after[1])
            except (ValueError, TypeError, IndexError) as error:
                raise EngineError("INVALID_CURSOR", "not a cursor of the history") from error
        rows = paging.keyset_page(history.parsed(self._runs.read("runs").where(F.col("project_id") == own.id)), ["started_at", "run_id"], after, limit).collect()
        following = None
        if len(rows) > limit:
            last = rows[limit - 1]
            following = paging.encode_cursor([last["started_at"].isoformat(), last["run_id"]])
        return {"runs": [r.asDict(recursive=True) for r in rows[:limit]], "cursor": following}

    def mark_interrupted(self) -> None:
        """Runs of processes that are gone, as after a crash."""
        runs = self._runs.read("runs").where("state = 'running'")
        pids = [r["pid"] for r in runs.select("pid").distinct().collect()]
        live = [p for p in pids if p and Path(f"/proc/{p}").exists()]
        marked = history.interrupted(runs, live).where("state = 'interrupted'")
        self._runs.commit({"runs": marked}, replaced=marked.select("run_id"))

    def project_status(self, selector: str) -> dict:
        own = self.resolve(selector)
        store = self._partition(own)
        registry = self._registry()
        known = self._runs.read("runs").where((F.col("project_id") == own.id) & F.col("finished_at").isNotNull())
        last = known.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(1).collect()
        return {"project_id": own.id, "name": own.name, "state": registry["projects"][own.id]["state"], "files": store.read("files").count(), "chunks": store.read("chunks").count(), "version": store.version, "last_run": last[0].asDict() if last else None, "stale": self.is_stale(own.id), "incompatibility": self.incompatibility(own.id), "progress": Progress(self.folder, own.id).read()}

    def inspect_scan(self, selector: str, statuses: Sequence[str] = (), offset: int = 0, limit: int = 100) -> dict:
        """What indexing would do with each path, without reading a file."""
        if not 1 <= limit <= 500:
            raise EngineError("INVALID_FILTER", "limit must be 1 to 500")
        own = self.resolve(selector)
        rows = self._scan(own).select("path", "language", "status")
        counts = {r["status"]: r["count"] for r in rows.groupBy("status").count().collect()}
        if statuses:
            rows = rows.where(F.col("status").isin(list(statuses)))
        page = rows.orderBy("path").offset(offset).limit(limit).collect()
        return {"counts": counts, "rows": [r.asDict() for r in page]}

    # -- storage ----------------------------------------------------------

    def index_storage_status(self) -> dict:
        registry = self._registry()
        slots = {}
        for slot, facts in registry["slots"].items():
            store = self._store(slot)
            if store.exists:
                before = store.version
                slots[slot] = store.stats() | {"project_id": facts["project_id"], "active": registry["active"].get(facts["project_id"], {}).get("slot_id") == slot, "consistent": before == store.version}
        physical = self.folder.size("")
        return {"physical_bytes": physical, "reclaimable_bytes": sum(max(0, s["physical_bytes"] - s["logical_bytes"]) for s in slots.values()), "slots": slots}

    def index_storage_maintenance(self, selector: str | None = None, keep_hours: float | None = None) -> dict:
        """Compact, forget old versions, and evict the branches that were used longest ago."""
        registry = self._registry()
        chosen = [self.resolve(selector).id] if selector else list(registry["projects"])
        hours = self.settings.retention_hours if keep_hours is None else keep_hours
        done, busy, freed, removed = [], [], 0, 0
        for own in chosen:
            slots = {s: v for s, v in registry["slots"].items() if v["project_id"] == own}
            active = registry["active"].get(own, {}).get("slot_id")
            free = sorted((v["last_used_at"], s) for s, v in slots.items() if s != active and not self._store(s).pending())
            for _, slot in free[: max(0, len(slots) - self.settings.slot_limit)]:
                freed += self._store(slot).stats()["physical_bytes"] if self._store(slot).exists else 0
                self._store(slot).drop()
                del registry["slots"][slot]
            for slot in [s for s in slots if s in registry["slots"]]:
                store = self._store(slot)
                if not store.exists:
                    continue
                try:
                    store.lock()
                except EngineError:
                    busy.append(slot)
                    continue
                try:
                    before = store.stats()["physical_bytes"]
                    if any(t["segments"] > 1 or t["deletes"] for t in store.stats()["tables"].values()):
                        store.compact()
                    removed += store.vacuum(hours)
                    freed += before - store.stats()["physical_bytes"]
                finally:
                    store.unlock()
            done.append(own)
        self._save(registry)
        return {"projects": done, "busy": busy, "bytes_reclaimed": freed, "versions_removed": removed}

    def _scheduled_maintenance(self, own: str) -> None:
        """At most once a day; the stamp is written only after a whole pass."""
        stamp = self.folder.read_json("maintenance.json") or {}
        if time.time() - stamp.get(own, 0) >= timedelta(days=1).total_seconds():
            if stamp and not self.index_storage_maintenance(own)["busy"] or not stamp:
                self.folder.write_json("maintenance.json", stamp | {own: time.time()})

    # -- retrieval --------------------------------------------------------

    def _chunks(self, owns: Sequence[project.Project]) -> DataFrame:
        parts = [self._partition(p).read("chunks").withColumn("project_id", F.lit(p.id)) for p in owns]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows

    def _names(self) -> DataFrame:
        return self.spark.createDataFrame([(p.id, p.name) for p in self.list_projects()], "project_id string, name string")

    def search_code(self, query: str, projects: Sequence[str], *, languages: Sequence[str] = (), paths_like: Sequence[str] = (), kinds: Sequence[str] = (), limit: int = 8) -> list[dict]:
        """Hybrid search: keyword and vector ranks inside each project, fused, merged in the order the projects were named."""
        query = query.strip()
        if not query or not projects:
            raise EngineError("INVALID_FILTER", "a search needs a query and a project")
        owns = list({p.id: p for p in map(self.resolve, projects)}.values())
        for own in owns:
            self._refresh(own)
        limit = retrieval.clamp(limit)
        chunks = self._chunks(owns)
        for column, values in (("language", languages), ("kind", kinds)):
            if values:
                chunks = chunks.where(F.col(column).isin(list(values)))
        if paths_like:
            chunks = chunks.where(paths.path_matches(F.col("path"), list(paths_like)))
        words = [w.lower() for w in re.findall(r"[^\W_]+", query)] or [query.lower()]
        texts = self._keywords(owns, chunks, words, bool(languages or paths_like or kinds))
        near = retrieval.vector_scores(chunks, "chunk_id", "vector", self.embedder.query(query)).where(F.col("score").isNotNull())
        fetch = retrieval.fetch_size(limit)

        def ranks(scores: DataFrame) -> DataFrame:
            placed = scores.withColumn("project_id", F.substring_index("key", ":", 1))
            top = retrieval.partition_top(placed, "project_id", "key", fetch)
            return top.select("project_id", "key", (1.0 / (retrieval.FUSION + F.col("in_rank"))).alias("part"))

        scored = ranks(texts).unionByName(ranks(near)).groupBy("project_id", "key").agg(F.sum("part").alias("score"))
        order = F.array_position(F.array(*[F.lit(p.id) for p in owns]), F.col("project_id"))
        best = scored.withColumn("rank", F.struct((-F.col("score")).alias("s"), order.alias("asked"), F.col("key").alias("k")))
        hits = best.withColumnRenamed("key", "chunk_id").join(chunks.drop("vector"), ["project_id", "chunk_id"])
        hits = retrieval.dedupe_hits(hits, limit=limit)
        return [r.asDict() for r in self._shown(hits).collect()]

    def _keywords(self, owns: Sequence[project.Project], chunks: DataFrame, words: Sequence[str], filtered: bool) -> DataFrame:
        """key and BM25 over both text fields, from the postings of the query's terms and two narrow columns of the chunks."""
        parts = [self._partition(p).read("postings").where(F.col("term").isin(list(words))) for p in owns]
        hits = parts[0]
        for part in parts[1:]:
            hits = hits.unionByName(part)
        hits = hits.withColumnRenamed("chunk_id", "key")
        if filtered:
            hits = hits.join(chunks.select(F.col("chunk_id").alias("key")), "key", "left_semi")
        n, *means = chunks.agg(F.count(F.lit(1)), *[F.coalesce(F.avg(f"{f}_length"), F.lit(0.0)) for f in ("content", "identifier")]).first()
        both = [textindex.scored(hits.where(F.col("field") == f), n, mean, ["key"]) for f, mean in zip(("content", "identifier"), means)]
        return both[0].unionByName(both[1]).groupBy("key").agg(F.sum("score").alias("score"))

    def _shown(self, hits: DataFrame) -> DataFrame:
        named = retrieval.with_snippet(retrieval.with_names(hits, self._names()))
        score = F.col("score") if "score" in hits.columns else F.lit(1.0)
        return named.select("chunk_id", "project_id", "project_name", "path", "language", "kind", "symbol", "qualified_symbol", "start_line", "end_line", score.alias("score"), "snippet", "truncated")

    def search_across_projects(self, query: str, projects: Sequence[str] = (), all_projects: bool = False, **options) -> list[dict]:
        if bool(projects) == all_projects:
            raise EngineError("INVALID_FILTER", "name projects or ask for all, not both")
        chosen = [p.id for p in self.list_projects()] if all_projects else list(dict.fromkeys(self.resolve(p).id for p in projects))
        if len(chosen) < 2:
            raise EngineError("INVALID_FILTER", "a search across projects needs two of them")
        return self.search_code(query, chosen, **options)

    def find_symbol(self, name: str, selector: str, *, match: str = "exact", kinds: Sequence[str] | None = None, limit: int = 20) -> list[dict]:
        if match not in ("exact", "prefix", "contains"):
            raise EngineError("INVALID_FILTER", f"invalid symbol match mode: {match}")
        own = self.resolve(selector)
        self._refresh(own)
        found = retrieval.find_symbol(self._chunks([own]), name, match=match, kinds=kinds, limit=limit)
        return [r.asDict() for r in self._shown(found).orderBy("path", "start_line", "kind").collect()]

    def file_outline(self, path: str, selector: str) -> list[dict]:
        own = self.resolve(selector)
        self._refresh(own)
        return [r.asDict() for r in retrieval.outline(self._chunks([own]), path).collect()]

    def get_chunk(self, chunk_id: str) -> dict:
        own, colon, rest = chunk_id.partition(":")
        known = {p.id: p for p in self.list_projects()}
        rows = retrieval.chunk_by_id(self._chunks([known[own]]), self._names(), chunk_id).drop("vector").take(1) if own in known and colon and rest else []
        if not rows:
            raise EngineError("CHUNK_NOT_FOUND", f"unknown chunk: {chunk_id}; ids change when a file is indexed again", chunk_id=chunk_id)
        return rows[0].asDict()

    # -- references -------------------------------------------------------

    def _select(self, own: project.Project, rows: DataFrame, chunk_id: str | None, path: str | None, symbol: str | None) -> references.Selected:
        if bool(chunk_id) == bool(path and symbol):
            raise EngineError("INVALID_FILTER", "name a chunk, or a path and a symbol")
        if chunk_id:
            chunk = self.get_chunk(chunk_id)
            path, symbol = chunk["path"], chunk["qualified_symbol"]
            if not symbol:
                raise EngineError("INVALID_FILTER", "the chunk defines no symbol")
        language = self.spark.createDataFrame([(path,)], "path string").select(paths.language_of(F.col("path"))).first()[0]
        if language not in extract.STRUCTURAL:
            raise EngineError("UNSUPPORTED_LANGUAGE", f"no references for {language}", path=path)
        declared = rows.where("record_kind = 'declaration'")
        found, near = references.declaration_matches(declared, path, symbol)
        if len(found) > 1:
            raise EngineError("AMBIGUOUS_SYMBOL", f"several declarations of {symbol} in {path}")
        if not found:
            raise EngineError("REFERENCE_INDEX_UNAVAILABLE" if declared.isEmpty() else "INVALID_FILTER", f"no declaration of {symbol} in {path}", near=near)
        row = found[0]
        return references.Selected(row["file_id"], path, language, row["kind"], row["written_name"], row["target_name"])

    def _hits(self, own: project.Project, store: PartitionStore, version: int, selected: references.Selected) -> tuple[DataFrame, list[dict]]:
        """Hits of files that are as they were indexed, and all limitations."""
        rows = store.read("references", version).where(F.col("schema_version") == references.GENERATION)
        stored = store.read("files", version)
        hits = references.find_references(rows, stored.select("path"), selected).persist()
        touched = files.with_contents(self.spark, own.root, hits.select("path").distinct())
        current = touched.select("path", F.coalesce(text.content_hash(F.col("content")), F.lit("")).alias("content_hash"))
        coverage = rows.where("record_kind = 'coverage'").select("path", "content_hash")
        kept, stale = references.fresh_only(hits, coverage, current)
        gaps = changes.coverage_gaps(stored, extract.STRUCTURAL).select(F.lit("unsupported_language").alias("code"), F.concat("language", F.lit(": "), "sample").alias("explanation"), F.lit(None).cast("string").alias("path"))
        broken = stored.where("has_errors").select(F.lit("file_with_errors").alias("code"), F.coalesce("error", F.lit("The file doesn't parse.")).alias("explanation"), "path")
        limits = references.limitations(kept).unionByName(stale).unionByName(gaps).unionByName(broken).distinct().orderBy("code", F.coalesce("path", F.lit("")))
        return kept, [r.asDict() for r in limits.collect()]

    def find_references(self, selector: str, *, chunk_id: str | None = None, path: str | None = None, symbol: str | None = None, kinds: Sequence[str] = (), limit: int = 50, cursor: str | None = None) -> dict:
        if not 1 <= limit <= 100:
            raise EngineError("INVALID_FILTER", "limit must be 1 to 100")
        own = self.resolve(selector)
        self._refresh(own)
        store = self._partition(own)
        version = store.version
        selected = self._select(own, store.read("references", version), chunk_id, path, symbol)
        bound = {"version": version, "project": own.id, "limit": limit, "question": paging.digest({"path": selected.path, "symbol": selected.qualified_symbol, "kinds": sorted(kinds)})}
        offset = paging.decode_cursor(cursor, bound) if cursor else 0
        hits, limits = self._hits(own, store, version, selected)
        if kinds:
            hits = hits.where(F.col("kind").isin(list(kinds)))
        order = [F.col(c) for c in ("path", "start_line", "start_byte", "reference_id")]
        page = paging.offset_page(hits, order, offset, limit + 1).collect()
        following = paging.encode_cursor(bound | {"offset": offset + limit}) if len(page) > limit else None
        columns = ("reference_id", "path", "kind", "written_name", "source_qualified_symbol", "start_byte", "end_byte", "start_line", "end_line", "resolution", "reason")
        rows = [{c: r[c] for c in columns} | {"explanation": references.EXPLANATIONS[r["reason"]]} for r in page[:limit]]
        return {"declaration": selected, "references": rows, "limitations": limits, "cursor": following}

    def analyze_refactor(self, selector: str, operation: dict, *, chunk_id: str | None = None, path: str | None = None, symbol: str | None = None, limit: int = 50, offset: int = 0) -> dict:
        """Impact of ``{"rename": name}`` or ``{"signature": [parameters]}`` on all uses."""
        own = self.resolve(selector)
        self._refresh(own)
        store = self._partition(own)
        version = store.version
        rows = store.read("references", version)
        selected = self._select(own, rows, chunk_id, path, symbol)
        if set(operation) not in ({"rename"}, {"signature"}):
            raise EngineError("INVALID_REFACTOR", "an operation is a rename or a signature")
        if "rename" in operation and (not text.is_identifier(operation["rename"], selected.language) or operation["rename"] == selected.symbol):
            raise EngineError("INVALID_REFACTOR", f"{operation['rename']!r} is no new name")
        hits, limits = self._hits(own, store, version, selected)
        edits = None
        if "rename" in operation:
            found = hits.withColumn("bucket", references.rename_bucket(F.col("resolution"), F.col("written_name"), F.col("kind"), selected.symbol))
            read = files.with_contents(self.spark, own.root, found.where("bucket = 'must_change'").select("path").distinct())
            span = F.expr("substring(content, start_byte + 1, end_byte - start_byte)").cast("string")
            place = text.sole_position(span, F.lit(selected.symbol))
            edits = found.join(read, "path").where("bucket = 'must_change'").select("reference_id", (F.col("start_byte") + F.octet_length(F.substring(span, F.lit(1), place))).alias("edit_start"))
            found = found.join(edits, "reference_id", "left").withColumn("edit_end", F.col("edit_start") + len(selected.symbol.encode()))
        else:
            fresh = rows.where(F.col("schema_version") == references.GENERATION)
            old = fresh.where((F.col("record_kind") == "declaration") & (F.col("target_name") == selected.qualified_symbol) & (F.col("path") == selected.path))
            shapes = [r["shape_json"] for r in old.select("shape_json").limit(2).collect()]
            former = F.from_json(F.lit(shapes[0] if shapes else None).cast("string"), references.PARAMETERS)
            new = F.from_json(F.lit(json.dumps([{"position": i, "destructured": False, "required": False, "kind": "positional"} | p for i, p in enumerate(operation["signature"])])), references.PARAMETERS)
            receiver = F.lit(selected.language == "python" and selected.kind == "method") & F.coalesce(F.col("receiver_text").isin("self", "cls"), F.lit(False))
            issue = references.signature_issue(F.from_json("shape_json", references.CALL_SHAPE), former, new, overloads=F.lit(len(shapes)), bound=receiver)
            found = hits.withColumn("issue", F.when(F.col("kind") == "call", issue)).withColumn("bucket", references.signature_bucket(F.col("resolution"), F.col("issue")))
            found = found.withColumn("reason", F.coalesce("issue", "reason")).withColumns({"edit_start": F.lit(None).cast("long"), "edit_end": F.lit(None).cast("long")})
        columns = ("reference_id", "path", "kind", "written_name", "start_byte", "end_byte", "start_line", "resolution", "reason", "bucket", "edit_start", "edit_end")
        declared = rows.where((F.col("record_kind") == "declaration") & (F.col("target_name") == selected.qualified_symbol) & (F.col("path") == selected.path))
        extra = declared.withColumn("bucket", F.lit("declaration"))
        if selected.kind == "method":
            extra = extra.unionByName(references.overrides(rows, store.read("files", version).select("path"), selected).withColumn("bucket", F.lit("override")))
        extra = extra.withColumns({"resolution": F.lit("exact"), "reason": F.lit("declaration"), "edit_start": F.col("start_byte"), "edit_end": F.col("end_byte")})
        findings = windows.dedupe_edits(found.select(*columns).unionByName(extra.select(*columns)), span=("path", "edit_start", "edit_end"), precedence=(*windows.PRECEDENCE, "review", "evidence")).persist()
        counts = {r["bucket"]: r["findings"] for r in references.bucket_counts(findings).collect()}
        gap = any(x["code"] in ("stale_file", "unsupported_language", "file_with_errors") for x in limits)
        unsure = bool(limits) or any(counts.get(b) for b in ("review", "likely_change", "override"))
        state = "incomplete" if gap else "complete_with_dynamic_limitations" if unsure else "complete"
        page = paging.offset_page(findings, [F.col(c) for c in ("path", "start_line", "start_byte", "reference_id")], offset, limit).collect()
        findings.unpersist()
        return {"declaration": selected, "counts": counts, "completeness": state, "limitations": limits, "findings": [r.asDict() for r in page]}

    # -- continuous refresh -----------------------------------------------

    def watch(self, selector: str, passes: int, interval: float = 0.25, **options) -> int:
        """Look at a project's tree every ``interval`` seconds and index it when a ``Watcher`` says so; the number of runs."""
        own, runs = self.resolve(selector), 0

        def run() -> None:
            nonlocal runs
            self._fresh.pop(own.id, None)
            if self.is_stale(own.id):
                self.index_project(own.id, trigger="watcher")
                runs += 1

        watcher, seen = Watcher(run, **options), None
        for _ in range(passes):
            now = files.tree_mark(own.root)
            if now != seen:
                watcher.notice()
            seen = now
            watcher.step()
            time.sleep(interval)
        return runs
