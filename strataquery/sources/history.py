"""Run history: begin and finish audits, mark crashed runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquery.operators import mutations

RUNS = (
    "run_id string, project_id string, trigger string, state string, pid long, started_at timestamp, finished_at timestamp, duration_ms long, "
    "files_seen long, files_indexed long, files_unchanged long, files_removed long, files_failed long, chunks long, references long, skipped long, "
    "skip_reasons string, skip_samples string, phase_durations string, errors string, storage_before string, storage_after string, config_hash string, slot_id string, version long"
)
#: Columns that may change after a run began.
MUTABLE = (
    "state", "finished_at", "duration_ms", "files_seen", "files_indexed", "files_unchanged", "files_removed", "files_failed", "chunks",
    "references", "skipped", "skip_reasons", "skip_samples", "phase_durations", "errors", "storage_before", "storage_after", "version",
)

# Why a run started.
TRIGGERS = ("manual", "startup", "watcher", "lazy-query", "reference-backfill", "schema-rebuild", "maintenance")


def begin(runs: DataFrame, rows: DataFrame) -> DataFrame:
    return mutations.upsert(runs, rows.select(*runs.columns), "run_id")


def finish(runs: DataFrame, run_id: str, **updates) -> DataFrame:
    if unknown := set(updates) - set(MUTABLE):
        raise ValueError(f"columns that don't change: {sorted(unknown)}")
    kinds = dict(runs.dtypes)
    own = F.col("run_id") == run_id
    return runs.withColumns({k: F.when(own, F.lit(v).cast(kinds[k])).otherwise(F.col(k)) for k, v in updates.items()})


def interrupted(runs: DataFrame, live: Sequence[int]) -> DataFrame:
    """Running rows of processes that are gone become interrupted; process 0 counts as gone."""
    gone = (F.col("state") == "running") & ((F.coalesce("pid", F.lit(0)) == 0) | ~F.col("pid").isin(list(live)))
    return runs.withColumn("state", F.when(gone, "interrupted").otherwise(F.col("state")))


def phase_totals(runs: DataFrame, group: str = "project_id") -> DataFrame:
    """Wall time of each phase over all runs of a group, in milliseconds, and the runs that have it."""
    spent = runs.select(group, F.explode(F.from_json("phase_durations", "map<string, bigint>")).alias("phase", "ms"))
    return spent.groupBy(group, "phase").agg(F.sum("ms").alias("total_ms"), F.count(F.lit(1)).alias("runs"))


def parsed(runs: DataFrame) -> DataFrame:
    """JSON columns as maps and arrays."""
    maps = {c: F.from_json(c, "map<string, bigint>") for c in ("skip_reasons", "phase_durations", "storage_before", "storage_after")}
    return runs.withColumns(maps | {c: F.from_json(c, "array<string>") for c in ("skip_samples", "errors")})
