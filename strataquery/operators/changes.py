"""Change detection between stored and scanned files, coverage and run reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Skipped paths that a report shows of each kind.
SAMPLE = 20


def rejection(content: Column) -> Column:
    """``binary`` for content with a NUL byte, ``encoding`` for content that isn't UTF-8, else null."""
    return F.when(F.contains(content, F.lit(b"\x00")), "binary").when(~F.is_valid_utf8(content.cast("string")), "encoding")


def classify_changes(stored: DataFrame, scanned: DataFrame, key: str = "path") -> DataFrame:
    """key and change: added, changed, metadata_only, unchanged, removed or rejected.

    Both sides have size, mtime_ns and content_hash; ``scanned`` may have a
    rejection reason in ``rejected``. One full outer join on the key.
    """
    old = stored.select(F.col(key), F.col("size").alias("s0"), F.col("mtime_ns").alias("m0"), F.col("content_hash").alias("h0"), F.lit(True).alias("in0"))
    refused = F.col("rejected") if "rejected" in scanned.columns else F.lit(None).cast("string")
    new = scanned.select(F.col(key), F.col("size").alias("s1"), F.col("mtime_ns").alias("m1"), F.col("content_hash").alias("h1"), refused.alias("rejected"), F.lit(True).alias("in1"))
    change = (
        F.when(F.col("in1").isNull(), "removed")
        .when(F.col("in0") & (F.col("s0") == F.col("s1")) & (F.col("m0") == F.col("m1")), "unchanged")
        .when(F.col("rejected").isNotNull(), "rejected")
        .when(F.col("in0").isNull(), "added")
        .when(F.col("h0") == F.col("h1"), "metadata_only")
        .otherwise("changed")
    )
    return old.join(new, key, "full_outer").select(key, change.alias("change"))


def removed(stored: DataFrame, scanned: DataFrame, key: str = "path") -> DataFrame:
    return stored.join(scanned.select(key), key, "left_anti")


def is_stale(stored: DataFrame, scanned: DataFrame, key: str, facts: Sequence[str]) -> DataFrame:
    """One row: stale if a key is on one side only or a fact differs."""
    a = stored.select(key, *[F.col(f).alias(f"{f}_0") for f in facts], F.lit(True).alias("in0"))
    b = scanned.select(key, *[F.col(f).alias(f"{f}_1") for f in facts], F.lit(True).alias("in1"))
    differs = reduce(or_, [~F.col(f"{f}_0").eqNullSafe(F.col(f"{f}_1")) for f in facts], F.col("in0").isNull() | F.col("in1").isNull())
    return a.join(b, key, "full_outer").agg(F.coalesce(F.bool_or(differs), F.lit(False)).alias("stale"), F.count_if(differs).alias("differences"))


def without_coverage(files: DataFrame, coverage: DataFrame, generation: int) -> DataFrame:
    """Files without a coverage row of this generation for their content."""
    current = coverage.where(F.col("schema_version") == generation).select("file_id", "content_hash")
    return files.join(current, ["file_id", "content_hash"], "left_anti")


def incompatibility(model: Column, width: Column, schema: Column, storage: Column, *, want: tuple[str, int, int, str]) -> Column:
    """Why rows can't be used with this configuration, reasons joined by ``; ``; empty if they can."""
    checks = zip(("model", "vector dimension", "schema version", "vector storage"), (model, width, schema, storage), want)
    return F.concat_ws("; ", *[F.when(~c.eqNullSafe(F.lit(w)), F.concat(F.lit(f"{name} "), F.coalesce(c.cast("string"), F.lit("missing")), F.lit(f" is not {w}"))) for name, c, w in checks])


def genuine_error(has_errors: Column, error: Column) -> Column:
    return has_errors & ~F.startswith(F.coalesce(error, F.lit("")), F.lit("rejected:"))


def skip_report(skipped: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """reason, skipped files and the first paths of each reason, joined by spaces.

    The sample is cut before it is collected, so no task holds a reason's whole list.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("reason").orderBy("path")
    first = skipped.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).groupBy("reason").agg(F.array_join(F.array_sort(F.collect_list("path")), " ").alias("sample"))
    return skipped.groupBy("reason").agg(F.count(F.lit(1)).alias("files")).join(first, "reason")


def run_report(outcomes: DataFrame) -> DataFrame:
    """One row of totals from rows with outcome, chunks and duration_ms."""
    kinds = ("indexed", "unchanged", "skipped", "failed")
    counts = [F.count_if(F.col("outcome") == k).alias(k) for k in kinds]
    total = outcomes.agg(*counts, F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"))
    return total.withColumn("chunks_per_second", F.try_divide(F.col("chunks").cast("double") * 1000, F.col("duration_ms").cast("double")))


def derived_state(files: DataFrame, run_errors: int = 0) -> DataFrame:
    """One row: ``partial`` with an error of this run or a genuine stored one, else ``ready``."""
    bad = F.coalesce(F.bool_or(genuine_error(F.col("has_errors"), F.col("error"))), F.lit(False)) | F.lit(run_errors > 0)
    return files.agg(F.when(bad, "partial").otherwise("ready").alias("state"))


def coverage_gaps(files: DataFrame, supported: Sequence[str], sample: int = 10) -> DataFrame:
    """language, files and a sample line of the languages without structural facts."""
    from pyspark.sql import Window

    rest = files.where(~F.col("language").isin(list(supported)))
    order = Window.partitionBy("language").orderBy("path")
    first = rest.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample)
    counted = rest.groupBy("language").agg(F.count(F.lit(1)).alias("files"))
    names = first.groupBy("language").agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("names"))
    more = F.when(F.col("files") > sample, F.concat(F.lit(" and "), (F.col("files") - sample).cast("string"), F.lit(" more"))).otherwise("")
    return counted.join(names, "language").select("language", "files", F.concat("names", more).alias("sample"))
