"""Storage statistics and maintenance figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fragment_stats(fragments: DataFrame, table: str = "table") -> DataFrame:
    """Rows, bytes, fragments and the distribution of fragment lengths of each table; ``fragments`` has rows and bytes."""
    spread = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}
    return fragments.groupBy(table).agg(
        F.sum("rows").alias("rows"),
        F.sum("bytes").alias("bytes"),
        F.count(F.lit(1)).alias("fragments"),
        F.min("rows").alias("min_rows"),
        F.max("rows").alias("max_rows"),
        F.round(F.avg("rows"), 6).alias("mean_rows"),
        *[F.round(F.percentile("rows", F.lit(p)), 6).alias(name) for name, p in spread.items()],
    )


def reclaimable(stats: DataFrame) -> DataFrame:
    """One row: bytes that compaction may give back, no table counting below zero."""
    return stats.agg(F.coalesce(F.sum(F.greatest(F.lit(0), F.col("physical_bytes") - F.col("logical_bytes"))), F.lit(0)).alias("reclaimable"))


def maintenance_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """name, versions removed and bytes reclaimed of each table."""
    a = before.select("name", F.col("versions").alias("v0"), F.col("bytes").alias("b0"))
    b = after.select("name", F.col("versions").alias("v1"), F.col("bytes").alias("b1"))
    return a.join(b, "name").select("name", F.greatest(F.lit(0), F.col("v0") - F.col("v1")).alias("versions_removed"), (F.col("b0") - F.col("b1")).alias("bytes_reclaimed"))
