"""Exact positions and running sums in groups of any size.

A group isn't one task's work: rows are range-partitioned by group and order
and written once, so a large group spans several partitions. What precedes a
partition in its group comes from a table of one row a group and partition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataquery.shared import cut_lineage

#: Rows of a range.
RANGE_ROWS = 1 << 20


def ahead(rows: DataFrame, group: str, order: Sequence[str], weight: str | None = None, into: str = "ahead") -> DataFrame:
    """``rows`` with the number (or the summed weight) of the rows of their group that come before, in an order without ties."""
    keys = [group, *order]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / RANGE_ROWS))
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # the id counts rows inside a partition in its low 33 bits
    placed = cut_lineage(placed.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33).cast("int"))
    sums = F.count(F.lit(1)) if weight is None else F.sum(weight)
    heads = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), sums.alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    heads = heads.select(F.col(group).alias("_group"), F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    joined = placed.join(heads, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_p")))
    if weight is None:
        inside = F.col("_at") - F.col("_first")
    else:
        inside = F.coalesce(F.sum(weight).over(Window.partitionBy(group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one range
    return joined.select(*rows.columns, (F.col("_before") + inside).alias(into))
