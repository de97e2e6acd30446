"""Sharding by Hilbert-curve order (operator 2).

Several metadata dimensions are quantised to a few bits each; rows are sorted
by their index on the Hilbert curve through that grid and the sequence is cut
into runs. Rows of one run are close in every dimension, so readers prune
files by the minima and maxima of any of them.

Law ``rows``: the runs' row counts differ by one at most. Law ``bytes``: run s
ends with the first row at which the sizes so far reach s/n of all sizes.

Order: curve index, then the tie columns (equal texts with equal metadata are
neighbours), so a crowded cell is spread over tasks like any other range. The
rank is exact: rows are range-partitioned and written once, the driver gets
one row count and size a partition.

Kinds of dimension: ``log`` for numbers, in steps that grow with the value;
``rank`` for names, by their exact place among the distinct ones, however many,
so that a run's minimum and maximum are close and prune; ``hash`` for names whose order doesn't matter.

Defined results: a null in a categorical dimension is a value of its own (by
rank the first), in a numeric one it is the lowest cell; numbers below 0 count as 0. Rows equal in
index and all tie columns are interchangeable. An empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquery.llm.common import arrow_udf, cut_lineage, field, packed, unpacked
from strataquery.shared import unbroadcast

#: Rows that one task sorts.
RANGE_ROWS = 1 << 20
#: Most names that stand in the plan, each the first of its cell. For more cells the names are joined, with the same result.
NAMES = 256


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (n rows, one column a dimension, values below 2**bits).

    Skilling, "Programming the Hilbert curve" (2004), for all rows at once.
    """
    x = [c.astype(np.int64).copy() for c in cells.T]
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where((x[n - 1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x = [v ^ turn for v in x]
    out = np.zeros_like(turn)
    for place in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (v >> place & 1)
    return out


def cell(value: Column, kind: str, bits: int) -> Column:
    """Quantise: ``hash`` spreads categories over the cells, ``log`` takes steps of a factor that grows with the value."""
    top = (1 << bits) - 1
    if kind == "hash":
        return F.pmod(F.xxhash64(value), F.lit(top + 1)).cast("int")
    if kind == "log":
        step = F.floor(F.log2(1 + F.greatest(value.cast("double"), F.lit(0.0))) * (top + 1) / 40)
        return F.coalesce(F.least(step, F.lit(top)), F.lit(0)).cast("int")
    raise ValueError(f"unknown kind of dimension: {kind}")


def in_order(df: DataFrame, order: Sequence[Column], count: int) -> DataFrame:
    """``df`` sorted across its partitions and written once, with ``_row``: the partition, and the row in it in the low 33 bits."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(count / RANGE_ROWS))
    return cut_lineage(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()))


def _by_first_names(name: Column, firsts: Sequence[tuple[bytes | None, int]]) -> Column:
    """The cell of the last of ``firsts`` that ``name`` reaches, by halving them."""
    if len(firsts) == 1:
        return F.lit(firsts[0][1])
    half = len(firsts) // 2
    return F.when(name < F.lit(firsts[half][0]), _by_first_names(name, firsts[:half])).otherwise(_by_first_names(name, firsts[half:]))


def ranked_cells(placed: DataFrame, value: str, bits: int, into: str) -> DataFrame:
    """``placed`` with the cell of the name in ``value`` by its exact rank among all distinct names. Nulls come first, and no name shares their cell."""
    name = F.col(value).cast("string").cast("binary")  # the order of strings, and whole where a string isn't UTF-8
    names = cut_lineage(placed.select(name.alias("_name")).distinct())
    known = names.count()
    names, part = in_order(names, [F.col("_name").asc_nulls_first()], known), F.shiftright("_row", 33).cast("int")
    starts, before, nulls = [], 0, 0
    for p, n, named in sorted(map(tuple, names.groupBy(part).agg(F.count(F.lit(1)), F.count("_name")).collect())):
        starts.append((p, before))
        before, nulls = before + n, nulls + n - named
    rank = F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    cells = names.withColumn("_part", part).join(F.broadcast(placed.sparkSession.createDataFrame(starts, "_part int, _before long")), "_part")  # a row a partition
    cells = cells.select("_name", rank.cast("decimal(18)").alias("_rank"))
    cells = cells.select("_name", F.expr(f"if(_name is null, 0L, greatest(div(_rank * {1 << bits}BD, {max(known, 1)}BD), {nulls}L))").alias(into))
    if min(known, 1 << bits) > NAMES:
        return placed.join(unbroadcast(cells), name.eqNullSafe(F.col("_name"))).drop("_name")
    firsts = sorted((bytes(r[1]), r[0]) for r in cells.where(F.col(into) > 0).groupBy(into).agg(F.min("_name")).collect())
    return placed.withColumn(into, F.when(name.isNull(), 0).otherwise(_by_first_names(name, [(None, 0), *firsts])).cast("long"))


def curve(dimensions: Sequence[Column], bits: int) -> Column:
    """Hilbert index of quantised dimensions, as a long."""
    if len(dimensions) * bits > 62:
        raise ValueError("dimensions times bits must be 62 or less")

    @arrow_udf("long")
    def index(*cells: pa.Array) -> pa.Array:
        return pa.array(hilbert_index(np.stack([c.to_numpy(zero_copy_only=False) for c in cells], axis=1), bits))

    return index(*dimensions)


def hilbert_shards(df: DataFrame, dimensions: Mapping[str, str], *, shards: int = 8, bits: int = 6, ties: Sequence[str] = (), law: str = "rows", size: str | None = None) -> DataFrame:
    """``df`` with curve_index, shard (int) and slot (long, gapless from 0 within a shard).

    ``dimensions`` maps columns to the kind of ``cell``. Law ``bytes`` needs
    the column ``size``.
    """
    if law not in ("rows", "bytes") or (law == "bytes" and size is None):
        raise ValueError("law must be rows, or bytes with a size column")
    names, results = df.columns, ("curve_index", "shard", "slot")
    keys = [field(t).alias(f"tie{i}") for i, t in enumerate(ties)]
    placed, cells = packed(df).select("row", *keys, *[field(c).alias(f"value{i}") for i, c in enumerate(dimensions)]), []
    for i, kind in enumerate(dimensions.values()):
        if kind == "rank":
            placed = ranked_cells(placed, f"value{i}", bits, f"cell{i}")
        cells.append(F.col(f"cell{i}") if kind == "rank" else cell(F.col(f"value{i}"), kind, bits))
    placed = placed.select("row", *[f"tie{i}" for i in range(len(ties))], curve(cells, bits).alias("curve_index"))
    order = [F.col("curve_index"), *[F.col(f"tie{i}").asc_nulls_first() for i in range(len(ties))]]
    spark, placed = df.sparkSession, in_order(placed, order, df.count())
    part, inside = F.shiftright("_row", 33).cast("int"), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    weight = field(size).cast("long") if size else F.lit(0).cast("long")
    found = {r["part"]: (r["n"], r["b"]) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("b")).collect()}
    starts, rows, bytes_ = [], 0, 0
    for p in sorted(found):
        starts.append((p, rows, bytes_))
        rows, bytes_ = rows + found[p][0], bytes_ + (found[p][1] or 0)
    schema = "_p int, _rows_before long, _bytes_before long"
    ranked = placed.withColumn("_part", part).join(F.broadcast(spark.createDataFrame(starts, schema)), F.col("_part") == F.col("_p"))  # a row a partition
    rank = F.col("_rows_before") + inside
    if law == "rows":
        shard = F.expr(f"div(({shards} * (_rows_before + (_row & {(1 << 33) - 1}L))), {max(1, rows)}L)").cast("int")
        ranked = ranked.withColumn("shard", shard)
        slot = rank - F.expr(f"div(shard * {rows}L + {shards - 1}L, {shards}L)")
        return ranked.withColumn("slot", slot.cast("long")).select(*unpacked(names, results), *results)
    ahead = F.sum(weight).over(Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1))
    ranked = ranked.withColumn("_ahead", F.col("_bytes_before") + F.coalesce(ahead, F.lit(0)))
    ranked = cut_lineage(ranked.withColumn("shard", F.least(F.expr(f"div({shards} * _ahead, {max(1, bytes_)}L)"), F.lit(shards - 1)).cast("int")).withColumn("_rank", rank))
    first = ranked.groupBy("shard").agg(F.min("_rank").alias("_first")).withColumnRenamed("shard", "_s")
    ranked = ranked.join(F.broadcast(first), F.col("shard") == F.col("_s"))  # a row a shard
    return ranked.withColumn("slot", F.col("_rank") - F.col("_first")).select(*unpacked(names, results), *results)


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write one folder a shard, in files of bounded size that each hold neighbours in curve order."""
    ordered = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.option("maxRecordsPerFile", int(rows_per_file)).partitionBy("shard").parquet(path)
