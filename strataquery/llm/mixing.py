"""Mixing sources to target weights by weighted fair queueing (operator 3).

Documents of a source queue in a fixed shuffled order, once per repeat. Each
gets a virtual finish time: the source's words up to and with it, divided by
the source's target. All are range-sorted by finish time and the sequence is
cut where its words would pass the budget.

The shuffle key comes from id and text, so neither a source nor an id that
many rows share lies in one range of it. Prefix sums are taken over ranges of
the key within a source and then inside each range, so a source with a third
of all rows is spread like the others. Only built-in expressions are used.

Defined results: a null text has size 0 and the key of an empty one; documents
of size 0 are never taken; a null source is a source, last in order; rows that
agree in id, source and text are interchangeable: the mixture holds as many of
them as all together are taken. An empty table gives no rows. A second run gives the
same result. Other columns are never read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquery.llm.common import col, cut_lineage, field, packed, unpacked, word_count

#: Rows of a range of shuffle keys, and of a range of finish times.
RANGE_ROWS, FINISH_ROWS = 2048, 1 << 20
KEY_BITS = 60


def shuffle_key(doc_id: Column, text: Column, seed: str) -> Column:
    """60 bits of the MD5 of seed, id and the text's MD5."""
    named = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], budget_share: float, repeats: int) -> DataFrame:
    """Target words of each source by water filling.

    ``sizes`` has source and source_size. Weights repeat over the sources by
    code point, null last. A target stops at ``repeats`` times the source's
    size; what it would get beyond that is shared by weight among the others.
    One row a source is ordered here, whatever the number of documents.
    """
    everything = Window.partitionBy()
    before = Window.orderBy("full_at", "pos").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("pos", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    ranked = ranked.withColumn("weight", F.array(*map(F.lit, weights))[((F.col("pos") - 1) % len(weights)).cast("int")].cast("double"))
    ranked = ranked.withColumn("cap", (F.col("source_size") * repeats).cast("double")).withColumn("full_at", F.col("cap") / F.col("weight"))
    left = (F.lit(float(budget_share)) * F.sum("source_size").over(everything).cast("double")) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = ranked.withColumn("level", level)
    final = F.min_by("level", F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "pos"))).over(everything)
    return levels.withColumn("final", final).select("source", "source_size", "pos", F.when(F.col("full_at") < F.col("final"), F.col("cap")).otherwise(F.coalesce(F.col("weight") * F.col("final"), F.col("cap"))).alias("target"))


def mix(
    df: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: Sequence[int] = (3, 1, 2), budget_share: float = 1.5, repeats: int = 2, seed: str = "mix"
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken words and shuffle key (h) of every row of ``df``."""
    slim = cut_lineage(df.select(col(doc_id).alias("doc_id"), col(source).alias("source"), word_count(col(text)).alias("size"), shuffle_key(col(doc_id), col(text), seed).alias("h")))
    rows, total = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    bits = max(0, math.ceil(math.log2(max(1, rows) / RANGE_ROWS)))
    slim = slim.withColumn("part", F.shiftright("h", KEY_BITS - bits))
    parts = slim.groupBy("source", "part").agg(F.sum("size").alias("words"))
    sizes = parts.groupBy("source").agg(F.sum("words").alias("source_size"))
    aims = targets(sizes, weights, budget_share, repeats)
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), ahead.alias("ahead"))
    aims = aims.withColumnRenamed("source", "a")
    starts = starts.join(aims, F.col("s").eqNullSafe(F.col("a"))).drop("a")
    inside = F.sum("size").over(Window.partitionBy("source", "part").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0))
    queued = slim.withColumn("inside", inside).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    queued = cut_lineage(queued.select("doc_id", "source", "size", "h", "source_size", "target", "pos", (F.col("ahead") + F.col("inside")).alias("words")))

    def finish(repeat) -> Column:
        return (F.col("words") + repeat * F.col("source_size")).cast("double") / F.nullif("target", F.lit(0.0))

    items = queued.where("size > 0").select("pos", "h", "size", F.explode(F.array(*[finish(F.lit(i)) for i in range(repeats)])).alias("finish")).where("finish is not null")
    first_out = _first_beyond(items, budget_share * total, rows * repeats)
    copies = F.lit(0)
    for i in range(repeats):
        taken = finish(F.lit(i)).isNotNull() & (F.col("size") > 0)
        if first_out:
            taken &= F.struct(finish(F.lit(i)).alias("finish"), "pos", "h") < F.struct(*[F.lit(first_out[k]).alias(k) for k in ("finish", "pos", "h")])
        copies = copies + taken.cast("int")
    return queued.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "h")


def _first_beyond(items: DataFrame, budget: float, rows: int):
    """Key of the first item in order of finish time with which the words pass the budget, or None.

    The items are range-partitioned by finish time. One sum a partition comes
    to the driver, and only the partition in which the budget ends is ordered
    as a whole, in one task.
    """
    key = ("finish", "pos", "h")
    setting = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(setting, math.ceil(rows / FINISH_ROWS))
    ordered = cut_lineage(items.repartitionByRange(parts, *key).sortWithinPartitions(*key).withColumn("range", F.spark_partition_id()))
    so_far = 0
    for part, words in sorted(ordered.groupBy("range").agg(F.sum("size")).collect()):
        if so_far + words > budget:
            running = F.sum("size").over(Window.partitionBy("range").orderBy(*key).rangeBetween(Window.unboundedPreceding, 0))
            beyond = ordered.where(F.col("range") == part).withColumn("running", running + so_far).where(F.col("running") > budget)
            return beyond.agg(F.min(F.struct(*key)).alias("k")).first()["k"]
        so_far += words
    return None


def mixed_documents(df: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: str = "mix", **options) -> DataFrame:
    """The mixture itself: each row of ``df`` as often as the mix takes it, with the columns of ``df``."""
    key = ["doc_id", "source", "h"]
    plan = mix(df, text=text, doc_id=doc_id, source=source, seed=seed, **options).groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").cast("int").alias("copies"))
    plan = cut_lineage(plan.where("copies > 0"))
    rows = packed(df).select("row", field(doc_id).alias("id"), field(source).alias("from"), shuffle_key(field(doc_id), field(text), seed).alias("k"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & F.col("from").eqNullSafe(F.col("source")) & (F.col("k") == F.col("h"))

    def copied(rows: DataFrame, plan: DataFrame) -> DataFrame:
        return rows.join(plan, same).select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))

    taken = copied(rows, plan.where("rows = 1"))
    repeated = plan.where("rows > 1")
    if not repeated.isEmpty():
        taken = taken.unionByName(copied(rows.join(repeated, same, "left_semi").dropDuplicates(["id", "from", "k"]), repeated))
    return taken.select(*unpacked(df.columns))
