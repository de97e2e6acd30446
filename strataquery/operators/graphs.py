"""Graph, scope and interval operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquery.shared import cut_lineage


#: Hops after which the nodes seen are written as one table.
FOLD = 8


def reach(starts: DataFrame, edges: DataFrame, hops: int | None = None) -> DataFrame:
    """start, node and the fewest hops from each start along edges (src, dst); ``hops`` at most, or as many as there are.

    One join a hop; a node is followed only from the hop that first found it,
    so cycles end. ``starts`` has start (and, if it differs, node). What was
    seen is written anew once its plan has gathered ``FOLD`` hops.
    """
    frontier = starts.select("start", (F.col("node") if "node" in starts.columns else F.col("start")).alias("node")).distinct()
    seen, hop = frontier.withColumn("hops", F.lit(0)), 0
    while hops is None or hop < hops:
        hop += 1
        found = frontier.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        frontier = cut_lineage(found.join(seen, ["start", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("hops", F.lit(hop)))
        if hop % FOLD == 0:
            seen = cut_lineage(seen)
    return seen.where("hops > 0")


def closure(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """All nodes below each start, however deep."""
    return reach(starts, edges)


def nearest_scope(uses: DataFrame, declarations: DataFrame) -> DataFrame:
    """The innermost visible declaration of each use.

    ``uses``: use_id, file, name, scope (dotted); ``declarations``: file, name,
    scope, declaration_id. A declaration is visible if its scope is a prefix of
    the use's. Prefixes are exploded, so the match is an equi-join and not a
    search by prefix.
    """
    parts = F.split("scope", r"\.")
    levels = F.sequence(F.lit(0), F.when(F.col("scope") == "", 0).otherwise(F.size(parts)))
    ups = uses.select("use_id", "file", "name", F.explode(F.transform(levels, lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), ".").alias("scope")))).alias("up"))
    ups = ups.select("use_id", "file", "name", "up.depth", "up.scope")
    return ups.join(declarations, ["file", "name", "scope"]).groupBy("use_id").agg(F.max_by("declaration_id", F.struct("depth", "declaration_id")).alias("declaration_id"), F.max("depth").alias("depth"))


def innermost(points: DataFrame, intervals: DataFrame, group: str) -> DataFrame:
    """The shortest interval [start, end] of the group around each point (point_id, at)."""
    around = points.join(intervals, group).where((F.col("start") <= F.col("at")) & (F.col("at") <= F.col("end")))
    return around.groupBy("point_id").agg(F.min_by("interval_id", F.struct(F.col("end") - F.col("start"), F.col("interval_id"))).alias("interval_id"), F.count(F.lit(1)).alias("depth"))


def gaps(intervals: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Uncovered stretches between a group's intervals, from the end before to the next start."""
    order = Window.partitionBy(group).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return intervals.withColumn("gap_start", before).where(F.col(start) > F.col("gap_start")).select(group, "gap_start", F.col(start).alias("gap_end")).distinct()


def overlapping_roots(roots: DataFrame) -> DataFrame:
    """Pairs a < b of (id, root) that are the same folder or one inside the other, and how.

    Every folder above a root is exploded and matched by equality, so the cost
    is the depth of the paths and not the number of pairs.
    """
    parts = F.split("root", "/")
    ups = roots.select(F.col("id").alias("inner"), F.col("root").alias("inner_root"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("root"))
    pairs = ups.join(roots.withColumnRenamed("id", "outer"), "root").where((F.col("inner") != F.col("outer")) & ((F.col("root") != F.col("inner_root")) | (F.col("inner") < F.col("outer"))))
    how = F.when(F.col("root") == F.col("inner_root"), "same").when(F.col("outer") < F.col("inner"), "contains").otherwise("nested")
    return pairs.select(F.least("inner", "outer").alias("a"), F.greatest("inner", "outer").alias("b"), how.alias("relation"))


def siblings(rows: DataFrame, common: str, own: str, key: str) -> DataFrame:
    """Pairs a < b that share ``common`` and differ in ``own``."""
    a = rows.select(F.col(common).alias("common"), F.col(own).alias("own_a"), F.col(key).alias("a"))
    b = rows.select(F.col(common).alias("common"), F.col(own).alias("own_b"), F.col(key).alias("b"))
    return a.join(b, "common").where((F.col("a") < F.col("b")) & (F.col("own_a") != F.col("own_b"))).select("common", "a", "b")


def active(slots: DataFrame, pointers: DataFrame) -> DataFrame:
    """``slots`` with active: whether the project's pointer names the slot."""
    named = pointers.select("project_id", F.col("slot_id").alias("_active"), "activation_epoch")
    return slots.join(named, "project_id", "left").withColumn("active", F.coalesce(F.col("slot_id") == F.col("_active"), F.lit(False))).drop("_active")


def prefix_of(scope: Column, inner: Column) -> Column:
    """Whether ``inner`` is ``scope`` or lies in it."""
    return (scope == "") | (inner == scope) | F.startswith(inner, F.concat(scope, F.lit(".")))
