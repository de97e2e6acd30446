"""SimHash near-duplicate groups by deletion-variant signatures (operator 6).

A 64-bit fingerprint is cut into ``distance // 2 + 1`` segments. If two
fingerprints differ in at most ``distance`` bits, one of the segments differs
in at most one bit, so the pair shares that segment with one bit struck out.
Every distinct fingerprint is indexed under each such variant, equal variants
meet, and every pair that meets is verified in full.

A variant under which more than ``SMALL`` distinct fingerprints meet isn't
expanded into pairs. Its members take an exact second way (``distance`` 2 or
less): two of them link if and only if some 64-bit value lies within one bit
of both, so each member is indexed under itself and its 64 one-bit neighbours
and tied to the smallest member that it meets there. That is 65 rows a member
however large the group is, and no link between different fingerprints is lost
for the groups, since all members that meet at a value link to each other.

Defined results: null and empty texts, and texts of white space, have the
fingerprint zero and link like any other. Rows with a null id take part; the
group's id is its smallest id that isn't null. Repeated rows stay repeated in
``near_duplicates``. Other columns are never read. An empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquery.llm.common import arrow_udf, bounded_broadcast, col, cut_lineage, field, packed, prepare_workers, unpacked

BITS = 64
#: Most distinct fingerprints under one variant that are compared pair by pair.
SMALL = 4
#: Shingles hashed at once, so that a very long text needs bounded memory.
STRIDE = 100_000


def simhash(text: str | None, words_in: int = 3, seed: int = 42) -> int:
    """Fingerprint of one text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both touch ASCII only
    if not words:
        return 0
    total = max(1, len(words) - words_in + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    digest, space = xxhash.xxh64_intdigest, b" ".join
    for start in range(0, total, STRIDE):
        part = words[start : min(start + STRIDE, total) + words_in - 1]
        runs = [part[i:] for i in range(words_in)]
        hashes = [digest(space(x), seed) for x in zip(*runs)] if len(words) >= words_in else [digest(space(words), seed)]
        octets = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprint(text: Column, words_in: int = 3, seed: int = 42) -> Column:
    """Fingerprint as a signed long with the same bits."""

    @arrow_udf("long")
    def mark(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array(np.array([simhash(x, words_in, seed) for x in part.to_pylist()], dtype=np.uint64).view(np.int64))

    return mark(text)


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _variants(fp: str, distance: int) -> Column:
    """Keys (segment, bit struck out, the segment's other bits) of a fingerprint."""
    segments = distance // 2 + 1
    bounds = [BITS * s // segments for s in range(segments + 1)]
    keys = []
    for low, high in zip(bounds, bounds[1:]):
        segment = ((1 << (high - low)) - 1) << low
        for bit in range(low, high):
            mask = segment & ~(1 << bit)
            signed = mask - (1 << 64) if mask >= 1 << 63 else mask
            keys.append(F.struct(F.lit(bit).cast("byte").alias("bit"), F.col(fp).bitwiseAND(F.lit(signed)).alias("rest")))
    return F.array(*keys)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (variant, key) of a sorted range whose variant occurs twice; and the first and last run, which may go on in the next range."""
    last: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # the row held back, and whether the one before was its like
    first_run: int | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        variant, key = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        like = np.zeros(len(variant), bool)
        if last is not None:
            variant, key, like = (np.concatenate([x, y]) for x, y in zip(last, (variant, key, like)))
        first_run = int(variant[0]) if first_run is None else first_run
        again = variant[1:] == variant[:-1]
        like[1:] |= again
        last = variant[-1:], key[-1:], like[-1:]
        keep = (like[:-1] | again | (variant[:-1] == first_run)).nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(variant[keep]), pa.array(key[keep])], names=["variant", "key"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array(last[0]), pa.array(last[1])], names=["variant", "key"])


def shared(index: DataFrame) -> DataFrame:
    """Rows of ``index`` (variant, key; longs) whose variant occurs twice or more, and few others.

    Rows are range-partitioned by both columns, so a variant that a third of
    all keys have is spread over tasks; equal ones are neighbours then.
    """
    spark = index.sparkSession
    prepare_workers(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = index.repartitionByRange(parts, "variant", "key").sortWithinPartitions("variant", "key")
    return cut_lineage(ranges.mapInArrow(_runs, "variant long, key long"))


def links(distinct: DataFrame, distance: int = 2, fp: str = "fp") -> DataFrame:
    """Edges (a, b), a below b, that join all fingerprints linked by chains of ``distance`` or fewer bits.

    ``distinct`` has each fingerprint once. Every edge is a verified link, and
    the edges leave no two linked fingerprints in different components.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0 to 2")
    spark = distinct.sparkSession
    if distance == 0:
        return spark.createDataFrame([], "a long, b long")
    # each row becomes 64: the number of tasks is set, as rows this narrow would be dealt to few
    distinct = distinct.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), fp)
    members = shared(distinct.select(F.col(fp).alias("key"), F.explode(_variants(fp, distance)).alias("k")).select(F.xxhash64("k.bit", "k.rest").alias("variant"), "key"))
    crowded = cut_lineage(members.groupBy("variant").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SMALL).select("variant"))
    crowd = bounded_broadcast(crowded)
    order = Window.partitionBy("variant").orderBy("key")  # SMALL rows at most
    few = members.join(crowd, "variant", "left_anti").select(F.col("key").alias("b"), *[F.lag("key", i).over(order).alias(f"p{i}") for i in range(1, SMALL)])
    pairs = few.select("b", F.explode(F.array(*[f"p{i}" for i in range(1, SMALL)])).alias("a")).where(F.col("a").isNotNull() & (_apart(F.col("a"), F.col("b")) <= distance)).select("a", "b")
    tied = _ties(members.join(crowd, "variant", "left_semi").select(F.col("key").alias(fp)).distinct(), distance, fp)
    return cut_lineage(pairs.unionByName(tied).distinct())


def _ties(members: DataFrame, distance: int, fp: str) -> DataFrame:
    """Edges from each member of a crowded variant to the smallest member it meets at a value near both."""
    flips = [0] + ([1 << i for i in range(BITS)] if distance > 1 else [])
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in flips]
    near = members.select(fp, F.explode(F.array(*[F.col(fp).bitwiseXOR(F.lit(x).cast("long")) for x in signed])).alias("value"))
    least = near.groupBy("value").agg(F.min(fp).alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("value", "a")
    tied = near.join(least, "value").where(F.col("a") != F.col(fp))
    return tied.where(_apart(F.col("a"), F.col(fp)) <= distance).select("a", F.col(fp).alias("b")).distinct()


#: Edges that one task handles.
EDGES = 1 << 16


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for all nodes of ``edges`` (a, b).

    Alternates large-star and small-star steps (Kiveris et al., 2014) until no
    edge changes. Each step is two aggregations; only a checksum of the edges
    reaches the driver. Few edges are handled by few tasks, whatever the number
    of shuffle partitions, as there are many steps.
    """
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    parts = max(1, math.ceil(edges.count() / EDGES))
    edges = edges.coalesce(parts)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).coalesce(parts).distinct().coalesce(parts)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").coalesce(parts)
        small = star.select(F.col("u").alias("u"), F.col("m").alias("v")).unionByName(star.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u != v").distinct()
        edges = cut_lineage(small.coalesce(parts))
        after = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            nodes = edges.groupBy("u").agg(F.min("v").alias("root"))
            roots = nodes.select("root").distinct()
            return cut_lineage(nodes.select(F.col("u").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root")).coalesce(parts))
        before = after


def _classes(df: DataFrame, text: str, doc_id: str, distance: int, words_in: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, fp) of each row; (fp, root, component_id) of each distinct fingerprint."""
    marked = cut_lineage(df.select(col(doc_id).alias("doc_id"), F.xxhash64(col(text)).alias("text_hash"), fingerprint(col(text), words_in, seed).alias("fp")))
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(classes.select("fp"), distance))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked, rooted.join(names, "root").select("fp", "root", "component_id")


def near_duplicates(df: DataFrame, *, text: str = "text", doc_id: str = "doc_id", distance: int = 2, words_in: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (long) and component_id of every row of ``df``."""
    marked, named = _classes(df, text, doc_id, distance, words_in, seed)
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(df: DataFrame, *, text: str = "text", doc_id: str = "doc_id", distance: int = 2) -> DataFrame:
    """One row of ``df`` for each group: the row with the group's smallest id.

    Ids that are null come last. Rows that share id and text count as one.
    """
    marked, named = _classes(df, text, doc_id, distance, 3, 42)
    return keep_first(df, marked.join(named, "fp").select("doc_id", "text_hash", "root"), text, doc_id)


def keep_first(df: DataFrame, grouped: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Rows of ``df`` less all but the first of each root in ``grouped`` (doc_id, text_hash, root).

    What leaves is found by keys; texts are shuffled only where more rows
    leave than may be broadcast, or where a row that stays is repeated.
    """
    grouped = cut_lineage(grouped)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    groups = grouped.groupBy("root").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "first")
    rows = grouped.join(groups, "root").groupBy("doc_id", "text_hash").agg(F.bool_or(place == F.col("first")).alias("stays"), F.count(F.lit(1)).alias("n"))
    touched = cut_lineage(rows.where("not stays or n > 1"))
    hashed = packed(df).select("row", field(doc_id).alias("id"), F.xxhash64(field(text)).alias("hash"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    kept = hashed.join(bounded_broadcast(touched.select("doc_id", "text_hash")), same, "left_anti")
    repeated = touched.where("stays")
    if not repeated.isEmpty():
        once = hashed.join(bounded_broadcast(repeated.select("doc_id", "text_hash")), same, "left_semi").dropDuplicates(["id", "hash"])
        kept = kept.unionByName(once)
    return kept.select(*unpacked(df.columns))
