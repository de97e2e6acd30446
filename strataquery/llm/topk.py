"""Exact top-k search by block-at-a-time pruning (operator 10).

Vectors are integers by component (floor of ``scale`` times the value). Rows
are put in an order in which neighbours are alike, and cut into blocks of
``BLOCK`` rows; a block keeps a forward index (its matrix) and the largest and
smallest value of each component. For a query, the sum over components of the
larger product with either extreme bounds every score in the block. Blocks are
scored in falling order of that bound until it is below the k-th score found.

Blocks travel in groups, and groups have bounds of their own: a query is sent
only to groups whose bound reaches its floor, a score that its k-th best row
has in any case. Floors come from a bounded set of blocks first, then from a
first round in which each query meets the one group with the highest bound;
the other groups that still reach the floor follow in a second round. A task
gets one group and one chunk of the queries sent there at a time, so its memory
doesn't grow with either table, and returns k rows a query. The bounds that
workers hold are those of ``BOUNDS`` runs of groups at most.

Ties go to the smaller id; a block whose bound equals the k-th score is still
scored. Vectors that are null or hold a null or non-finite component take no
part. Shorter vectors count as padded with zeros. Rows with a null id take no
part. An id that repeats is two candidates; as a query it is asked once, with
its smallest vector, and meets no row of its own id. Where doubles could be
inexact, scores are whole Python numbers; one beyond a long is ranked exactly
and given as the nearest long. Other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquery.llm.common import arrow_udf, col, cut_lineage, prepare_workers

BLOCK = 256
#: Blocks of a group, and queries of a chunk.
GROUP, CHUNK = 64, 8192
#: Components whose signs order the rows.
SIGNS = 16
#: Blocks that give the first floors, and most runs of groups that have bounds.
FLOOR_BLOCKS, BOUNDS = 16, 4096
#: Whole numbers below this are exact as doubles.
EXACT = 2**53

#: ``place`` orders scores that a long can't hold.
RESULT = "query_id long, vec_id long, score long, place string"


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def whole(vector: Column, scale: int) -> Column:
    """Floor of ``scale`` times each component, as doubles: a long can't hold those of large vectors."""
    most = float(np.finfo(np.float64).max)

    def one(x: Column) -> Column:
        big = F.least(F.greatest(x.cast("double") * scale, F.lit(-most)), F.lit(most))
        return F.when(F.abs(big) < EXACT, F.floor(big).cast("double")).otherwise(big)  # doubles from there on are whole

    return F.transform(vector, one)


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _exact(matrix: np.ndarray) -> np.ndarray:
    """The same whole numbers as Python's."""
    return np.array([[int(x) for x in row] for row in matrix], dtype=object).reshape(matrix.shape)


def _large(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> bool:
    """Whether some score or bound may not be exact as a double."""
    with np.errstate(over="ignore"):
        return bool(np.abs(queries).sum(axis=1).max(initial=0) * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) >= EXACT)


def upper_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query and each pair of extremes, a score that no row between the extremes passes."""
    if _large(queries, low, high):
        queries, low, high = map(_exact, (queries, low, high))
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def search(queries: np.ndarray, query_ids: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int, floors: np.ndarray) -> tuple[list[tuple[int, int, int]], int]:
    """Best k rows of ``blocks`` (ids, matrix) for each query, and the blocks scored, summed over queries.

    ``floors``: scores that the query's k-th best row reaches in any case.
    """
    low = np.array([m.min(axis=0) for _, m in blocks])
    high = np.array([m.max(axis=0) for _, m in blocks])
    bounds = upper_bounds(queries, low, high)
    kth = floors.astype(float)
    if _large(queries, low, high):
        queries, blocks, kth = _exact(queries), [(ids, _exact(m)) for ids, m in blocks], kth.astype(object)
    order = np.argsort(-bounds, axis=1, kind="stable")
    best: list[list[tuple[int, int]]] = [[] for _ in query_ids]  # (-score, id), sorted
    scored, alive = 0, np.arange(len(query_ids))
    for place in range(len(blocks)):
        alive = alive[(bounds[alive, order[alive, place]] >= kth[alive]).astype(bool)]
        if not len(alive):
            break
        scored += len(alive)
        at = order[alive, place]
        for b in np.unique(at):
            own = alive[at == b]
            ids, matrix = blocks[b]
            scores = queries[own] @ matrix.T
            reach = (scores >= kth[own, None]).astype(bool) & (ids[None, :] != query_ids[own, None])
            for at_own in np.flatnonzero(reach.any(axis=1)):
                q, row, keep = own[at_own], scores[at_own], np.flatnonzero(reach[at_own])
                if len(keep) > 4 * k:  # the k best and all that tie with the last of them
                    edge = np.sort(row[keep])[len(keep) - k]
                    keep = keep[(row[keep] >= edge).astype(bool)]
                    keep = keep[np.lexsort((ids[keep], -row[keep]))[:k]] if row.dtype != object else keep
                best[q] = sorted([*best[q], *((-int(row[i]), int(ids[i])) for i in keep)])[:k]
                if len(best[q]) == k:
                    kth[q] = max(kth[q], -best[q][-1][0])
    return [(int(query_ids[q]), i, -s) for q, found in enumerate(best) for s, i in found], scored


def _placed(score: int) -> tuple[int, str | None]:
    """The score as a long, and text in the order of those that a long can't hold."""
    top = (1 << 63) - 1
    if -top < score < top:
        return score, None
    digits = str(abs(score))
    text = f"{len(digits):04d}{digits}"
    return (top, "1" + text) if score > 0 else (-top - 1, "0" + "".join(str(9 - int(d)) for d in text))


def _stacked(frame: pd.DataFrame, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Blocks of a group in order."""
    frame = frame.sort_values("place", kind="stable")
    matrix, ids = _matrix(frame["vector"].to_numpy(), width), frame["id"].to_numpy(np.int64)
    return [(ids[i : i + BLOCK], matrix[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]


def _extremes(placed: DataFrame, span: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``span`` groups, in order, with the smallest and largest value of each component: ``BOUNDS`` rows at most."""
    schema = "run int, low array<double>, high array<double>"

    def of_group(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for frame in frames:
            for run, own in frame.groupby(frame["part"] // span):
                matrix = _matrix(own["vector"].to_numpy(), width)
                low, high = found.get(run, (matrix[0], matrix[0]))
                found[run] = np.minimum(low, matrix.min(axis=0)), np.maximum(high, matrix.max(axis=0))
        yield pd.DataFrame([(r, low.tolist(), high.tolist()) for r, (low, high) in found.items()], columns=["run", "low", "high"])

    def of_run(frame: pd.DataFrame) -> pd.DataFrame:
        low, high = (f(np.stack(frame[c].to_numpy()), axis=0).tolist() for c, f in (("low", np.min), ("high", np.max)))
        return pd.DataFrame({"run": frame["run"].iloc[:1].to_numpy(), "low": [low], "high": [high]})

    rows = placed.select("part", "vector").mapInPandas(of_group, schema).groupBy("run").applyInPandas(of_run, schema).collect()
    rows.sort()
    return np.array([r["run"] for r in rows], np.int32), np.array([r["low"] for r in rows]).reshape(-1, width), np.array([r["high"] for r in rows]).reshape(-1, width)


def reaching(vector: Column, floor: Column, extremes: tuple[np.ndarray, np.ndarray, np.ndarray], width: int) -> Column:
    """Runs whose bound reaches the floor, in falling order of it."""
    runs, low, high = extremes

    @arrow_udf("array<int>")
    def found(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for vectors, floors in parts:
            bounds = upper_bounds(_matrix(vectors.to_pylist(), width), low, high)
            order = np.argsort(-bounds, axis=1, kind="stable")
            yield pa.array([[int(runs[r]) for r in own if row[r] >= floor] for own, row, floor in zip(order, bounds, floors.to_pylist())], pa.list_(pa.int32()))

    return found(vector, floor)


def _first_floors(placed: DataFrame, width: int, k: int):
    """A column function of (id, vector): the k-th best score among a bounded set of blocks."""
    rows = placed.where(F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) < BLOCK).orderBy("place").limit(FLOOR_BLOCKS * BLOCK).collect()  # FLOOR_BLOCKS * BLOCK rows at most
    near, near_ids = _matrix([r["vector"] for r in rows], width), np.array([r["id"] for r in rows], np.int64)

    @arrow_udf("double")
    def floors(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, vectors in parts:
            own, asked = ids.to_numpy(zero_copy_only=False), _matrix(vectors.to_pylist(), width)
            if len(near) < k or _large(asked, near, near):
                yield pa.array(np.full(len(own), -np.inf))
                continue
            scores = asked @ near.T
            scores[own[:, None] == near_ids[None, :]] = -np.inf
            yield pa.array(np.sort(scores, axis=1)[:, -k])

    return floors


def _searched(placed: DataFrame, requests: DataFrame, width: int, k: int) -> DataFrame:
    """RESULT of ``requests`` (id, vector, floor, part): each group meets the queries sent there, a chunk at a time."""
    sent = requests.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    blocks = placed.join(sent, "part").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    asked = requests.join(sent, "part").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))

    def scored(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            found, _ = search(_matrix(right["vector"].to_numpy(), width), right["id"].to_numpy(np.int64), _stacked(left, width), k, right["floor"].to_numpy(float))
        rows = [(q, i, *_placed(s)) for q, i, s in found]
        return pd.DataFrame({c: pd.Series([r[n] for r in rows], dtype=t) for n, (c, t) in enumerate((("query_id", "int64"), ("vec_id", "int64"), ("score", "int64"), ("place", "object")))})

    keys = ("part", "chunk")
    return blocks.select("id", "vector", "place", *keys).groupBy(*keys).cogroup(asked.select("id", "vector", "floor", *keys).groupBy(*keys)).applyInPandas(scored, RESULT)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("place").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(df: DataFrame, queries: DataFrame, *, k: int = 5, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best rows of ``df`` for each row of ``queries``."""
    prepare_workers(df.sparkSession)

    def read(source: DataFrame) -> DataFrame:
        return source.select(col(vec_id).cast("long").alias("id"), col(vector).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).select("id", whole(F.col("v"), scale).alias("vector"))

    asked = cut_lineage(read(queries).groupBy("id").agg(F.min("vector").alias("vector")))
    signs = F.aggregate(F.slice("vector", 1, SIGNS), F.lit(0).cast("long"), lambda a, x: a * 2 + (x >= 0).cast("long"))
    rows = read(df).withColumn("sign", signs)
    count, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    width = max(width, asked.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0], 1)
    groups = max(1, math.ceil(count / (GROUP * BLOCK)))
    placed = cut_lineage(rows.repartitionByRange(groups, "sign", "id").sortWithinPartitions("sign", "id").select("id", "vector", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")))
    span = math.ceil(groups / BOUNDS)
    extremes = _extremes(placed, span, width)
    groups_of = F.transform(F.sequence(F.lit(0), F.lit(span - 1)), lambda i: F.col("run") * span + i)  # those without rows get no queries

    def sent(to: DataFrame) -> DataFrame:
        return to.select("id", "vector", "floor", F.explode("runs").alias("run")).select("id", "vector", "floor", F.explode(groups_of).alias("part"))

    asked = asked.withColumn("floor", _first_floors(placed, width, k)("id", "vector")).withColumn("runs", reaching(F.col("vector"), F.col("floor"), extremes, width))
    found = _searched(placed, sent(asked.withColumn("runs", F.slice("runs", 1, 1))), width, k)
    if len(extremes[0]) > 1:
        found = cut_lineage(found)
        last = _ranked(found, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("kth"))
        # the double nearest to a large score may be above it, and the long given for a low one is
        under = F.when(F.abs("kth") < EXACT, F.col("kth")).when(F.col("kth") > 0, F.col("kth") * (1 - 1e-15)).otherwise(F.lit(float("-inf")))
        higher = asked.select("id", "vector", "floor", F.col("runs")[0].alias("first")).join(last.select("id", under.alias("kth")), "id", "left")
        again = higher.select("id", "vector", F.greatest("floor", "kth").alias("floor"), "first")
        rest = F.filter(reaching(F.col("vector"), F.col("floor"), extremes, width), lambda r: r != F.col("first"))
        found = found.unionByName(_searched(placed, sent(again.withColumn("runs", rest)), width, k))
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
