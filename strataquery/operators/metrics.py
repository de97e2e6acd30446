"""Measures of runs and of retrieval quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquery.functions.scalars import gate
from strataquery.functions.vectors import cosine
from strataquery.operators.ranges import ahead


def duration_summary(samples: DataFrame, group: str, duration: str, order: str) -> DataFrame:
    """count, total, min, median, nearest-rank p95, max and the means of the first and last tenth in order.

    Order statistics come from positions over ranges, so a group with most of
    the samples is spread like any other.
    """
    rows = samples.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(duration).alias("d"))
    whole = rows.groupBy("g").agg(F.count(F.lit(1)).alias("count"), F.sum("d").alias("total"), F.min("d").alias("least"), F.max("d").alias("most")).withColumnRenamed("g", "k")
    same = F.col("g").eqNullSafe(F.col("k"))
    tenth = F.greatest(F.lit(1), F.floor(F.col("count") / 10))
    placed = ahead(rows, "g", ["o"]).join(whole.select("k", "count"), same)
    ends = placed.groupBy("g").agg(F.avg(F.when(F.col("ahead") < tenth, F.col("d"))).alias("first"), F.avg(F.when(F.col("ahead") >= F.col("count") - tenth, F.col("d"))).alias("last"))
    # equal durations are one row with a count
    values = ahead(rows.where("d is not null").groupBy("g", "d").agg(F.count(F.lit(1)).alias("n")), "g", ["d"], weight="n")
    known = values.groupBy("g").agg(F.sum("n").alias("known")).withColumnRenamed("g", "k")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("ahead") <= rank) & (rank < F.col("ahead") + F.col("n")), F.col("d")))

    n = F.col("known")
    ranks = values.join(known, same).groupBy("g").agg(at(F.floor((n - 1) / 2)).alias("low"), at(F.floor(n / 2)).alias("high"), at(F.expr("div(95 * known + 99, 100L)") - 1).alias("p95"))
    out = whole.join(ends, same, "left").drop("g").join(ranks, same, "left").drop("g")
    figures = {"total_ms": F.col("total"), "min_ms": F.col("least"), "median_ms": (F.col("low") + F.col("high")) / 2, "p95_ms": F.col("p95"), "max_ms": F.col("most"), "first_decile_mean_ms": F.col("first"), "last_decile_mean_ms": F.col("last")}
    return out.select(F.col("k").alias(group), "count", *[F.round(v, 3).alias(name) for name, v in figures.items()])


def recall(found: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """One row: share of the relevant (query, key) pairs, ``k`` a query, among the found."""
    hits = found.join(relevant, ["query", "key"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    asked = relevant.agg(F.count_distinct("query").alias("queries"))
    return hits.join(asked).select((F.col("hits") / (F.col("queries") * k)).alias("recall"))


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """One row: mean share of common keys in two top-k lists (query, key)."""
    return recall(a, b, k).withColumnRenamed("recall", "overlap")


def rank_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """query and Kendall tau-b of two rankings (query, key, rank from 1); a missing key ties behind the last rank.

    Pairs are formed inside a query's top-k lists, so they are bounded by k squared.
    """
    last = a.groupBy("query").agg(F.max("rank").alias("na")).join(b.groupBy("query").agg(F.max("rank").alias("nb")), "query").select("query", (F.greatest("na", "nb") + 1).alias("beyond"))
    both = a.select("query", "key", F.col("rank").alias("ra")).join(b.select("query", "key", F.col("rank").alias("rb")), ["query", "key"], "full_outer").join(last, "query")
    both = both.select("query", "key", F.coalesce("ra", "beyond").alias("ra"), F.coalesce("rb", "beyond").alias("rb"))
    other = both.select("query", F.col("key").alias("key2"), F.col("ra").alias("ra2"), F.col("rb").alias("rb2"))
    pairs = both.join(other, "query").where("key < key2").select("query", F.signum(F.col("ra") - F.col("ra2")).alias("x"), F.signum(F.col("rb") - F.col("rb2")).alias("y"))
    n = pairs.groupBy("query").agg(
        F.count_if((F.col("x") != 0) & (F.col("x") == F.col("y"))).alias("c"),
        F.count_if((F.col("x") != 0) & (F.col("x") == -F.col("y"))).alias("d"),
        F.count_if((F.col("x") == 0) & (F.col("y") != 0)).alias("tx"),
        F.count_if((F.col("y") == 0) & (F.col("x") != 0)).alias("ty"),
    )
    base = F.sqrt(((F.col("c") + F.col("d") + F.col("tx")) * (F.col("c") + F.col("d") + F.col("ty"))).cast("double"))
    tau = F.when(base == 0, 1.0).otherwise(F.try_divide(F.col("c") - F.col("d"), base))
    return last.select("query").join(n, "query", "left").select("query", F.coalesce(tau, F.lit(1.0)).alias("tau"))


def row_cosines(a: DataFrame, b: DataFrame, key: str, vector: str) -> DataFrame:
    return a.select(key, F.col(vector).alias("_a")).join(b.select(key, F.col(vector).alias("_b")), key).select(key, cosine(F.col("_a"), F.col("_b")).alias("cosine"))


def telemetry(rows: DataFrame, group: str, order: str, *, sums: Sequence[str] = (), maxima: Sequence[str] = (), firsts: Sequence[str] = (), lasts: Sequence[str] = ()) -> DataFrame:
    """Sums, maxima, and the first and last values that aren't null, by order."""
    return rows.groupBy(group).agg(
        *[F.sum(c).alias(f"sum_{c}") for c in sums],
        *[F.max(c).alias(f"max_{c}") for c in maxima],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"first_{c}") for c in firsts],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"last_{c}") for c in lasts],
    )


def ordered_digest(rows: DataFrame, group: str, value: str) -> DataFrame:
    """SHA-256 of a group's values whatever their order.

    Values are folded to their own digests. The sorted digests that share four
    hexadecimal digits are joined by NUL and digested, and so are the results
    by their first two digits and then all. So a task gathers a 65,536th of a
    group, or 256 digests.
    """
    digests = rows.select(F.col(group).alias("g"), F.sha2(F.col(value).cast("binary"), 256).alias("d"))
    for digits in (4, 2, 0):
        named = digests.withColumn("range", F.substring("d", 1, 4) if digits == 4 else F.substring("range", 1, digits))
        place = F.struct("d") if digits == 4 else F.struct("at", "d")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["d"]), "\0")
        digests = named.groupBy("g", "range").agg(F.sha2(joined.cast("binary"), 256).alias("d")).withColumn("at", F.col("range"))
    return digests.select(F.col("g").alias(group), F.col("d").alias("digest"))


def adoption(metrics: DataFrame, floors: dict[str, float]) -> DataFrame:
    """``metrics`` with a pass flag for each floor and for all together; a missing metric fails."""
    flags = {f"{m}_ok": gate(F.col(m), f) for m, f in floors.items()}
    out = metrics.withColumns(flags)
    everything: Column = F.lit(True)
    for flag in flags:
        everything = everything & F.col(flag)
    return out.withColumn("adopted", everything)


def breach_seconds(samples: DataFrame, group: str, at: str, value: str, ceiling: float) -> DataFrame:
    """Seconds that a group's value spent over the ceiling (a sample counts until the next), its peak and its growth."""
    order = Window.partitionBy(group).orderBy(at)
    span = F.coalesce(F.lead(at).over(order) - F.col(at), F.lit(0))
    return samples.withColumn("_span", span).groupBy(group).agg(
        F.sum(F.when(F.col(value) > ceiling, F.col("_span")).otherwise(0)).alias("breach"),
        F.max(value).alias("peak"),
        (F.max_by(value, at) - F.min_by(value, at)).alias("growth"),
    )


def best_batch(rates: Sequence[tuple[int, float]], gain: float = 0.05) -> int:
    """Batch size at which the next one gains no more than ``gain``."""
    ordered = sorted(rates)
    for (size, rate), (_, more) in zip(ordered, ordered[1:]):
        if more <= rate * (1 + gain):
            return size
    return ordered[-1][0]
