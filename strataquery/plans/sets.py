"""Queries of set operations and of generated corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataquery.operators import metrics, retrieval
from strataquery.plans.base import Tables, query
from strataquery.sources import synthetic


@query("SELECT o_orderkey AS id, 'orders' AS origin FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer")
def union_all(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), F.lit("orders").alias("origin")).unionByName(t.customer.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("origin")))


@query("SELECT event_type, user_id, min(event_id) AS first_id FROM events GROUP BY ALL")
def distinct_first(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", "user_id").agg(F.min("event_id").alias("first_id"))


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def set_difference(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id")).subtract(t.orders.where("o_totalprice > 300000").select("o_custkey"))


@query("SELECT count(*) AS common FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders)")
def intersection_size(t: Tables) -> DataFrame:
    return t.customer.where("c_acctbal > 0").select("c_custkey").intersect(t.orders.select("o_custkey")).agg(F.count(F.lit(1)).alias("common"))


@query("SELECT NOT EXISTS ((SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders) UNION ALL (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS equal")
def set_equality(t: Tables) -> DataFrame:
    a, b = t.lineitem.select(F.col("l_orderkey").alias("id")).distinct().withColumn("a", F.lit(1)), t.orders.select(F.col("o_orderkey").alias("id")).distinct().withColumn("b", F.lit(1))
    return a.join(b, "id", "full_outer").agg((F.count_if(F.col("a").isNull() | F.col("b").isNull()) == 0).alias("equal"))


@query("SELECT user_id, count(DISTINCT event_type) >= 2 AS across FROM events GROUP BY user_id")
def distinct_check(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg((F.count_distinct("event_type") >= 2).alias("across"))


@query("""
SELECT vec_id, i, CAST(x AS DOUBLE) AS x, CAST(embedding[(i % 64) + 1] AS DOUBLE) * 2 AS y
FROM (SELECT vec_id, embedding, unnest(embedding) AS x, unnest(range(0, 64)) AS i FROM embeddings)""")
def positional_zip(t: Tables) -> DataFrame:
    twice = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 2)
    zipped = F.arrays_zip(F.col("embedding").cast("array<double>").alias("x"), twice.alias("y"))
    rows = t.embeddings.select("vec_id", F.posexplode(zipped).alias("i", "z"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), "z.x", "z.y")


@query()
def judged_retrieval(t: Tables) -> DataFrame:
    """Recall of keyword search over the generated judged corpus."""
    passages, asked = synthetic.judged_corpus(t.spark, 240)
    parts = []
    for i, topic in enumerate(synthetic.TOPICS):
        scores = retrieval.bm25(passages.withColumn("terms", F.concat_ws(" ", "content", "topic")), "chunk_id", "terms", [topic])
        parts.append(retrieval.ranked(scores, 8).select(F.lit(i).cast("long").alias("query"), "key"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("query").orderBy("key")
    relevant = passages.join(asked, "topic").select("query", F.col("chunk_id").alias("key")).withColumn("n", F.row_number().over(order)).where("n <= 8").drop("n")
    return metrics.recall(found, relevant, 8)
