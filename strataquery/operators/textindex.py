"""A text index in Parquet: postings sorted by term, and statistics by facet.

Postings have one row a distinct term of a chunk: term, key, tf, the length of
the text in terms, and the chunk's facets (columns that searches filter by).
They are range-partitioned and sorted by term, so the term predicate of a
query reaches the scan and its row groups' minima and maxima, and a search
reads its own terms whatever the corpus. Statistics are one row for each
combination of facets: chunks and the sum of their lengths.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.operators.retrieval import K1, B, postings, terms_of

#: Bytes of a row group of postings: what the search of one term reads at least.
GROUP_BYTES = 4 << 20


class TextIndex:
    """The index below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, chunks: DataFrame, path: str, *, key: str, text: str, facets: Sequence[str] = ()) -> TextIndex:
        """Write the index of ``chunks`` to a new folder."""
        own = cls(chunks.sparkSession, path)
        rows = postings(chunks, key, text, facets)
        rows.repartitionByRange("term", "key").sortWithinPartitions("term", "key").write.option("parquet.block.size", GROUP_BYTES).parquet(f"{own.path}/postings")
        length = F.size(terms_of(F.coalesce(F.col(text), F.lit("")))).cast("long")
        chunks.select(*facets, length.alias("length")).groupBy(*facets).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total")).write.parquet(f"{own.path}/stats")
        return own

    def postings(self, terms: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/postings")
        if terms is not None:
            rows = rows.where(F.col("term").isin(list(terms)))
        return rows if where is None else rows.where(where)

    def stats(self, where: Column | None = None) -> tuple[int, float]:
        """Chunks, and their mean length; of those that ``where``, a condition on facets, lets through."""
        rows = self.spark.read.parquet(f"{self.path}/stats")
        n, total = (rows if where is None else rows.where(where)).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
        return n, total / n if n else 0.0

    def bm25(self, query: Sequence[str], where: Column | None = None, *, k1: float = K1, b: float = B) -> DataFrame:
        """key, score and the facets of the chunks with any of the query's terms; ``retrieval.bm25`` from the index.

        ``where`` applies before anything is counted. One row a term reaches the driver.
        """
        hits = self.postings(query, where)
        return scored(hits, *self.stats(where), [c for c in hits.columns if c not in ("term", "tf", "length")], k1=k1, b=b)


def scored(hits: DataFrame, n: int, mean: float, key: Sequence[str], *, k1: float = K1, b: float = B) -> DataFrame:
    """``key`` and the BM25 score of postings ``hits`` (term, tf, length), in a corpus of ``n`` chunks of ``mean`` length."""
    weights = {r["term"]: math.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5)) for r in hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}  # a row a term of the query
    if not weights:
        return hits.select(*key, F.lit(0.0).alias("score")).limit(0)
    idf = F.coalesce(*[F.when(F.col("term") == t, F.lit(w)) for t, w in weights.items()])
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(mean)))
    return hits.groupBy(*key).agg(F.sum(part).alias("score"))
