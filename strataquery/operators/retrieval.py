"""Keyword, vector and hybrid retrieval over chunk tables.

A chunk table has chunk_id, project_id, path, language, kind, symbol,
qualified_symbol, start_line, end_line, content and identifier_terms; the
functions ask only for the columns they name.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquery.functions.text import snippet, truncated, without_part
from strataquery.functions.vectors import cosine, dot

#: BM25 constants, and the constant of reciprocal rank fusion.
K1, B, FUSION = 1.2, 0.75, 60


_NOT_TERM = r"[^\p{L}\p{N}]+"


def terms_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), _NOT_TERM), lambda t: t != "")


def postings(chunks: DataFrame, key: str, text: str, facets: Sequence[str] = ()) -> DataFrame:
    """key, term, tf, the length of the text and the facets; one row a distinct term of a chunk (``textindex``)."""
    rows = chunks.select(F.col(key).alias("key"), *facets, terms_of(F.col(text)).alias("terms"))
    counted = rows.select("key", *facets, F.size("terms").alias("length"), F.explode("terms").alias("term"))
    return counted.groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"), *[F.first(c).alias(c) for c in facets])


def _equals(word: str):
    return lambda t: t == word


def bm25(chunks: DataFrame, key: str, text: str, query: Sequence[str], *, k1: float = K1, b: float = B) -> DataFrame:
    """key and score of the chunks with any of the query's terms.

    Terms are counted inside the row, so only matching rows leave the scan;
    corpus size and mean length come from the same pass over the chunks.
    """
    wanted = list(dict.fromkeys(query))
    parts = chunks.select(F.col(key).alias("key"), F.split(F.lower(F.col(text)), _NOT_TERM).alias("parts"))
    # a cut leaves an empty part at either end at most; one walk over the parts keeps the query's terms
    length = F.size("parts") - (F.get("parts", F.lit(0)) == "").cast("int") - ((F.size("parts") > 1) & (F.element_at("parts", -1) == "")).cast("int")
    rows = parts.select("key", length.alias("length"), F.filter("parts", lambda t: t.isin(wanted)).alias("found"))
    counts = [F.size(F.filter("found", _equals(w))).alias(f"tf{i}") for i, w in enumerate(wanted)]
    stats = rows.select("length", *counts).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))])
    # one predicate over one column: pushed below the projection it repeats the walk once, not once a term
    hits = rows.where(F.size("found") > 0).select("key", "length", *counts).join(F.broadcast(stats))  # one row
    total = F.lit(0.0)
    for i in range(len(wanted)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.ln(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        total = total + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return hits.select("key", total.alias("score"))


def vector_scores(vectors: DataFrame, key: str, vector: str, query: Sequence[float]) -> DataFrame:
    """key and cosine with one query vector."""
    return vectors.select(F.col(key).alias("key"), cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])).alias("score"))


def ranked(scores: DataFrame, fetch: int) -> DataFrame:
    """The ``fetch`` best keys with their rank; ties by key."""
    top = scores.orderBy(F.col("score").desc(), "key").limit(fetch)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "key")))  # over fetch rows


def fused(rankings: Sequence[DataFrame], constant: int = FUSION) -> DataFrame:
    """key and the sum of 1 / (constant + rank) over the rankings that have it."""
    parts = [r.select("key", (1.0 / (constant + F.col("rank"))).alias("part")) for r in rankings]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy("key").agg(F.sum("part").alias("score"))


def fetch_size(limit: int) -> int:
    return max(50, 5 * clamp(limit))


def clamp(limit: int, most: int = 50) -> int:
    return max(1, min(limit, most))


def hybrid(texts: DataFrame, vectors: DataFrame | None, *, vector_key: str, vector: str, query_vector: Sequence[float] | None, limit: int = 8) -> DataFrame:
    """key and fused score of the best chunks.

    ``texts`` are keyword scores (key, score), as of a ``TextIndex``, and
    ``vectors`` the candidates' vectors; filters were applied to both before.
    """
    rankings = [ranked(texts, fetch_size(limit))]
    if vectors is not None and query_vector is not None:
        rankings.append(ranked(vector_scores(vectors, vector_key, vector, query_vector), fetch_size(limit)))
    return fused(rankings)


def partition_top(scores: DataFrame, partition: str, key: str, k: int) -> DataFrame:
    """``scores`` with in_rank: the ``k`` best rows of each partition by score, then key."""
    order = Window.partitionBy(partition).orderBy(F.col("score").desc(), key)
    return scores.withColumn("in_rank", F.row_number().over(order)).where(F.col("in_rank") <= k)


def merged_top(top: DataFrame, partition: str, order: Sequence, k: int) -> DataFrame:
    """Best rows over all partitions; ties follow the order in which the partitions were asked for."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(partition))
    return top.withColumn("asked", place).orderBy(F.col("score").desc(), "asked", "in_rank").limit(k)


def dedupe_hits(hits: DataFrame, *, span: Sequence[str] = ("project_id", "path", "start_line", "end_line"), rank: str = "rank", limit: int = 8) -> DataFrame:
    """First hit of each span in rank order, cut at ``limit``, then ordered by score, path and start."""
    first = hits.withColumn("_n", F.row_number().over(Window.partitionBy(*span).orderBy(rank))).where("_n = 1").drop("_n")
    return first.orderBy(rank).limit(limit).orderBy(F.col("score").desc(), "path", "start_line")


def with_names(hits: DataFrame, projects: DataFrame) -> DataFrame:
    """Adds project_name: the project's name or, where it is unknown, its id."""
    names = projects.select(F.col("project_id"), F.col("name").alias("_name"))
    return hits.join(names, "project_id", "left").withColumn("project_name", F.coalesce("_name", F.col("project_id").cast("string"))).drop("_name")


def with_snippet(hits: DataFrame, content: str = "content") -> DataFrame:
    return hits.withColumn("truncated", truncated(F.col(content))).withColumn("snippet", snippet(F.col(content)))


def symbol_matches(name: str, mode: str, *, symbol: str = "symbol", qualified: str = "qualified_symbol") -> Column:
    """Exact, prefix or contains on the qualified or the bare name; no character is a wildcard."""
    a, b = F.col(symbol), F.col(qualified)
    if mode == "exact":
        return (a == name) | (b == name)
    if mode == "prefix":
        return a.startswith(name) | b.startswith(name)
    if mode == "contains":
        return a.contains(name) | b.contains(name)
    raise ValueError(f"invalid symbol match mode: {mode}")


def find_symbol(chunks: DataFrame, name: str, *, match: str = "exact", kinds: Sequence[str] | None = None, limit: int = 20) -> DataFrame:
    found = chunks.where(symbol_matches(name, match))
    if kinds:
        found = found.where(F.col("kind").isin(list(kinds)))
    return found.orderBy("path", "start_line", "kind").limit(clamp(limit))


def outline(chunks: DataFrame, path: str) -> DataFrame:
    """Definitions of one file, the first chunk of each, in line order."""
    own = chunks.where((F.col("path") == path) & F.col("symbol").isNotNull() & F.col("qualified_symbol").isNotNull() & (F.col("symbol") != "") & (F.col("qualified_symbol") != ""))
    own = own.withColumn("kind", without_part(F.col("kind")))
    first = Window.partitionBy("kind", "qualified_symbol").orderBy("start_line", "end_line")
    columns = ("kind", "symbol", "qualified_symbol", "parent_symbol", "start_line", "end_line")
    return own.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*columns).orderBy("start_line")


def chunk_by_id(chunks: DataFrame, projects: DataFrame, chunk_id: str) -> DataFrame:
    """The chunk, if the id's part before the first colon is a registered project."""
    project, colon, rest = chunk_id.partition(":")
    if not (project and colon and rest):
        return chunks.limit(0)
    known = projects.where(F.col("project_id") == project).select("project_id")
    return chunks.where((F.col("project_id") == project) & (F.col("chunk_id") == chunk_id)).join(known, "project_id", "left_semi")


#: Queries that are broadcast at once.
QUERY_BLOCK = 1024


def exact_neighbours(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """query, key, score and rank of the ``k`` nearest by cosine.

    A stated query set against all rows: each block of ``QUERY_BLOCK`` queries
    is broadcast and keeps its ``k`` best inside each task before the shuffle.
    """
    asked = queries.select(F.col(key).alias("query"), F.col(vector).alias("_q"))
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("_v"))
    found = None
    for block in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block)
        pairs = rows.join(F.broadcast(own)).select("query", "key", cosine(F.col("_v"), F.col("_q")).alias("score"))
        found = pairs if found is None else found.unionByName(pairs)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Rows from which an approximate index is worth its upkeep.
INDEX_ROWS = 20_000


class SignIndex:
    """Approximate nearest neighbours by the signs of random projections.

    Each of ``tables`` tables keys a vector by ``bits`` signs. A query probes
    its own key and the keys that differ in one of its least certain signs, and
    scores what it meets exactly. A query that meets fewer than ``k`` rows is
    searched exactly, so none comes back short.
    """

    def __init__(self, vectors: DataFrame, key: str, vector: str, *, width: int, tables: int = 32, bits: int = 8, probes: int = 8, seed: int = 7):
        self.key, self.vector, self.bits, self.probes = key, vector, bits, probes
        drawn = random.Random(seed)
        self.planes = [[[drawn.gauss(0, 1) for _ in range(width)] for _ in range(bits)] for _ in range(tables)]
        self.vectors = vectors

    def _sides(self, vector: Column) -> Column:
        """Dot products with the planes, table by table."""
        planes = F.array(*[F.array(*[F.array(*map(F.lit, p)) for p in table]) for table in self.planes])
        return F.transform(planes, lambda table: F.transform(table, lambda p: dot(vector, p)))

    @staticmethod
    def _code(sides: Column) -> Column:
        return F.aggregate(sides, F.lit(0), lambda a, x: a * 2 + (x >= 0).cast("int"))

    def neighbours(self, queries: DataFrame, k: int) -> DataFrame:
        """query, key, score and rank of about the ``k`` nearest by cosine."""
        sides = self._sides(F.col(self.vector))
        coded = self.vectors.select(F.col(self.key).alias("key"), F.col(self.vector).alias("_v"), F.posexplode(F.transform(sides, self._code)).alias("_table", "_code"))
        asked = queries.select(F.col(self.key).alias("query"), F.col(self.vector).alias("_q"), F.posexplode(sides).alias("_table", "_sides"))
        unsure = F.slice(F.array_sort(F.transform("_sides", lambda x, i: F.struct(F.abs(x).alias("d"), i.alias("i")))), 1, self.probes)
        places = F.array(*[F.lit(1 << (self.bits - 1 - i)) for i in range(self.bits)])
        codes = F.concat(F.array(self._code(F.col("_sides"))), F.transform(unsure, lambda u: self._code(F.col("_sides")).bitwiseXOR(F.get(places, u["i"]))))
        met = asked.select("query", "_q", "_table", F.explode(codes).alias("_code")).join(coded, ["_table", "_code"]).select("query", "key", "_q", "_v").dropDuplicates(["query", "key"])
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), "key")
        found = met.select("query", "key", cosine(F.col("_q"), F.col("_v")).alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        full = found.where(F.col("rank") == k).select(F.col("query").alias(self.key))
        short = queries.join(full, self.key, "left_anti")
        return found.join(full.withColumnRenamed(self.key, "query"), "query", "left_semi").unionByName(exact_neighbours(self.vectors, short, self.key, self.vector, k))


def approximate_neighbours(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, *, least_rows: int = INDEX_ROWS, **options) -> DataFrame:
    """query, key, score and rank: by a ``SignIndex`` over ``least_rows`` rows or more, exactly below."""
    first = vectors.select(F.size(vector)).first()
    if first is None or vectors.limit(least_rows).count() < least_rows:
        return exact_neighbours(vectors, queries, key, vector, k)
    return SignIndex(vectors, key, vector, width=first[0], **options).neighbours(queries, k)
