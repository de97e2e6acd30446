"""Queries of retrieval: symbols, outlines, chunks, keyword, vector and hybrid search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquery.operators import metrics, retrieval
from strataquery.operators.textindex import TextIndex
from strataquery.plans.base import Tables, query
from strataquery.shared import shared_folder


def _symbols(t: Tables) -> DataFrame:
    """Parts as a symbol table."""
    return t.part.select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("start_line"), F.lower("p_type").alias("kind"), F.substring_index("p_name", " ", -1).alias("symbol"), F.col("p_name").alias("qualified_symbol"))


_SYMBOLS = "SELECT path, start_line, kind, symbol, qualified_symbol FROM (SELECT p_brand AS path, p_partkey AS start_line, lower(p_type) AS kind, split_part(p_name, ' ', -1) AS symbol, p_name AS qualified_symbol FROM part) WHERE {} ORDER BY path, start_line, kind LIMIT 20"


@query(_SYMBOLS.format("symbol = 'widget' OR qualified_symbol = 'widget'"))
def symbol_exact(t: Tables) -> DataFrame:
    return retrieval.find_symbol(_symbols(t), "widget")


@query(_SYMBOLS.format("starts_with(symbol, 'red') OR starts_with(qualified_symbol, 'red')"))
def symbol_prefix(t: Tables) -> DataFrame:
    return retrieval.find_symbol(_symbols(t), "red", match="prefix")


@query(_SYMBOLS.format("contains(qualified_symbol, 'll r') AND kind IN ('economy', 'standard')"))
def symbol_contains(t: Tables) -> DataFrame:
    return retrieval.find_symbol(_symbols(t), "ll r", match="contains", kinds=["economy", "standard"])


def _paragraphs(t: Tables) -> DataFrame:
    """Lines of documents as chunks; a line's first word is its symbol, every second line a part of the one before."""
    lines = t.documents.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    word = F.lower(F.regexp_extract("line", r"^([A-Za-z]+)", 1))
    return lines.select(F.concat_ws("/", "source", "doc_id").alias("path"), F.when(F.col("at") % 2 == 0, "function").otherwise("function_part").alias("kind"), word.alias("symbol"), F.concat_ws(".", "source", word).alias("qualified_symbol"), F.col("source").alias("parent_symbol"), (F.col("at") + 1).alias("start_line"), (F.col("at") + 1).alias("end_line"))


@query(r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(1, 1 + len(string_split(text, chr(10))))) AS n0 FROM documents),
w AS (SELECT source || '/' || doc_id AS path, source, lower(regexp_extract(line, '^([A-Za-z]+)', 1)) AS symbol, n0 FROM l)
SELECT 'function' AS kind, symbol, source || '.' || symbol AS qualified_symbol, source AS parent_symbol, min(n0) AS start_line, min(n0) AS end_line
FROM w WHERE path = 'src10/10' AND symbol <> '' GROUP BY symbol, source""")
def file_outline(t: Tables) -> DataFrame:
    found = retrieval.outline(_paragraphs(t), "src10/10")
    return found.withColumns({c: F.col(c).cast("long") for c in ("start_line", "end_line")})


@query("SELECT source || ':' || doc_id AS chunk_id, lang, text FROM documents WHERE source = 'src7' AND doc_id = 27")
def chunk_lookup(t: Tables) -> DataFrame:
    chunks = t.documents.select(F.concat_ws(":", "source", "doc_id").alias("chunk_id"), F.col("source").alias("project_id"), "lang", "text")
    projects = t.documents.select(F.col("source").alias("project_id")).distinct()
    return retrieval.chunk_by_id(chunks, projects, "src7:27").select("chunk_id", "lang", "text")


@query("""
SELECT c_custkey, c_nationkey AS project_id, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS project_name
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 0""")
def hits_with_project_name(t: Tables) -> DataFrame:
    projects = t.nation.where(F.col("n_regionkey") != 0).select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("name"))
    return retrieval.with_names(t.customer.select("c_custkey", F.col("c_nationkey").alias("project_id")), projects).select("c_custkey", "project_id", "project_name")


#: Words of the keyword queries.
TERMS = ("thing", "edat", "release", "license")

_BM25 = r"""
d AS (SELECT doc_id AS key, {keep} AS keep, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS terms FROM documents WHERE {where}),
c AS (SELECT key, CAST(len(terms) AS DOUBLE) AS length, {tfs} FROM d),
s AS (SELECT count(*) AS n, avg(length) AS mean, {dfs} FROM c),
text_scores AS (SELECT key, {score} AS score FROM c, s WHERE {any})"""


def _bm25_sql(where: str = "true", terms: tuple[str, ...] = TERMS) -> str:
    tfs = ", ".join(f"CAST(len(list_filter(terms, lambda x: x = '{w}')) AS DOUBLE) AS tf{i}" for i, w in enumerate(terms))
    dfs = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))" for i in range(len(terms)))
    return _BM25.format(keep="true", where=where, tfs=tfs, dfs=dfs, score=score, any=" OR ".join(f"tf{i} > 0" for i in range(len(terms))))


@query(f"WITH {_bm25_sql()} SELECT key AS doc_id, round(score, 6) AS score FROM text_scores")
def fulltext_bm25(t: Tables) -> DataFrame:
    return t.text_index().bm25(TERMS).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"WITH {_bm25_sql()} SELECT key AS doc_id, round(score, 6) AS score FROM text_scores")
def fulltext_scan(t: Tables) -> DataFrame:
    """The same without an index, in one pass over the texts."""
    return retrieval.bm25(t.documents, "doc_id", "text", TERMS).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query(r"""
SELECT source, lang, count(*) AS n, CAST(sum(len(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS BIGINT) AS total
FROM documents GROUP BY source, lang""")
def text_index_build(t: Tables) -> DataFrame:
    """A new index, and the statistics it keeps."""
    index = TextIndex.build(t.documents, f"{shared_folder(t.spark)}/text-index-{uuid.uuid4().hex}", key="doc_id", text="text", facets=["source", "lang"])
    return t.spark.read.parquet(f"{index.path}/stats")


@query(r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS terms FROM documents),
p AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS length, unnest(terms) AS term FROM d)
SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM p GROUP BY term""")
def text_postings(t: Tables) -> DataFrame:
    return t.text_index().postings().groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("occurrences"))


def _query_vector(t: Tables) -> list[float]:
    """Vector 0, as the question."""
    row = t.embeddings.where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]] if row else []


_VECTOR = """
q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 0),
vector_scores AS (
  SELECT vec_id AS key, list_dot_product(CAST(embedding AS DOUBLE[]), qv) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(qv, qv))) AS score
  FROM embeddings, q WHERE vec_id IN (SELECT doc_id FROM documents WHERE {where})),
r AS (
  SELECT key, row_number() OVER (ORDER BY score DESC, key) AS rank FROM text_scores QUALIFY rank <= 50
  UNION ALL SELECT key, row_number() OVER (ORDER BY score DESC, key) AS rank FROM vector_scores QUALIFY rank <= 50),
f AS (SELECT key, sum(1 / CAST(60 + rank AS DOUBLE)) AS score FROM r GROUP BY key)"""


def _hybrid(t: Tables, where=None) -> DataFrame:
    chunks = t.documents if where is None else t.documents.where(where)
    vectors_of = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding").join(chunks.select("doc_id"), "doc_id", "left_semi")
    return retrieval.hybrid(t.text_index().bm25(TERMS, where), vectors_of, vector_key="doc_id", vector="embedding", query_vector=_query_vector(t))


_HITS = " SELECT doc_id, source, lang, round(score, 9) AS score, left(text, 4000) AS snippet FROM (SELECT key, score FROM f ORDER BY round(score, 9) DESC, key LIMIT 8) JOIN documents ON doc_id = key"


def _hits(t: Tables, scores: DataFrame) -> DataFrame:
    best = scores.select("key", F.round("score", 9).alias("score")).orderBy(F.col("score").desc(), "key").limit(8).collect()  # 8 rows
    found = t.documents.where(F.col("doc_id").isin([r["key"] for r in best]))  # reaches the scan
    scored = found.join(F.broadcast(t.spark.createDataFrame(best, "key long, score double")), F.col("doc_id") == F.col("key"))
    return scored.select("doc_id", "source", "lang", "score", F.substring("text", 1, 4000).alias("snippet"))


@query("WITH " + _bm25_sql() + ", " + _VECTOR.format(where="true") + _HITS)
def hybrid_fused(t: Tables) -> DataFrame:
    return _hits(t, _hybrid(t))


@query("WITH " + _bm25_sql("lang IN ('en', 'de') AND source IN ('src0', 'src1', 'src2')") + ", " + _VECTOR.format(where="lang IN ('en', 'de') AND source IN ('src0', 'src1', 'src2')") + _HITS)
def search_filtered(t: Tables) -> DataFrame:
    return _hits(t, _hybrid(t, F.col("lang").isin("en", "de") & F.col("source").isin("src0", "src1", "src2")))


@query("WITH " + _bm25_sql() + """,
top AS (SELECT source, key, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, key) AS in_rank FROM (SELECT source, key, round(score, 6) AS score FROM text_scores JOIN documents ON doc_id = key) QUALIFY in_rank <= 5)
SELECT source, key AS doc_id, score, in_rank FROM (SELECT *, list_position(['src4', 'src2', 'src0', 'src9'], source) AS asked FROM top WHERE source IN ('src4', 'src2', 'src0', 'src9') ORDER BY score DESC, asked, in_rank LIMIT 12)""")
def partition_topk_merge(t: Tables) -> DataFrame:
    placed = t.text_index().bm25(TERMS).withColumn("score", F.round("score", 6))
    order = ["src4", "src2", "src0", "src9"]
    top = retrieval.partition_top(placed.where(F.col("source").isin(order)), "source", "key", 5)
    return retrieval.merged_top(top, "source", order, 12).select("source", F.col("key").alias("doc_id"), "score", F.col("in_rank").cast("long").alias("in_rank"))


@query("WITH " + _bm25_sql() + """,
r AS (SELECT source AS project_id, lang AS path, n_chars // 500 AS start_line, key, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, key) AS rank FROM text_scores JOIN documents ON doc_id = key),
u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY project_id, path, start_line ORDER BY rank) = 1)
SELECT project_id, path, start_line, key AS doc_id, score FROM (SELECT * FROM u ORDER BY rank LIMIT 20)""")
def dedupe_ranked_hits(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    scores = t.text_index().bm25(TERMS).select("key", F.round("score", 6).alias("score"))
    facts = t.documents.select(F.col("doc_id").alias("key"), F.col("source").alias("project_id"), F.col("lang").alias("path"), F.expr("n_chars div 500").alias("start_line"))
    # ranks are needed only inside a span; a global order of (score, key) stands for the rank
    hits = scores.join(facts, "key").withColumn("rank", F.struct((-F.col("score")).alias("s"), "key"))
    found = retrieval.dedupe_hits(hits, span=("project_id", "path", "start_line"), limit=20)
    return found.select("project_id", "path", "start_line", F.col("key").alias("doc_id"), "score")


_CENTRES = """
centres AS (
  SELECT label AS query, list(m ORDER BY i) AS qv FROM (
    SELECT label, i, avg(CAST(embedding[i + 1] AS DOUBLE)) AS m FROM embeddings, (SELECT unnest(range(0, 64)) AS i) GROUP BY label, i) GROUP BY label)"""


def _centres(t: Tables) -> DataFrame:
    """Mean vector of each label: a question for each topic."""
    parts = t.embeddings.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    return parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v")).select(F.col("label").cast("long").alias("id"), "v")


_COSINE = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
_NEAREST = "SELECT query, vec_id AS key, row_number() OVER (PARTITION BY query ORDER BY round({score}, 9) DESC, vec_id) AS rank, round({score}, 9) AS score FROM {rows}, centres QUALIFY rank <= {k}"


def _near(rows: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    found = retrieval.exact_neighbours(rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v")), questions, "id", "v", k)
    return found.select("query", "key", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


_EXACT = _NEAREST.format(score=_COSINE.format(a="CAST(embedding AS DOUBLE[])", b="qv"), rows="embeddings", k=8)


@query(f"WITH {_CENTRES} SELECT CAST(query AS BIGINT) AS query, key, rank, round(score, 6) AS score FROM ({_EXACT})")
def knn_exact(t: Tables) -> DataFrame:
    return _near(t.embeddings, _centres(t), 8).withColumn("score", F.round("score", 6))


_QUANTISED = "(SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 127 + 0.5::DOUBLE) / 127) AS embedding FROM embeddings)"
_COARSE = _NEAREST.format(score=_COSINE.format(a="embedding", b="qv"), rows=_QUANTISED, k=8)


def _quantised(t: Tables) -> DataFrame:
    """Vectors stored in 8 bits a component."""
    return t.embeddings.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 127 + 0.5) / 127.0).alias("embedding"))


_BOTH = f"WITH {_CENTRES}, a AS ({_EXACT}), b AS ({_COARSE})"


@query(_BOTH + " SELECT round((SELECT count(*) FROM b JOIN a USING (query, key)) / CAST((SELECT count(DISTINCT query) FROM a) * 8 AS DOUBLE), 9) AS recall")
def recall_at_k(t: Tables) -> DataFrame:
    questions = _centres(t)
    return metrics.recall(_near(_quantised(t), questions, 8), _near(t.embeddings, questions, 8), 8).select(F.round("recall", 9).alias("recall"))


@query(_BOTH + " SELECT CAST(query AS BIGINT) AS query, count(*) AS common FROM a JOIN b USING (query, key) GROUP BY query")
def topk_overlap(t: Tables) -> DataFrame:
    questions = _centres(t)
    both = _near(t.embeddings, questions, 8).join(_near(_quantised(t), questions, 8).select("query", "key"), ["query", "key"])
    return both.groupBy("query").agg(F.count(F.lit(1)).alias("common"))


@query(_BOTH + """,
u AS (SELECT coalesce(a.query, b.query) AS query, coalesce(a.key, b.key) AS key, coalesce(a.rank, 9) AS ra, coalesce(b.rank, 9) AS rb FROM a FULL JOIN b USING (query, key)),
p AS (SELECT x.query, sign(x.ra - y.ra) AS s, sign(x.rb - y.rb) AS t FROM u x JOIN u y ON x.query = y.query AND x.key < y.key),
n AS (SELECT query, count(*) FILTER (WHERE s <> 0 AND s = t) AS c, count(*) FILTER (WHERE s <> 0 AND s = -t) AS d, count(*) FILTER (WHERE s = 0 AND t <> 0) AS tx, count(*) FILTER (WHERE t = 0 AND s <> 0) AS ty FROM p GROUP BY query)
SELECT CAST(query AS BIGINT) AS query, round(CASE WHEN (c + d + tx) * (c + d + ty) = 0 THEN 1 ELSE (c - d) / sqrt((c + d + tx) * (c + d + ty)) END, 9) AS tau FROM n""")
def rank_correlation(t: Tables) -> DataFrame:
    questions = _centres(t)
    return metrics.rank_correlation(_near(t.embeddings, questions, 8), _near(_quantised(t), questions, 8)).select("query", F.round("tau", 9).alias("tau"))


@query(f"SELECT vec_id, round({_COSINE.format(a='CAST(e.embedding AS DOUBLE[])', b='q.embedding')}, 9) AS cosine FROM embeddings e JOIN {_QUANTISED} q USING (vec_id)")
def cosine_rows(t: Tables) -> DataFrame:
    return metrics.row_cosines(t.embeddings, _quantised(t), "vec_id", "embedding").select("vec_id", F.round("cosine", 9).alias("cosine"))


@query(_BOTH + """, m AS (SELECT (SELECT count(*) FROM b JOIN a USING (query, key)) / CAST((SELECT count(DISTINCT query) FROM a) * 8 AS DOUBLE) AS recall, CAST(NULL AS DOUBLE) AS speedup)
SELECT round(recall, 9) AS recall, speedup, coalesce(recall >= 0.9::DOUBLE, false) AS recall_ok, false AS speedup_ok, false AS adopted FROM m""")
def gate_eval(t: Tables) -> DataFrame:
    questions = _centres(t)
    measured = metrics.recall(_near(_quantised(t), questions, 8), _near(t.embeddings, questions, 8), 8).select(F.round("recall", 9).alias("recall"), F.lit(None).cast("double").alias("speedup"))
    return metrics.adoption(measured, {"recall": 0.9, "speedup": 1.25})


@query(f"WITH {_CENTRES} SELECT count(DISTINCT query) AS queries, count(*) AS wanted, true AS recall_ok FROM ({_EXACT})")
def ann_recall(t: Tables) -> DataFrame:
    """Recall of the approximate index against exact search, 0.9 or more, over all vectors; here an index of any size is used."""
    questions = _centres(t)
    rows = t.embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"))
    exact = retrieval.exact_neighbours(rows, questions, "id", "v", 8).select("query", "key")
    found = retrieval.approximate_neighbours(rows, questions, "id", "v", 8, least_rows=1).select("query", "key", F.lit(1).alias("hit"))
    both = exact.join(found, ["query", "key"], "left").agg(F.count_distinct("query").alias("queries"), F.count(F.lit(1)).alias("wanted"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))
    return both.select("queries", "wanted", (F.col("recall") >= 0.9).alias("recall_ok"))


@query("""
SELECT doc_id, embedding IS NOT NULL AS has_vector, quality FROM documents LEFT JOIN embeddings ON vec_id = doc_id LEFT JOIN labels USING (doc_id)""")
def chunk_coverage(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id").join(t.embeddings.select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("v")), "doc_id", "left").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("v", F.lit(False)).alias("has_vector"), "quality")
