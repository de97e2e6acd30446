"""Queries of the training-data operators, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.llm import bpe, hilbert_shards, line_quality, link_trust, mixing, qda_quality, simhash, token_counts, topk, toxicity
from strataquery.llm.common import read_table

# The rules that op9 applies.
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits: one replaced, one inserted, one removed passage."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    changes = [(size * 3 / 4, 12, ""), (size / 2, 0, " [note] "), (size / 4, 7, "###")]
    edits = F.array(*[F.struct(F.floor(at).cast("long").alias("start"), F.lit(n).cast("long").alias("removed"), F.lit(new).alias("inserted")) for at, n, new in changes])
    counted = token_counts.apply_edits(docs.withColumn("edits", edits), "edits")
    return counted.select(
        "doc_id",
        F.col("edited.tokens_before").alias("n_tokens"),
        token_counts.token_total(F.col("edited.tree")).alias("n_tokens_edited"),
        F.sha2(F.col("edited.text").cast("binary"), 256).alias("edited_sha256"),
        F.length("edited.text").cast("long").alias("edited_chars"),
        F.col("edited.encoded_chars").alias("encoded_chars"),
    )


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    slim = docs.select("doc_id", "lang", "source", "n_chars", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    cut = hilbert_shards.hilbert_shards(slim, {"lang": "rank", "source": "rank", "n_chars": "log"}, shards=8, ties=["text_crc32", "doc_id", "size"])
    return cut.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept"]
    return line_quality.judge(docs).select(*names)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_digests(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _token_digests(docs: DataFrame) -> DataFrame:
    done = bpe.round_trip(docs)
    return done.select("doc_id", F.expr("div(octet_length(token_ids), 4L)").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels")
    graded = toxicity.grade_documents(docs, labels.where(~qda_quality.held_out(F.col("doc_id"))))
    return graded.select("doc_id", F.col("toxicity.p_toxic").alias("score"), F.col("toxicity.severity").alias("expected_severity"), F.col("toxicity.grade").alias("grade"), (F.col("toxicity.p_toxic") >= 0.5).cast("int").alias("toxic"))


def op8_qda_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = qda_quality.classify(docs, read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", qda_quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.judge(read_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_counts, op2_hilbert_shards, op3_fair_mix, op4_line_quality, op5_bpe, op6_simhash, op7_toxicity, op8_qda_quality, op9_link_trust, op10_topk, pipeline)
    return {f.__name__: f for f in own}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_MIX = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len({words}) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS pos
  FROM d GROUP BY source),
w AS (
  SELECT *, CAST([3, 1, 2][CAST((pos - 1) % 3 AS INTEGER) + 1] AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS cap FROM s),
f AS (SELECT *, cap / weight AS full_at, CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM w),
l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER before, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level
  FROM f WINDOW before AS (ORDER BY full_at, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT level AS final FROM l WHERE full_at >= level ORDER BY full_at, pos LIMIT 1),
t AS (
  SELECT source, source_size, pos, budget, CASE WHEN final IS NULL OR full_at < final THEN cap ELSE weight * final END AS target
  FROM l LEFT JOIN final ON true),
q AS (
  SELECT doc_id, size, h, source_size, target, pos, budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS words,
         row_number() OVER () AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
items AS (
  SELECT i, size, h, pos, budget, CAST(words + r * source_size AS DOUBLE) / target AS finish
  FROM q, (SELECT unnest([0, 1]) AS r) WHERE size > 0 AND target > 0),
cut AS (SELECT i, sum(size) OVER (ORDER BY finish, pos, h) <= budget AS inside FROM items),
c AS (SELECT i, count(*) FILTER (WHERE inside) AS copies FROM cut GROUP BY i)
SELECT doc_id, size, source_size, target, CAST(coalesce(copies, 0) * size AS BIGINT) AS taken
FROM q LEFT JOIN c USING (i)
""".replace("{words}", _WORDS)

_QUALITY = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, doc_id, source, coalesce(text, '') AS text, {words} AS words FROM documents),
w AS (SELECT i, pos, words[pos:pos + 7] AS win FROM (SELECT i, words, unnest(range(1, len(words) - 6)) AS pos FROM d)),
r AS (SELECT i, pos FROM (SELECT i, pos, count(*) OVER (PARTITION BY i, win) AS n FROM w) WHERE n > 1),
rep AS (
  SELECT i, sum(g) AS n_repeat_words FROM (
    SELECT i, least(8, coalesce(lead(pos) OVER (PARTITION BY i ORDER BY pos) - pos, 8)) AS g FROM r) GROUP BY i),
l AS (SELECT i, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT i, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY i),
n AS (
  SELECT source, text, i, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS line FROM l),
per AS (
  SELECT source, text, line, count(*) / count(DISTINCT i) AS times, len(string_split(line, ' ')) AS words
  FROM n WHERE line <> '' GROUP BY source, text, line),
common AS (SELECT source, line FROM per GROUP BY source, line HAVING count(*) > 20),
gone AS (
  SELECT p.source, p.text, CAST(sum(p.words * p.times) AS BIGINT) AS removed_words
  FROM per p JOIN common c ON p.source IS NOT DISTINCT FROM c.source AND p.line = c.line GROUP BY p.source, p.text),
b AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(d.text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         coalesce(removed_words, 0) AS removed_words
  FROM d LEFT JOIN rep USING (i) LEFT JOIN dup USING (i)
  LEFT JOIN gone g ON d.source IS NOT DISTINCT FROM g.source AND d.text = g.text)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_words - removed_words < CAST(0.3 AS DOUBLE) * n_words) AS kept
FROM b
""".replace("{words}", _WORDS)


#: Steps of the SQL: as many as the operator's bound on its own, for up to a million hosts.
_STEPS = 300


def _trust_sql() -> str:
    # each step sees the step before it only
    chain = """
{m} AS (
  SELECT 0 AS k, host, seed AS mass, CAST(0 AS DOUBLE) AS reached FROM {seeds}
  UNION ALL (
  WITH moved AS (
    SELECT m.k + 1 AS k, b AS host, sum(floor(mass * share * CAST(0.85 AS DOUBLE))) AS reached
    FROM {m} m JOIN {edges} ON a = m.host WHERE m.k < {steps} GROUP BY m.k, b),
  n AS (SELECT max(k) + 1 AS k FROM {m}),
  back AS (SELECT (1099511627776 - coalesce(sum(reached), 0)) / CAST(1099511627776 AS DOUBLE) AS part FROM moved)
  SELECT k, host, sum(mass) AS mass, sum(reached) AS reached FROM (
    SELECT k, host, reached AS mass, reached FROM moved
    UNION ALL SELECT n.k, host, floor(seed * part) AS mass, CAST(0 AS DOUBLE) FROM {seeds}, back, n WHERE n.k <= {steps})
  GROUP BY k, host))"""
    chains = [chain.format(m=m, seeds=s, edges=e, steps=_STEPS).strip() for m, s, e in (("trusted", "seedst", "forth"), ("distrusted", "seedsd", "back_edges"))]
    cases = []
    for word, text in sorted(URL_RULES, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        cases.append((f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + rest}')", text, word))
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, t, _ in cases) + " END"
    word = "CASE " + " ".join(f"WHEN {c} THEN '{w}'" for c, _, w in cases) + " END"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = "coalesce(" + lower.format(r"regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)") + ", '')"
    return rf"""
WITH RECURSIVE p AS (
  SELECT page_id, html, {host} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, {rule} AS rule, {word} AS word FROM p),
known AS (
  SELECT host, count(*) FILTER (WHERE word = 'allow') AS good, count(*) FILTER (WHERE word = 'block') AS bad FROM r WHERE host <> '' GROUP BY host),
linked AS (
  SELECT host AS a, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '(?i)(?:href|src)\s*=\s*["'']?(?:https?:)?//([^/?#"''\s<>]+)', 1), lambda x: {lower.format("x")}))) AS b FROM p),
edges AS (SELECT a, b, count(*) AS n FROM linked WHERE a <> b AND a <> '' GROUP BY a, b),
forth AS (SELECT a, b, n / CAST(sum(n) OVER (PARTITION BY a) AS DOUBLE) AS share FROM edges),
back_edges AS (SELECT b AS a, a AS b, n / CAST(sum(n) OVER (PARTITION BY b) AS DOUBLE) AS share FROM edges),
seedst AS (SELECT host, floor(CAST(1099511627776 AS DOUBLE) * good / CAST(sum(good) OVER () AS DOUBLE)) AS seed FROM known WHERE good > 0),
seedsd AS (SELECT host, floor(CAST(1099511627776 AS DOUBLE) * bad / CAST(sum(bad) OVER () AS DOUBLE)) AS seed FROM known WHERE bad > 0),
{", ".join(chains)},
blocked AS (
  SELECT d.host FROM distrusted d LEFT JOIN trusted t ON t.host = d.host AND t.k = {_STEPS} AND EXISTS (SELECT * FROM edges)
  WHERE d.k = {_STEPS} AND d.reached > coalesce(t.mass, 0) AND d.reached > CAST(1 AS DOUBLE) * (1099511627776 / CAST(greatest(1, (SELECT count(*) FROM known)) AS DOUBLE)))
SELECT page_id, host, path, rule, coalesce(word, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict FROM r
"""


_TOP = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS u FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.u AS DOUBLE[]), CAST(c.u AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_fair_mix": _MIX, "op4_line_quality": _QUALITY, "op9_link_trust": _trust_sql(), "op10_topk": _TOP}
