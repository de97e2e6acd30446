"""Generated corpora for measuring: declared by formulas over a range, so they scale like any table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Topics of the judged corpus.
TOPICS = ("authentication", "billing", "caching", "deployment", "encoding", "formatting", "graphics", "history")


def indexing_corpus(spark: SparkSession, files: int, functions: int) -> DataFrame:
    """path and content of Python files with numbered functions."""
    body = F.transform(F.sequence(F.lit(0), F.lit(functions - 1)), lambda i: F.format_string('def function_%d_%d(value):\n    """Return %d."""\n    return value + %d\n', F.col("id"), i, i, i))
    return spark.range(files).select(F.format_string("package_%d/module_%d.py", F.expr("id div 16"), F.col("id")).alias("path"), F.array_join(body, "\n").alias("content"))


def judged_corpus(spark: SparkSession, passages: int) -> tuple[DataFrame, DataFrame]:
    """Passages (chunk_id, content, topic) and queries (query, text, topic); a passage is relevant to its topic's query."""
    topics = F.array(*map(F.lit, TOPICS))
    topic = F.get(topics, (F.col("id") % len(TOPICS)).cast("int"))
    rows = spark.range(passages).select(F.col("id").alias("chunk_id"), F.format_string("def %s_%d():\n    return '%s step %d'", topic, F.col("id"), topic, F.expr(f"id div {len(TOPICS)}")).alias("content"), topic.alias("topic"))
    asked = spark.range(len(TOPICS)).select(F.col("id").alias("query"), F.concat(F.lit("how does "), topic, F.lit(" work")).alias("text"), topic.alias("topic"))
    return rows, asked


def calibration_passages(spark: SparkSession, passages: int, words: int) -> DataFrame:
    """Passages of one length, all different."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), lambda i: F.concat(F.lit("token"), ((F.col("id") * 31 + i * 17) % 9973).cast("string"))), " ")
    return spark.range(passages).select("id", text.alias("text"))


def memory_shapes(spark: SparkSession, size: int) -> DataFrame:
    """Files that strain memory in different ways: ordinary, near the size limit, one long line, many blank lines."""
    shapes = {
        "ordinary.py": F.repeat(F.lit("value = compute(1, 2)\n"), F.lit(64)),
        "near_limit.py": F.repeat(F.lit("x = 1  # filler\n"), F.lit(size // 16)),
        "minified.js": F.repeat(F.lit("f(1);"), F.lit(size // 5)),
        "blank.py": F.repeat(F.lit("\n"), F.lit(size)),
    }
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("path"), c.alias("content")) for n, c in shapes.items()])).alias("f")).select("f.*")
