"""Corpus pipeline: five stages over documents, each one operator of ``strataquery.llm``.

Each stage reads all that the stage before it kept. Its result is written as
Parquet to the shared folder and read again, so a later stage never recomputes
an earlier one. All stages but the last return the columns of documents.

Null ids, texts, languages and sources pass through the stages as the
operators define; an empty table stays empty; columns that documents has
besides the usual ones are carried along, whatever their names. Repeated rows
count each for itself until near_dedup keeps one of them; ties there fall to
the smallest id. Very long texts are processed whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.llm import bpe, line_quality, mixing, near_copies, qda_quality
from strataquery.shared import shared_folder
from strataquery.sources.hadoop import Folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't depleted, without the lines that many documents of their source share (operator 4)."""
    kept = line_quality.clean(docs)
    return kept.withColumn("n_chars", F.length("text").cast(kept.schema["n_chars"].dataType)) if "n_chars" in kept.columns else kept


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more (operator 8), learned from labelled rows that aren't held out."""
    model = qda_quality.fit(docs.where(~qda_quality.held_out(F.col("doc_id"))), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(qda_quality.score(F.col("text"), model) >= 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id (operator 6, verified on five-word shingles)."""
    return near_copies.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document as often as the mix takes it, 0 to 2 times (operator 3)."""
    return mixing.mixed_documents(docs)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of each document of the mixture, as counts and digests (operator 5)."""
    done = bpe.round_trip(docs.select("doc_id", "text"))
    return done.select(
        "doc_id",
        F.expr("div(octet_length(token_ids), 4L)").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("bpe_round_trip", bpe_round_trip),
]

#: The classifier, the fingerprints and the encoder have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    shared, before = Folder(spark, f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(shared.at(name))
        docs = spark.read.parquet(shared.at(name))
        if before:  # nothing reads it any more
            shared.delete(before)
        before = name
    return docs
