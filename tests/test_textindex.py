import pytest
from pyspark.sql import functions as F

from strataquery.operators import retrieval
from strataquery.operators.textindex import TextIndex
from strataquery.plans.base import Tables

SCHEMA = "id string, text string, lang string"
ROWS = [("a", "red fox red", "en"), ("b", "blue Fox", "en"), ("c", "rot fuchs red", "de"), ("d", "", "de"), ("e", None, "en"), ("f", "a,b;red", None)]


@pytest.fixture
def index(spark, tmp_path):
    return TextIndex.build(spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "index"), key="id", text="text", facets=["lang"])


def scores(frame):
    return {r["key"]: pytest.approx(r["score"]) for r in frame.select("key", "score").collect()}


def test_scores_equal_those_of_a_scan(spark, index):
    rows = spark.createDataFrame(ROWS, SCHEMA).withColumn("text", F.coalesce("text", F.lit("")))
    for terms in (["red"], ["red", "fox", "red"], ["none"], ["fox", "none"]):
        assert scores(index.bm25(terms)) == scores(retrieval.bm25(rows, "id", "text", terms))
    english = F.col("lang") == "en"
    assert scores(index.bm25(["red", "fox"], english)) == scores(retrieval.bm25(rows.where(english), "id", "text", ["red", "fox"]))


def test_terms_reach_the_scan(spark, index):
    plan = index.postings(["red", "fox"], F.col("lang") == "en")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(term, [fox,red])" in plan.replace("`", "") or "In(term, [red,fox])" in plan


def test_an_index_is_built_once_a_table(spark, sf):
    tables = Tables(spark, sf)
    first = tables.text_index().path
    assert tables.text_index().path == first == Tables(spark, sf).text_index().path


def test_an_empty_table(spark, tmp_path):
    index = TextIndex.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), key="id", text="text")
    assert index.stats() == (0, 0.0) and index.bm25(["red"]).count() == 0
