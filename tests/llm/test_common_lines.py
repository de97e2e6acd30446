import random

import corpus_pipeline


def test_stage_takes_out_a_line_that_few_percent_of_a_source_have(spark):
    rng = random.Random(3)
    line = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    banner = line(30)
    rows = [(i, banner + "\n" + line(2), "a") for i in range(30)] + [(100 + i, line(40), "a") for i in range(570)]
    rows += [(1000 + i, banner + "\n" + line(2), "b") for i in range(10)] + [(2000 + i, banner + "\n" + line(40), "a") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality_rules(spark, docs, "").collect()}
    assert kept == {i: t.split("\n")[1] if i >= 2000 else t for i, t, _ in rows if i >= 100}
