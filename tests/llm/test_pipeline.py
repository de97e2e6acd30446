import zlib

import numpy as np
import pytest

import corpus_pipeline
from strataquery.llm import qda_quality
from tests.llm import brute


def plain(rows, marks):
    """The stages over (doc_id, text, source) rows, one after the other."""
    facts, rest = brute.judged([(t, s) for _, t, s in rows])
    rows = [(d, t, s) for (d, _, s), (_, _, kept), t in zip(rows, facts, rest) if kept]
    sums = {}
    for d, t, _ in rows:
        if d in marks and zlib.crc32(str(d).encode()) % 3 != 1:
            x = np.array(qda_quality.statistics(t))
            n, a, b = sums.get(marks[d], (0, 0, 0))
            sums[marks[d]] = (n + 1, a + x, b + np.outer(x, x))
    model = qda_quality.learned(sums)
    rows = [r for r in rows if model.scores(np.array([qda_quality.statistics(r[1])]))[0] >= 0.5]
    first = set(brute.near_groups([(d, t) for d, t, _ in rows]))
    rows = [r for r in rows if r[0] in first]
    size, _, taken = brute.mix([(d, s, t) for d, t, s in rows])
    return sorted((d, *brute.token_row(t)) for (d, t, _), n, k in zip(rows, size, taken) for _ in range(k // n if n else 0))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_run_equals_the_plain_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    want = plain([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], marks)
    got = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, got.collect())) == want


def test_stages_keep_columns_and_survive_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, size string, `row` string"
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", "a", 1, 0.0, "x", "x", "x"), (1, text, "en", "a", 1, 0.0, "x", "x", "x"), (None, text + " more", None, None, None, None, None, None, None), (2, None, "en", "a", 1, 0.0, "x", "x", "x"), (3, "", None, "b", 0, 0.0, "x", "x", "x"), (4, text.upper(), "de", None, 4, 0.1, "x", "x", "x")]
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for n in (len(rows), 0):
        docs = spark.createDataFrame(rows[:n], schema)
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == names, name
            out.write.parquet(str(tmp_path / f"{n}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{n}-{name}"))
        assert docs.count() <= 2 * n


def test_stages_are_the_five_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "source_mix", "bpe_round_trip"]
