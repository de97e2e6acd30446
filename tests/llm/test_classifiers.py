import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataquery.llm import qda_quality, toxicity

DOCS = "doc_id long, text string, score string, toxicity string, x string, y string"
LABELS = "doc_id long, quality int, toxic int, id string"
SF = "/root/testdata/sf0.01"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], DOCS)


def labels(spark, rows):
    return spark.createDataFrame([(i, q, t, "x") for i, q, t in rows], LABELS)


@pytest.mark.parametrize("text", [None, "", " ", "a", "é" * 10, "x " * 200_000, "A!! B!!", "a\na\na"])
def test_statistics_are_finite(text):
    row = qda_quality.statistics(text)
    assert len(row) == qda_quality.STATISTICS and np.isfinite(row).all()


def test_scores_equal_the_textbook_formula():
    rng = np.random.default_rng(0)
    rows = [rng.normal(c, 1 + c, (50 + 30 * c, 4)) for c in (0, 1)]
    model = qda_quality.learned({c: (len(x), x.sum(axis=0), x.T @ x) for c, x in enumerate(rows)}, 0.2)
    point = rng.normal(size=(7, 4))
    density = []
    for x in rows:
        cov = np.cov(x.T, bias=True)
        cov = 0.8 * cov + (0.2 * np.trace(cov) / 4 + 1e-6) * np.eye(4)
        d = point - x.mean(axis=0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(len(x)))
    assert np.allclose(model.scores(point), 1 / (1 + np.exp(density[0] - density[1])))


def test_learning_equals_one_pass_over_all_rows(spark, sf):
    frame, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = qda_quality.fit(frame, marks)
    text = {r["doc_id"]: r["text"] for r in frame.collect()}
    by = {0: [], 1: []}
    for r in marks.collect():
        by[r["quality"]].append(qda_quality.statistics(text[r["doc_id"]]))
    plain = qda_quality.learned({c: (len(x), np.sum(x, axis=0), np.array(x).T @ np.array(x)) for c, x in by.items()})
    assert np.allclose(model.means, plain.means) and np.allclose(model.factors, plain.factors) and model.odds == plain.odds


def test_quality_of_held_out_rows(spark):
    from strataquery.llm.queries import op8_qda_quality

    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op8_qda_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_scores_do_not_see_ids_or_labels_of_held_out_rows(spark, sf):
    frame, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = marks.withColumn("quality", F.when(qda_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one = {r["doc_id"]: r["score"] for r in qda_quality.classify(frame, marks).collect()}
    assert one == {r["doc_id"]: r["score"] for r in qda_quality.classify(frame, flipped).collect()}


def test_quality_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "good plain words"), (None, "x"), (4, "bad!!"), (4, "bad!!"), (5, "w " * 100_000)]
    for marks, want in (([], 0.5), ([(3, 1, 0)], 1.0), ([(4, 0, 0), (None, 1, 1), (3, None, None), (2, 7, 0)], 0.0)):
        got = qda_quality.classify(docs(spark, rows), labels(spark, marks))
        held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in got.collect()}
        usable = [m for m in marks if m[0] and m[1] in (0, 1) and not held[m[0]]]
        assert {r["score"] for r in got.collect()} == {want if usable else 0.5}
    assert qda_quality.classify(docs(spark, rows).limit(0), labels(spark, [])).count() == 0


def test_single_rows_of_each_class_can_be_learned(spark):
    rows = [(i, t) for i, t in enumerate(["plain words", "###", "plain words again", "### ***", "x", "y", "z"])]
    marks = [(i, int("#" not in t), 0) for i, t in rows]
    scores = {r["text"]: r["score"] for r in qda_quality.classify(docs(spark, rows), labels(spark, marks)).collect()}
    assert all(np.isfinite(list(scores.values())))


def test_gradient_leads_to_the_maximum():
    rng = np.random.default_rng(1)
    rows = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(400)]
    grades = np.array([min(2, int(0 in r) + int(1 in r)) if rng.random() < 0.9 else rng.integers(3) for r in rows])
    weights, cuts = toxicity.fit_ordinal(rows, grades, 6)
    assert weights[0] > 1 and weights[1] > 1 and np.abs(weights[2:]).max() < 1 and cuts[0] < cuts[1]

    def loss(w, c):
        total = np.array([w[r].sum() for r in rows])
        over = np.vstack([np.ones(400), *[1 / (1 + np.exp(x - total)) for x in c], np.zeros(400)])
        return -np.log(over[grades, range(400)] - over[grades + 1, range(400)]).sum() + toxicity.RIDGE * (w**2).sum()

    best = loss(weights, cuts)
    for _ in range(40):
        assert loss(weights + rng.normal(0, 0.3, 6), cuts + rng.normal(0, 0.1, 2)) > best - 0.05


def plain_model(rows, marks):
    """The model from all texts at once: (id, text) rows, grades by id."""
    sample = [(zlib.crc32(str(i).encode()) % 2, marks[i], dict(toxicity.counted(t)), len((t or "").split())) for i, t in rows if i in marks]

    def z_scores(part):
        bad, good = [f for _, y, f, _ in part if y], [f for _, y, f, _ in part if not y]
        a, b = (Counter(x for f in kind for x in f) for kind in (bad, good))
        out = {}
        for f in set(a) | set(b):
            odds = math.log((a[f] + 0.5) / (len(bad) - a[f] + 0.5)) - math.log((b[f] + 0.5) / (len(good) - b[f] + 0.5))
            out[f] = odds / math.sqrt(1 / (a[f] + 0.5) + 1 / (len(bad) - a[f] + 0.5) + 1 / (b[f] + 0.5) + 1 / (len(good) - b[f] + 0.5))
        return out

    texts = Counter(f for _, _, x, _ in sample for f in x)
    whole, halves = z_scores(sample), [z_scores([x for x in sample if x[0] == h]) for h in (0, 1)]
    strong = sorted((f for f in whole if texts[f] >= toxicity.LEAST_TEXTS and abs(whole[f]) >= toxicity.LEAST_Z), key=lambda f: (-abs(whole[f]), f))
    lean = [{f for f, z in half.items() if texts[f] >= toxicity.LEAST_TEXTS and z >= toxicity.LEAST_Z and not f.endswith("~")} for half in halves]
    share = np.array([sum(n for f, n in x.items() if f in lean[1 - h]) / max(1, tokens) for h, _, x, tokens in sample])
    grades = np.array([y for _, y, _, _ in sample])
    if grades.max() < 2:
        grades = grades + ((grades == 1) & (share > np.median(share[grades == 1])))
    weights, cuts = toxicity.fit_ordinal([np.array(sorted(strong.index(f) for f in x if f in strong), np.int64) for _, _, x, _ in sample], grades, len(strong))
    return dict(zip(strong, weights)), np.array([*cuts, 500.0][:2]), grades


def toxic_table(rng, n=240):
    """Texts with none, one or several of three toxic words in two forms."""
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(60)]
    out = []
    for i in range(n):
        bad = rng.choice([0, 0, 0, 1, 2, 3, 5])
        out.append((i, " ".join(rng.sample(rng.choices(words, k=30) + rng.choices(["vileword", "vilewords", "crudest!"], k=bad), 30 + bad)), bad))
    return out


@pytest.mark.parametrize("graded", [False, True])
def test_learning_equals_the_plain_version(spark, graded):
    rows = toxic_table(random.Random(11))
    marks = {i: (bad > 0) + (graded and bad > 1) for i, _, bad in rows}
    model = toxicity.fit(docs(spark, [(i, t) for i, t, _ in rows]), labels(spark, [(i, 1, int(y)) for i, y in marks.items()]))
    weights, cuts, grades = plain_model([(i, t) for i, t, _ in rows], {i: int(y) for i, y in marks.items()})
    assert model.weights.keys() == weights.keys() and "vileword" in weights and (grades == 2).sum() > 10
    assert model.cuts == pytest.approx(cuts, rel=1e-6)
    assert [model.weights[f] for f in weights] == pytest.approx(list(weights.values()), rel=1e-6, abs=1e-9)
    for i, text, _ in rows[:20]:
        total = sum(weights[f] for f, _ in toxicity.counted(text) if f in weights)
        assert model.above(sum(model.weights[f] for f, _ in toxicity.counted(text) if f in model.weights)) == pytest.approx(1 / (1 + np.exp(cuts - total)), rel=1e-5, abs=1e-9)


def test_query_equals_the_plain_version(spark, sf):
    from strataquery.llm.queries import op7_toxicity

    frame = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    weights, cuts, _ = plain_model(sorted(frame.items()), marks)
    for r in op7_toxicity(spark, sf).collect():
        total = sum(weights[f] for f, _ in toxicity.counted(frame[r["doc_id"]]) if f in weights)
        above = 1 / (1 + np.exp(cuts - total))
        assert r["score"] == pytest.approx(above[0], abs=1e-4) and r["expected_severity"] == pytest.approx(above.sum(), abs=1e-4)


@pytest.mark.parametrize("token,want", [("It's/BAD_word...", {"it", "s", "bad", "word", "word~"}), ("a" * 50, {"aaaa~", "aaaaa~", "aaaaaa~"}), ("...", set()), ("idiot-like", {"idiot", "idio~", "idiot~", "like", "like~"})])
def test_features_of_a_token(token, want):
    assert set(toxicity.features(token)) == want


def test_toxic_held_out_texts(spark):
    frame, marks = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(frame, marks.where(~qda_quality.held_out(F.col("doc_id"))))
    got = frame.join(marks, "doc_id").where(qda_quality.held_out(F.col("doc_id"))).select("toxic", "lang", toxicity.severity(F.col("text"), model).alias("s")).collect()
    assert np.mean([r["toxic"] == (r["s"]["p_toxic"] >= 0.5) for r in got]) > 0.9  # all languages
    for r in got:
        s = r["s"]
        assert 0 <= s["p_strong"] <= s["p_toxic"] <= 1 and s["severity"] == pytest.approx(s["p_toxic"] + s["p_strong"])
    mean = [np.mean([r["s"]["severity"] for r in got if r["toxic"] == c]) for c in (0, 1)]
    assert mean[1] > 3 * mean[0]


def test_repeated_ids_are_one_training_row(spark):
    rows = toxic_table(random.Random(12))
    marks = [(i, 1, int(bad > 0)) for i, _, bad in rows]
    plain = [(i, t) for i, t, _ in rows]
    once = toxicity.fit(docs(spark, plain), labels(spark, marks))
    assert once.weights == pytest.approx(toxicity.fit(docs(spark, plain + plain + [(0, "zzz " + plain[0][1])]), labels(spark, marks + marks)).weights)


def test_toxicity_of_odd_rows(spark):
    rng = random.Random(0)
    words = ["".join(rng.choices("abcdef", k=5)) for _ in range(50)]
    rows = [(i, " ".join(rng.choices(words, k=30)) + (" Vileword!" * (i % 4) if i % 2 else "")) for i in range(80)]
    odd = [(None, "vileword"), (200, None), (201, ""), (202, "x " * 50_000 + "vilewords"), (3, rows[3][1])]
    frame = docs(spark, rows + odd)
    marks = labels(spark, [(i, 1, i % 2) for i in range(80)] + [(None, 0, 1), (5, 1, None), (6, 1, 9)])
    got = {r["text"]: r["t"] for r in toxicity.grade_documents(frame, marks, into="t").collect()}
    assert got["vileword"]["p_toxic"] > 0.5 and got["x " * 50_000 + "vilewords"]["p_toxic"] > 0.3
    assert got[None] == got[""] and got[""]["p_toxic"] < 0.5
    assert toxicity.grade_documents(frame.limit(0), marks).count() == 0
    for some, value in (([], 0), ([(1, 1, 1)], 1), ([(1, 1, 0)], 0)):
        out = toxicity.grade_documents(frame, labels(spark, some), into="t").select("t.p_toxic").distinct().collect()
        assert [round(r[0]) for r in out] == [value]


def test_toxicity_query(spark, sf):
    from strataquery.llm.queries import op7_toxicity

    rows = op7_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op7_toxicity(spark, sf).collect()))
