"""Toxicity by cumulative-link ordinal regression (operator 7).

Severity has three ordered grades: 0 clean, 1 toxic, 2 strongly toxic. Labels
may give all three. Labels that only tell toxic from clean leave the upper two
to be set: a toxic training text has grade 2 if the share of its words that
lean toxic is above the toxic texts' median. Which words lean so is learned
from the other half of the training texts (halves by CRC-32 of the id), never
from the text's own, and the share counts occurrences, which the model below
doesn't see. So grade 2 is a matter of density; nobody labelled it. Where no
text is above the median nothing is strongly toxic.

The model is P(grade > k) = logistic(w x - cut_k) with one weight vector for
all cuts and rising cuts. x holds sparse features: whole words and their first
4, 5 and 6 letters, lower-cased, each present or absent, since stems carry
inflections; a word is a run of letters and digits, and one of more than 40
has stems only. Features are chosen by counts over the training sample (at
least ``LEAST_TEXTS`` texts, log odds of at least ``LEAST_Z`` standard errors,
the ``FEATURES`` strongest) and weighed by the regularised fit, so driver
memory is bounded by ``SAMPLE_ROWS`` and ``FEATURES`` whatever the input. Texts
are scored whole. ``RIDGE``, and that no size of the odds is asked for, were
chosen by cross-validation inside the learning rows (README).

``SAMPLE_ROWS`` bounds the labelled ids that are learned from: those with the
smallest MD5. An id that several documents have gives one row, the smallest
text; one that several labels have gets the highest.

Defined results: null and empty texts have no features and get the severity of
none. Label rows with a null id or another label than 0, 1 and 2 are left out.
Without toxic or without clean rows every severity is 0 or 1 by the class
that there is, 0 without any. Equal texts get equal results. Very long texts
are read whole. Other columns pass through untouched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquery.llm.common import arrow_udf, col, cut_lineage, prepare_workers

SAMPLE_ROWS = 20_000
FEATURES = 4096
LEAST_TEXTS = 4
LEAST_Z = 3.0
STEMS = (4, 5, 6)
RIDGE = 0.02
#: Distinct tokens whose features a worker remembers.
KEPT = 300_000


_PARTS = re.compile(r"[^\W_]+")


def features(token: str) -> tuple[str, ...]:
    """Features of one token: its words, and their stems."""
    found = []
    for word in _PARTS.findall(token.lower()):
        found += [word] * (len(word) <= 40) + [word[:n] + "~" for n in STEMS if len(word) >= n]
    return tuple(found)


def counted(text: str | None) -> list[tuple[str, int]]:
    """Features of a text and how often they stand there, in order."""
    found: Counter[str] = Counter()
    for token, n in Counter((text or "").split()).items():
        for f in features(token):
            found[f] += n
    return sorted(found.items())


@dataclass(frozen=True)
class Ordinal:
    """Weights by feature, and the rising cuts between grades."""

    weights: dict[str, float]
    cuts: tuple[float, ...]

    def above(self, total: float) -> list[float]:
        """P(grade > k) for each k."""
        return [float(1 / (1 + np.exp(-np.clip(total - c, -500, 500)))) for c in self.cuts]


class _Words(dict):
    """Chosen features of each token; bounded."""

    def __init__(self, chosen: dict[str, float]):
        super().__init__()
        self._chosen = chosen

    def __missing__(self, token):
        value = tuple(f for f in features(token) if f in self._chosen)
        if len(self) >= KEPT:
            self.clear()
        if len(token) <= 48:
            self[token] = value
        return value


def present(text: str | None, known: _Words) -> set[str]:
    """Chosen features that a whole text has."""
    found: set[str] = set()
    for some in map(known.__getitem__, set((text or "").split())):
        found.update(some)
    return found


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, width: int, ridge: float = RIDGE, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts that maximise the likelihood less ``ridge`` times the squared weights (Adam, full batch, steps that shrink).

    ``rows``: feature numbers of each text. The second cut is the first plus an
    exponential, so cuts rise.
    """
    flat = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    levels = int(grades.max())
    params = np.zeros(width + levels)
    params[width] = 1.0
    first, second = np.zeros_like(params), np.zeros_like(params)
    n = len(rows)
    logistic = lambda v: 1 / (1 + np.exp(-np.clip(v, -60, 60)))
    for step in range(1, steps + 1):
        w, raw = params[:width], params[width:]
        cuts = np.cumsum(np.concatenate([raw[:1], np.exp(np.clip(raw[1:], -10, 10))]))
        total = np.bincount(owner, w[flat], minlength=n)
        over = np.vstack([np.ones(n), *[logistic(total - c) for c in cuts], np.zeros(n)])  # P(grade >= k)
        slope = over * (1 - over)
        here = np.arange(n)
        chance = np.maximum(over[grades, here] - over[grades + 1, here], 1e-12)
        by_total = (slope[grades, here] - slope[grades + 1, here]) / chance
        by_cut = np.array([(np.where(grades == k, slope[k], 0) - np.where(grades == k - 1, slope[k], 0)) @ (-1 / chance) for k in range(1, levels + 1)])
        tails = np.cumsum(by_cut[::-1])[::-1]
        gradient = np.concatenate([np.bincount(flat, by_total[owner], minlength=width) - 2 * ridge * w, tails[:1], tails[1:] * np.exp(np.clip(raw[1:], -10, 10))])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        params = params + 0.1 * (1 - step / (steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    raw = params[width:]
    return params[:width], np.cumsum(np.concatenate([raw[:1], np.exp(np.clip(raw[1:], -10, 10))]))


def _leaning(bad: Column, good: Column, all_bad: int, all_good: int) -> tuple[Column, Column]:
    """Smoothed log odds of a feature, and their standard errors."""
    odds = F.log((bad + 0.5) / (all_bad - bad + 0.5)) - F.log((good + 0.5) / (all_good - good + 0.5))
    return odds, odds / F.sqrt(1 / (bad + 0.5) + 1 / (all_bad - bad + 0.5) + 1 / (good + 0.5) + 1 / (all_good - good + 0.5))


def _sample(documents: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, sample_rows: int) -> DataFrame:
    """row, y, half, tokens and features of each training text."""
    marked = labels.select(col(doc_id).alias("id"), col(label).cast("int").alias("y")).where("y in (0, 1, 2) and id is not null").groupBy("id").agg(F.max("y").alias("y"))
    chosen = marked.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(sample_rows)
    texts = documents.select(col(doc_id).alias("id"), col(text).alias("text")).join(F.broadcast(chosen), "id")  # sample_rows rows at most
    texts = texts.groupBy("id", "y").agg(F.min("text").alias("text"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("f", pa.string()), ("n", pa.int32())]))
        for batch in batches:
            bodies = batch.column(2).to_pylist()
            found = [[{"f": f, "n": n} for f, n in counted(x)] for x in bodies]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len((x or "").split()) for x in bodies], pa.int64()), pa.array(found, kind)], names=["y", "half", "tokens", "features"])

    half = (F.crc32(F.col("id").cast("string").cast("binary")) % 2).cast("int").alias("half")
    slim = texts.select("y", half, "text").mapInArrow(measured, "y int, half int, tokens long, features array<struct<f: string, n: int>>")
    return cut_lineage(slim.withColumn("row", F.monotonically_increasing_id()))


def fit(documents: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, most: int = FEATURES) -> Ordinal:
    """Learn from a bounded sample of the labelled rows."""
    spark = documents.sparkSession
    prepare_workers(spark)
    texts = _sample(documents, labels, text, doc_id, label, sample_rows)
    sizes = {(r["bad"], r["half"]): r["n"] for r in texts.groupBy((F.col("y") > 0).alias("bad"), "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = ([sizes.get((kind, h), 0) for h in (0, 1)] for kind in (True, False))
    if not sum(bad) or not sum(good):
        return Ordinal({}, (500.0, 500.0) if not sum(bad) else (-500.0, 500.0))
    each = texts.select("row", "y", "half", "tokens", F.explode("features").alias("x")).select("row", "y", "half", "tokens", "x.f", "x.n")
    counts = each.groupBy("f").agg(*[F.count_if((F.col("half") == h) & ((F.col("y") > 0) == kind)).alias(f"{c}{h}") for h in (0, 1) for c, kind in (("a", True), ("b", False))])
    odds, z = _leaning(F.col("a0") + F.col("a1"), F.col("b0") + F.col("b1"), sum(bad), sum(good))
    halves = [_leaning(F.col(f"a{h}"), F.col(f"b{h}"), bad[h], good[h])[1] for h in (0, 1)]
    leans = [(F.col(z) >= LEAST_Z) & ~F.endswith("f", F.lit("~")) for z in ("z0", "z1")]
    found = counts.where(F.col("a0") + F.col("a1") + F.col("b0") + F.col("b1") >= LEAST_TEXTS).select("f", z.alias("z"), halves[0].alias("z0"), halves[1].alias("z1"))
    found = cut_lineage(found.select("f", "z", leans[0].alias("lean0"), leans[1].alias("lean1")).where((F.abs("z") >= LEAST_Z) | F.col("lean0") | F.col("lean1")))
    strong = found.where(F.abs("z") >= LEAST_Z).orderBy(F.abs("z").desc(), "f").limit(most).collect()
    if not strong:
        share = sum(bad) / (sum(bad) + sum(good))
        return Ordinal({}, (float(np.log(1 / share - 1)), 500.0))
    number = {r["f"]: i for i, r in enumerate(strong)}
    lean = found.where("lean0 or lean1").orderBy(F.abs("z").desc(), "f").limit(most).collect()
    flags = {r["f"]: (r["lean0"], r["lean1"]) for r in lean}
    names = spark.createDataFrame([(f, number.get(f), *flags.get(f, (False, False))) for f in {**number, **flags}], "f string, i int, lean0 boolean, lean1 boolean")
    toxic_words = F.when(F.when(F.col("half") == 0, F.col("lean1")).otherwise(F.col("lean0")), F.col("n")).otherwise(0)
    known = each.join(F.broadcast(names), "f").groupBy("row").agg(F.collect_list("i").alias("x"), F.sum(toxic_words).alias("hits"))  # twice FEATURES names at most
    sets = texts.select("row", "y", "tokens").join(known, "row", "left").orderBy("row").collect()
    rows = [np.array(sorted(r["x"] or []), np.int64) for r in sets]
    grades = np.array([r["y"] for r in sets])
    if grades.max() < 2:
        share = np.array([(r["hits"] or 0) / max(1, r["tokens"]) for r in sets])
        grades = grades + ((grades == 1) & (share > np.median(share[grades == 1])))
    weights, cuts = fit_ordinal(rows, grades, len(strong))
    return Ordinal({r["f"]: float(w) for r, w in zip(strong, weights)}, (*(float(c) for c in cuts), 500.0)[:2])


def severity(text: Column, model: Ordinal) -> Column:
    """Struct of p_toxic, p_strong, the expected severity and the likeliest grade."""

    @arrow_udf("struct<p_toxic: double, p_strong: double, severity: double, grade: int>")
    def grade(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Words(model.weights)
        for part in parts:
            over = np.array([model.above(sum(model.weights[f] for f in sorted(present(x, known)))) for x in part.to_pylist()]).reshape(len(part), len(model.cuts))
            steps = np.hstack([np.ones((len(part), 1)), over, np.zeros((len(part), 1))])
            likeliest = np.argmax(steps[:, :-1] - steps[:, 1:], axis=1).astype(np.int32)
            yield pa.StructArray.from_arrays([pa.array(over[:, 0]), pa.array(over[:, 1]), pa.array(over.sum(axis=1)), pa.array(likeliest)], names=["p_toxic", "p_strong", "severity", "grade"])

    return grade(text)


def grade_documents(df: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", into: str = "toxicity", **options) -> DataFrame:
    """``df`` with the struct ``into`` of ``severity``."""
    return df.withColumn(into, severity(col(text), fit(df, labels, text=text, doc_id=doc_id, **options)))
