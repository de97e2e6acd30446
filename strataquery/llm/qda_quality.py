"""Quality classifier by regularised quadratic discriminant analysis (operator 8).

Each text becomes a few transformed statistics of its bytes and words.
For each class the mean and a covariance shrunk towards a multiple of the
identity are learned; the score is the logistic of the difference of the
classes' log densities (Mahalanobis distances through cached inverse Cholesky
factors) plus the log prior odds.

Learning takes all labelled rows that it is given: tasks send sums and cross
products of the statistics, two small rows each, so the driver's work doesn't
grow with the documents. Ids, languages, sources and labels are never inputs
of a score.

Defined results: null text counts as empty; the empty text has a score like
any other. Label rows with a null id or a label other than 0 and 1 are left
out; a repeated label counts as often as it stands there. If a class has no
row, every score is the share of class 1 among the labelled rows (0.5 without
any). Equal texts have equal scores. Texts are read whole, whatever their
length. Other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquery.llm.common import arrow_udf, col, narrow

SHRINKAGE = 0.3
STATISTICS = 8
#: Words that damp the share of repeated ones, which says little in short texts.
DAMPING = 20

_KINDS = np.zeros((5, 256))
for _row, _members in enumerate((b"#*$%&|<>", bytes(range(65, 91)), b"!?", b".,;:'\"()-", b"0123456789")):
    _KINDS[_row, list(_members)] = 1


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one text; square roots and logarithms tame long tails."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    kinds = _KINDS @ np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = len(data) + 1.0
    n = len(words)
    shares = np.sqrt(kinds / size)
    return [*shares.tolist(), np.log1p(size / (n + 1.0)), ((n - len(set(words))) / (n + DAMPING)) ** 0.5, np.log1p(n) ** 0.5]


def statistics_of(text: Column) -> Column:
    @arrow_udf("array<double>")
    def measure(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([statistics(x) for x in part.to_pylist()], pa.list_(pa.float64()))

    return measure(text)


@dataclass(frozen=True)
class Quadratic:
    """One inverse Cholesky factor, mean and log determinant a class; log prior odds of class 1."""

    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray
    odds: float
    constant: float | None = None

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(rows), self.constant)
        density = []
        for mean, factor, logdet in zip(self.means, self.factors, self.logdets):
            z = (rows - mean) @ factor.T
            density.append(-0.5 * np.einsum("ij,ij->i", z, z) - logdet)
        logit = np.clip(density[1] - density[0] + self.odds, -500, 500)
        return 1 / (1 + np.exp(-logit))


def learned(sums: dict[int, tuple[int, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE) -> Quadratic:
    """Model from each class's row count, sum and sum of outer products."""
    counts = [sums[c][0] if c in sums else 0 for c in (0, 1)]
    if min(counts) == 0:
        return Quadratic(np.empty(0), np.empty(0), np.empty(0), 0.0, counts[1] / sum(counts) if sum(counts) else 0.5)
    means, factors, logdets = [], [], []
    for c in (0, 1):
        n, total, outer = sums[c]
        mean = total / n
        spread = outer / n - np.outer(mean, mean)
        d = len(mean)
        spread = (1 - shrinkage) * spread + (shrinkage * np.trace(spread) / d + 1e-6) * np.eye(d)
        root = np.linalg.cholesky(spread)
        means.append(mean)
        factors.append(np.linalg.inv(root))
        logdets.append(float(np.log(np.diag(root)).sum()))
    return Quadratic(np.array(means), np.array(factors), np.array(logdets), float(np.log(counts[1] / counts[0])))


def fit(documents: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", shrinkage: float = SHRINKAGE) -> Quadratic:
    """Learn from the documents whose id is in ``labels`` (doc_id and the label column)."""
    marked = labels.select(col(doc_id).alias("id"), col(label).cast("int").alias("y")).where("y in (0, 1) and id is not null")
    texts = documents.select(col(doc_id).alias("id"), col(text).alias("text"))
    if narrow(marked):  # only labelled texts are measured, where they are read
        rows = texts.join(F.broadcast(marked), "id").select("y", statistics_of(F.col("text")).alias("x"))
    else:
        rows = texts.select("id", statistics_of(F.col("text")).alias("x")).join(marked, "id").select("y", "x")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            for c in np.unique(y):
                own = x[y == c]
                n, total, outer = sums.get(c, (0, 0.0, 0.0))
                sums[c] = (n + len(own), total + own.sum(axis=0), outer + own.T @ own)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(c) for c in sums], pa.int32()),
                pa.array([v[0] for v in sums.values()], pa.int64()),
                pa.array([v[1] for v in sums.values()], pa.list_(pa.float64())),
                pa.array([v[2].ravel() for v in sums.values()], pa.list_(pa.float64())),
            ],
            names=["y", "n", "total", "squares"],
        )

    sums: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for r in rows.mapInArrow(partial, "y int, n long, total array<double>, squares array<double>").collect():
        total = np.array(r["total"])
        n, t, o = sums.get(r["y"], (0, np.zeros(len(total)), np.zeros((len(total), len(total)))))
        sums[r["y"]] = (n + r["n"], t + total, o + np.array(r["squares"]).reshape(len(total), -1))
    return learned(sums, shrinkage)


def score(text: Column, model: Quadratic) -> Column:
    """Probability of class 1 for each whole text."""

    @arrow_udf("double")
    def judge(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            rows = np.array([statistics(x) for x in part.to_pylist()]).reshape(len(part), STATISTICS)
            yield pa.array(model.scores(rows))

    return judge(text)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: a third of all ids, by CRC-32; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(df: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``df`` with score (double), fitted on the labelled rows of ``df`` that aren't held out."""
    model = fit(df.where(~held_out(col(doc_id))), labels, text=text, doc_id=doc_id)
    return df.withColumn("score", score(col(text), model))
