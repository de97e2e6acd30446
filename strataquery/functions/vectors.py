"""Vector functions. Components become doubles before any product."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from strataquery.shipping import ship


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector has length 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalized(vector: Column) -> Column:
    return F.transform(doubles(vector), lambda x: F.try_divide(x, norm(vector)))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is 1, scaled to unit length; array of arrays in, array out."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda p: p["m"] == 1), lambda p: p["v"].cast("array<double>"))
    total = F.aggregate(F.slice(kept, 2, 1 << 30), F.get(kept, F.lit(0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    length = F.sqrt(F.aggregate(total, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(total, lambda x: F.try_divide(x, length))


def valid_probe(vector: Column, width: int) -> Column:
    """Width, finite components, and a length near 1."""
    finite = F.forall(doubles(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == width) & finite & norm(vector).between(0.9, 1.1), F.lit(False))


def half_precision(vector: Column) -> Column:
    """Components rounded to 16-bit floats, as a store of half floats returns them."""
    ship(SparkSession.active())

    @F.arrow_udf("array<float>")
    def rounded(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            values = part.flatten().to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float32)
            lengths = np.array([0 if x is None else len(x) for x in part.to_pylist()])
            at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(at), pa.array(values), mask=part.is_null()) if part.null_count else pa.ListArray.from_arrays(pa.array(at), pa.array(values))

    return rounded(vector)


def hashed_words(text: str, width: int) -> np.ndarray:
    """Signed counts of hashed words, scaled to unit length."""
    marks = np.array([zlib.crc32(w.encode()) for w in re.findall(r"[^\W_]+", text.lower())], dtype=np.int64)
    counts = np.bincount(marks % width, np.where(marks >> 31, -1.0, 1.0), minlength=width)
    length = np.sqrt(counts @ counts)
    return counts / length if length else counts


def hash_embedding(text: Column, width: int = 64) -> Column:
    """Deterministic stand-in for a model, for want of one: ``hashed_words`` as floats."""
    ship(SparkSession.active())

    @F.arrow_udf("array<float>")
    def embed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([hashed_words(x or "", width).astype(np.float32) for x in part.to_pylist()], pa.list_(pa.float32()))

    return embed(text)
