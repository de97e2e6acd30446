"""Arithmetic of runs, budgets and gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MEBIBYTE = 1 << 20


def rate_per_second(count: Column, duration_ms: Column) -> Column:
    """Null for a duration of 0."""
    return F.try_divide(count.cast("double") * 1000, duration_ms.cast("double"))


def progress_fraction(seen: Column, total: Column) -> Column:
    """Share done, 1 at most; null without a total."""
    return F.least(F.lit(1.0), F.try_divide(seen.cast("double"), total.cast("double")))


def token_budget(memory_bytes: Column, max_tokens: int = 1024, base: int = 4096, most_times: int = 8) -> Column:
    """Padded tokens of a batch that a memory ceiling supports: ``base`` for 2 GiB, in proportion, ``most_times`` that at most, one window at least."""
    scaled = F.floor(F.lit(base) * F.greatest(memory_bytes, F.lit(0)) / F.lit(float(2 << 30)))
    return F.greatest(F.lit(max_tokens), F.least(scaled, F.lit(base * most_times))).cast("long")


def length_bucket(tokens: Column) -> Column:
    """Bits that the number has; texts of one bucket are padded together."""
    return F.when(tokens > 0, F.length(F.bin(tokens))).otherwise(0).cast("int")


def crossover(extra_load: Column, slow_rate: Column, fast_rate: Column) -> Column:
    """Size from which the faster backend repays its load; null if it never does."""
    gain = F.try_divide(F.lit(1.0), slow_rate) - F.try_divide(F.lit(1.0), fast_rate)
    return F.when(gain > 0, F.greatest(F.lit(0.0), extra_load) / gain)


def memory_ceiling(configured: Column, available: Column, reserve: int = 512 * MEBIBYTE) -> Column:
    return F.least(configured, F.greatest(available - reserve, F.lit(0)))


def backoff(delay: Column, cap: Column) -> Column:
    return F.least(delay * 2, cap)


def elapsed_ms(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", start, end)


def gate(metric: Column, floor: float) -> Column:
    """A metric that is missing fails its gate."""
    return F.coalesce(metric >= floor, F.lit(False))
