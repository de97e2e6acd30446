"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.shared import cut_lineage  # noqa: F401  the operators take it from here
from strataquery.shipping import ship

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most rows of a few longs that are broadcast.
BROADCAST_ROWS = 1 << 18


def narrow(df: DataFrame) -> bool:
    """Whether ``df`` has ``BROADCAST_ROWS`` rows at most."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def bounded_broadcast(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it is ``narrow``. Its rows must be a few longs and cheap to count."""
    return F.broadcast(df) if narrow(df) else df


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Catalyst may copy an expression into each place that names it, in a lambda
    once per element. The variable of a lambda is never copied.
    """
    return F.transform(F.array(value), body)[0]


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Bytes of rows that go to a Python worker at once. The buffers for them lie outside the heap of the JVM,
#: once or twice in each direction, and again in the worker.
BATCH_BYTES = 2 << 20


def prepare_workers(spark: SparkSession) -> None:
    """Let workers import this package, and bound the batches that they get in this session."""
    ship(spark)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(setting))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))


def arrow_udf(returns: str):
    """``functions.arrow_udf`` for functions of this package."""
    prepare_workers(SparkSession.active())
    return F.arrow_udf(returns)


def packed(df: DataFrame) -> DataFrame:
    """All columns of ``df`` as one struct ``row``, so that no name of theirs clashes with a helper's."""
    return df.select(F.struct(*[col(c) for c in df.columns]).alias("row"))


def field(name: str) -> Column:
    """A column of a packed row."""
    return F.col("row").getField(name)


def unpacked(names: list[str], results: tuple[str, ...] = ()) -> list[Column]:
    """Columns of a packed row by name; results take the place of columns that have their names."""
    taken = {r.lower() for r in results}
    return [field(c).alias(c) for c in names if c.lower() not in taken]
