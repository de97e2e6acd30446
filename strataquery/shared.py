"""The folder that driver and executors share, and tables that cut lineage there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from strataquery.errors import EngineError


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a temporary folder, but only if everything runs on this machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise EngineError("INVALID_CONFIGURATION", "set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="strataquery-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def unbroadcast(df: DataFrame) -> DataFrame:
    """``df`` for a join that sorts and merges. Spark guesses sizes from compressed files and without what ``explode`` adds, and would send tables to the driver that it can't hold."""
    return df.hint("merge")
