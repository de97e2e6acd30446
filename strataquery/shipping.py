"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_MARK = "_strataquery_shipped"


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application.

    Spark's own file server carries the archive, so executors need no folder in
    common with the driver.
    """
    context = spark.sparkContext
    if getattr(context, _MARK, False):
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="strataquery-")) / "strataquery.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as file:
        for source in sorted(top.rglob("*.py")):
            file.write(source, source.relative_to(top.parent).as_posix())
    context.addPyFile(str(archive))
    setattr(context, _MARK, True)
