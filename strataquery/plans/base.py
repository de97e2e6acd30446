"""Registration of queries beside the SQL that checks them."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from strataquery.operators.textindex import TextIndex
from strataquery.shared import shared_folder
from strataquery.sources.hadoop import Folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (tables) -> DataFrame under its name."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = build.__name__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql.strip()
        return build

    return register


class Tables:
    """Tables of one folder, read as they are asked for: ``tables.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def text_index(self) -> TextIndex:
        """The index of the documents' texts. It is built when it is first asked for, and again if the table has changed."""
        path = f"{self.folder}/documents.parquet"
        table, shared = Folder(self.spark, path), Folder(self.spark, f"{_shared(self.spark)}/text-index")
        note = f"{hashlib.sha256(f'{path} {table.size('')} {table.changed('')}'.encode()).hexdigest()[:32]}.json"
        if shared.read_json(note) is None:
            name = uuid.uuid4().hex
            TextIndex.build(self.documents, shared.at(name), key="doc_id", text="text", facets=["source", "lang"])
            shared.write_json(note, {"folder": name})
        return TextIndex(self.spark, shared.at(shared.read_json(note)["folder"]))


@lru_cache(maxsize=8)
def _shared(spark: SparkSession) -> str:
    return shared_folder(spark)
