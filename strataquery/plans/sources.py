"""Queries of extraction and of the versioned store, over literal sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquery.plans.base import Tables, query
from strataquery.shared import shared_folder
from strataquery.sources import extract
from strataquery.sources.store import PartitionStore

_PYTHON = b"""import os.path as p
from .tools import helper as h, other

class Base:
    def run(self, x, *, flag=False):
        return h(x)

class Child(Base):
    def run(self, x, *, flag=True):
        self.value = other(x, 1, key=2)
        return p.join("a", *x)
"""
_SCRIPT = b"""import fallback, { load as read, store } from './disk';
export * from './more';
export class Reader extends Base {
  open(name, { mode }, ...rest) { return read(name, mode); }
}
export default function main(x) { return new Reader().open(x); }
"""


def _parsed(t: Tables) -> DataFrame:
    files = [("f1", "demo", "pkg/child.py", "python", _PYTHON), ("f2", "demo", "src/reader.ts", "typescript", _SCRIPT), ("f3", "demo", "bad.py", "python", b"def broken(:"), ("f4", "demo", "x.py", "python", b"a\0b")]
    return extract.extract(t.spark.createDataFrame(files, "file_id string, project_id string, path string, language string, content binary"))


@query()
def python_extract(t: Tables) -> DataFrame:
    rows = extract.reference_rows(_parsed(t))
    return rows.select("path", "record_kind", "kind", "target_name", "written_name", "module_path", "imported_name", "alias", "receiver_text", "source_qualified_symbol", "start_byte", "end_byte", "start_line")


@query()
def chunk_extract(t: Tables) -> DataFrame:
    return extract.chunk_rows(_parsed(t), "slot").select("chunk_id", "path", "kind", "symbol", "qualified_symbol", "parent_symbol", "start_line", "end_line", "identifier_terms")


_SLIM = {"files": "file_id string, size long", "chunks": "file_id string, chunk_id string"}


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS file_id, l_orderkey || ':' || l_linenumber AS chunk_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = 'P')
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), o_orderkey || ':new' FROM orders WHERE o_orderpriority = '1-URGENT'""")
def store_commit(t: Tables) -> DataFrame:
    """Two commits to a fresh partition, then a read of the live version."""
    store = PartitionStore(t.spark, f"{shared_folder(t.spark)}/store-{id(t)}-{t.spark.range(1).select(F.uuid()).first()[0]}", _SLIM)
    files = t.orders.select(F.col("o_orderkey").cast("string").alias("file_id"), F.col("o_custkey").alias("size"))
    chunks = t.lineitem.select(F.col("l_orderkey").cast("string").alias("file_id"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("chunk_id"))
    store.commit({"files": files, "chunks": chunks})
    replaced = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").cast("string").alias("file_id"), F.col("o_custkey").alias("size"))
    removed = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").cast("string").alias("file_id"))
    store.commit({"files": replaced, "chunks": replaced.select("file_id", F.concat_ws(":", "file_id", F.lit("new")).alias("chunk_id"))}, replaced=replaced, removed=removed)
    return store.read("chunks")
