"""Queries of reference resolution over structural rows that grow with ``part``.

Each part is one small source file. Its key decides what it imports and calls,
so the SQL can tell by arithmetic what resolution has to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquery.operators import references
from strataquery.plans.base import Tables, query

_FIELDS = [f.split(" ") for f in references.SCHEMA.split(", ")]


def _row(**values) -> Column:
    """One structural row; what isn't named is null."""
    values = {"record_kind": "reference", "language": "python", "project_id": "demo", "schema_version": references.GENERATION, "file_id": values["path"]} | values
    column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(*[column(values.get(name)).cast(kind).alias(name) for name, kind in _FIELDS])


def _rows(keys: DataFrame, *rows: Column) -> DataFrame:
    return keys.select(F.explode(F.filter(F.array(*rows), lambda r: r["path"].isNotNull())).alias("r")).select("r.*")


def _keys(t: Tables) -> DataFrame:
    return t.part.where("p_partkey > 0").select(F.col("p_partkey").cast("long").alias("k"))


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _uses(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Eight kinds of files that use ``load`` of lib/a.py, by the key's remainder."""
    k = F.col("k")
    kind, path = k % 8, _text("u", k, ".py")
    when = lambda n, v: F.when(kind == n, v)
    module = F.when(kind.isin(0, 1, 4), "lib.a").when(kind == 2, "p").when(kind == 3, "elsewhere")
    imported = F.when(kind.isin(0, 2, 3), "load").when(kind == 4, "*")
    alias = when(0, _text("l", k)).when(kind == 1, _text("x", k))
    written = when(0, _text("l", k)).when(kind == 7, _text("other", k)).otherwise("load")
    receiver = when(1, _text("x", k)).when(kind == 5, "thing")
    uses = _rows(
        _keys(t),
        _row(reference_id=_text("i", k), path=F.when(kind < 5, path), kind="import", module_path=module, imported_name=imported, alias=alias, start_line=k, start_byte=0),
        _row(reference_id=_text("c", k), path=path, kind="call", written_name=written, target_name=written, receiver_text=receiver, start_line=k, start_byte=1),
        _row(reference_id=_text("o", k), path=F.when(kind == 7, "lib/a.py"), kind="call", written_name="load", target_name="load", start_line=k, start_byte=1),
    )
    one = t.spark.range(1)
    fixed = _rows(
        one,
        _row(reference_id="d1", record_kind="declaration", path="lib/a.py", kind="function", written_name="load", target_name="load"),
        _row(reference_id="d2", record_kind="declaration", path="b.py", kind="function", written_name="load", target_name="load"),
        _row(reference_id="r", path="p/__init__.py", kind="import", module_path="lib.a", imported_name="load"),
    )
    files = _keys(t).select(path.alias("path")).unionByName(one.select(F.explode(F.array(*map(F.lit, ("lib/__init__.py", "lib/a.py", "b.py", "p/__init__.py")))).alias("path")))
    return uses.unionByName(fixed), files


_LOAD = references.Selected("lib/a.py", "lib/a.py", "python", "function", "load", "load")


@query("""
SELECT CASE WHEN p_partkey % 8 = 7 THEN 'lib/a.py' ELSE 'u' || p_partkey || '.py' END AS path, CAST(p_partkey AS BIGINT) AS line,
       ['exact', 'exact', 'exact', 'likely', 'unresolved', 'likely', 'unresolved', 'exact'][p_partkey % 8 + 1] AS resolution,
       ['direct_import_alias', 'known_namespace_member', 'reexport_chain', 'unproven_reexport', 'wildcard_import', 'unknown_receiver', 'ambiguous_symbol', 'same_file_symbol'][p_partkey % 8 + 1] AS reason
FROM part WHERE p_partkey > 0""")
def find_references(t: Tables) -> DataFrame:
    rows, files = _uses(t)
    hits = references.find_references(rows, files, _LOAD).where("kind = 'call'")
    return hits.select("path", F.col("start_line").cast("long").alias("line"), "resolution", "reason")


@query("""
SELECT reason AS code, path FROM (
  SELECT 'u' || p_partkey || '.py' AS path, CASE p_partkey % 8 WHEN 3 THEN 'unproven_reexport' WHEN 4 THEN 'wildcard_import' WHEN 5 THEN 'unknown_receiver' WHEN 6 THEN 'ambiguous_symbol' END AS reason
  FROM part WHERE p_partkey > 0) WHERE reason IS NOT NULL""")
def reference_limitations(t: Tables) -> DataFrame:
    rows, files = _uses(t)
    return references.limitations(references.find_references(rows, files, _LOAD).where("kind = 'call'")).select("code", "path")


@query("""
SELECT CASE WHEN k % 3 = 0 THEN 's' ELSE 'm' END || k AS reference_id,
       CASE WHEN k % 3 = 0 THEN 'web/x' || k || CASE WHEN k % 2 = 0 THEN '/index.ts' ELSE '.ts' END
            ELSE 'pkg' || k % 5 || '/m' || k || CASE WHEN k % 2 = 0 THEN '/__init__.py' ELSE '.py' END END AS target_path
FROM (SELECT p_partkey AS k FROM part WHERE p_partkey > 0)""")
def module_targets(t: Tables) -> DataFrame:
    """Scripts import by relative path; modules by full name from outside their package and by dots from inside."""
    k = F.col("k")
    package, script, even, inside = _text("pkg", k % 5), k % 3 == 0, k % 2 == 0, k % 7 < 3
    imports = _rows(
        _keys(t),
        _row(reference_id=_text("s", k), path=F.when(script, _text("web/u", k, ".ts")), language="typescript", kind="import", module_path=_text("./x", k)),
        _row(reference_id=_text("m", k), path=F.when(~script, F.when(inside, _text(package, "/u", k, ".py")).otherwise(_text("u", k, ".py"))), kind="import", module_path=F.when(inside, _text(".m", k)).otherwise(_text(package, ".m", k))),
    )
    module = _text(package, "/m", k, F.when(even, "/__init__.py").otherwise(".py"))
    paths = F.when(script, F.array(_text("web/u", k, ".ts"), _text("web/x", k, F.when(even, "/index.ts").otherwise(".ts")))).otherwise(F.array(_text("u", k, ".py"), _text(package, "/u", k, ".py"), module, _text(package, "/__init__.py")))
    return references.module_targets(imports, _keys(t).select(F.explode(paths).alias("path")).distinct())


@query(f"SELECT 'i' || p_partkey AS reference_id FROM part WHERE p_partkey > 0 AND p_partkey % 9 < {references.HOPS}")
def reexport_proof(t: Tables) -> DataFrame:
    """Package h0 hands on load of lib.a, h1 that of h0 and so on; each file imports it from one of them."""
    k, hops = F.col("k"), range(9)
    handed = _rows(t.spark.range(1), *[_row(reference_id=f"h{i}", path=f"h{i}/__init__.py", kind="import", module_path=f"h{i - 1}" if i else "lib.a", imported_name="load") for i in hops])
    imports = _rows(_keys(t), _row(reference_id=_text("i", k), path=_text("u", k, ".py"), kind="import", module_path=_text("h", k % 9), imported_name="load"))
    files = _keys(t).select(_text("u", k, ".py").alias("path")).unionByName(handed.select("path")).unionByName(t.spark.range(1).select(F.explode(F.array(F.lit("lib/__init__.py"), F.lit("lib/a.py"))).alias("path")))
    both = imports.unionByName(handed)
    return references.reexport_chains(imports, both, references.module_targets(both, files), _LOAD)


@query("""
WITH RECURSIVE r AS (
  SELECT p_partkey AS k FROM part WHERE p_partkey = 3
  UNION ALL SELECT p_partkey FROM r JOIN part ON p_partkey // 2 = k WHERE p_partkey > 1)
SELECT 'm' || k % 25 || '.py' AS path, 'C' || k || '.run' AS target_name FROM r WHERE k <> 3 AND k % 3 <> 0""")
def override_discovery(t: Tables) -> DataFrame:
    """Class k, in one of 25 files, extends class k div 2 under an alias; two thirds have the method. Each file also has classes that extend an unrelated one of the same name."""
    k = F.col("k")
    file, base = _text("m", k % 25, ".py"), F.expr("k div 2")
    own, up = _text("C", k), _text("C", base)
    rows = _rows(
        _keys(t),
        _row(reference_id=_text("c", k), record_kind="declaration", path=file, kind="class", written_name=own, target_name=own),
        _row(reference_id=_text("r", k), record_kind="declaration", path=F.when((k % 3 != 0) | (k == 3), file), kind="method", written_name="run", target_name=_text(own, ".run")),
        _row(reference_id=_text("i", k), path=file, kind="import", module_path=_text("m", base % 25), imported_name=up, alias=_text("B", k)),
        _row(reference_id=_text("b", k), path=file, kind="inheritance", source_qualified_symbol=own, target_name=_text("B", k)),
        _row(reference_id=_text("x", k), record_kind="declaration", path=_text("z", k, ".py"), kind="class", written_name="C3", target_name="C3"),
        _row(reference_id=_text("y", k), path=_text("z", k, ".py"), kind="inheritance", source_qualified_symbol="Un", target_name="C3"),
        _row(reference_id=_text("z", k), record_kind="declaration", path=_text("z", k, ".py"), kind="method", written_name="run", target_name="Un.run"),
    )
    files = _keys(t).select(F.explode(F.array(file, _text("z", k, ".py"))).alias("path")).distinct()
    selected = references.Selected("m3.py", "m3.py", "python", "method", "run", "C3.run")
    return references.overrides(rows, files, selected).select("path", "target_name")
