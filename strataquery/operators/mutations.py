"""Keyed mutations as table rewrites: old rows that stand, plus new ones."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, rows: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows replace those with their key; the others stand."""
    keys = [key] if isinstance(key, str) else list(key)
    return target.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def replace_children(target: DataFrame, rows: DataFrame, parent: str, *, replaced: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """All rows of replaced or removed parents go; ``rows`` come.

    A parent that is both replaced and removed is replaced. ``rows`` of other
    parents than the replaced ones are an error of the caller and are left out.
    """
    gone = replaced.select(parent) if removed is None else replaced.select(parent).unionByName(removed.select(parent)).distinct()
    fresh = rows.join(replaced.select(parent), parent, "left_semi")
    return target.join(gone, parent, "left_anti").unionByName(fresh.select(*target.columns))


def delete_children(target: DataFrame, removed: DataFrame, parent: str) -> DataFrame:
    return target.join(removed.select(parent), parent, "left_anti")


def changed_rows(target: DataFrame, rows: DataFrame, key: str, ignore: Sequence[str] = ()) -> DataFrame:
    """Those of ``rows`` that aren't already in ``target``, columns in ``ignore`` aside.

    Comparison is typed and null-safe. An empty result means that writing would
    change nothing, so no version is made.
    """
    facts = [c for c in rows.columns if c != key and c not in ignore]
    old = target.select(F.col(key), F.lit(True).alias("_in"), *[F.col(c).alias(f"_old_{c}") for c in facts])
    differs = reduce(or_, [~F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in facts], F.col("_in").isNull())
    return rows.join(old, key, "left").where(differs).select(*rows.columns)
