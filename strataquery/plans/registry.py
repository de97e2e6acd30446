"""All queries of the engine and their SQL."""

from __future__ import annotations

from strataquery.plans import history, resolver, scans, search, sets, sources, streams, structure  # noqa: F401  they register themselves
from strataquery.plans.base import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
