"""Offset and keyset pages, and cursors bound to what they page over."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquery.errors import EngineError


def offset_page(rows: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def keyset_page(rows: DataFrame, keys: Sequence[str], after: Sequence | None, limit: int) -> DataFrame:
    """``limit`` + 1 rows in falling order of ``keys``, from below the cursor; the last tells whether more follow."""
    if after is not None:
        kinds = dict(rows.dtypes)
        rows = rows.where(F.struct(*keys) < F.struct(*[F.lit(v).cast(kinds[k]).alias(k) for k, v in zip(keys, after)]))
    return rows.orderBy(*[F.col(k).desc() for k in keys]).limit(limit + 1)


def digest(operation: dict) -> str:
    """First 16 hex digits of the SHA-256 of the operation as sorted compact JSON."""
    return hashlib.sha256(json.dumps(operation, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def encode_cursor(state: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(state, sort_keys=True, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, expected: dict) -> int:
    """Offset of a cursor; an error if it isn't one, or was made for another snapshot or question."""
    try:
        state = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        offset = state.pop("offset")
    except (ValueError, KeyError, AttributeError, TypeError) as error:
        raise EngineError("INVALID_CURSOR", "not a cursor of this engine") from error
    if not isinstance(offset, int) or isinstance(offset, bool) or offset < 0:
        raise EngineError("INVALID_CURSOR", "the cursor's offset is invalid")
    if state != expected:
        raise EngineError("STALE_CURSOR", "the index or the question changed since the cursor was made")
    return offset
