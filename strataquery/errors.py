"""Errors with a stable code."""

from __future__ import annotations

# The codes.
CODES = (
    "PROJECT_NOT_FOUND", "AMBIGUOUS_PROJECT", "PROJECT_ID_CONFLICT", "CHUNK_NOT_FOUND", "MODEL_UNAVAILABLE", "INDEX_INCOMPATIBLE",
    "INDEX_BUSY", "INDEX_RESOURCE_LIMIT", "INDEX_CANCELLED", "EMBEDDING_WORKER_FAILED", "BACKEND_UNAVAILABLE", "DAEMON_UNAVAILABLE",
    "PROTOCOL_ERROR", "INVALID_CONFIGURATION", "INVALID_FILTER", "STALE_CURSOR", "AMBIGUOUS_SYMBOL", "UNSUPPORTED_LANGUAGE",
    "REFERENCE_INDEX_UNAVAILABLE", "INVALID_REFACTOR", "INVALID_CURSOR", "UNSUPPORTED_RUNTIME", "OVERLAPPING_PROJECT",
)


class EngineError(RuntimeError):
    def __init__(self, code: str, message: str, **details):
        if code not in CODES:
            raise ValueError(f"unknown error code {code}")
        super().__init__(message)
        self.code, self.details = code, details
