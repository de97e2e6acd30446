"""Settings of the engine, from the environment, with ranges."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from strataquery.errors import EngineError

PREFIX = "STRATAQUERY_"
_TRUE, _FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}


@dataclass(frozen=True)
class Settings:
    mode: str = "lazy"
    wait_seconds: int = 300
    max_tokens: int = 1024
    overlap_tokens: int = 64
    vector_index: str = "exact"
    vector_storage: str = "float16"
    vector_width: int = 64
    auto_maintenance: bool = True
    retention_hours: int = 168
    slot_limit: int = 4
    largest_file: int = 1_048_576

    @classmethod
    def from_environment(cls, environment: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if environment is None else environment

        def choice(name: str, default: str, allowed: tuple[str, ...]) -> str:
            value = env.get(PREFIX + name, default).lower()
            if value not in allowed:
                raise EngineError("INVALID_CONFIGURATION", f"{PREFIX}{name} must be one of {', '.join(allowed)}, not {value!r}")
            return value

        def whole(name: str, default: int, low: int, high: int) -> int:
            raw = env.get(PREFIX + name)
            try:
                value = default if raw is None else int(raw)
            except ValueError:
                value = low - 1
            if not low <= value <= high:
                raise EngineError("INVALID_CONFIGURATION", f"{PREFIX}{name} must be a whole number from {low} to {high}, not {raw!r}")
            return value

        def flag(name: str, default: bool) -> bool:
            raw = env.get(PREFIX + name, str(default)).lower()
            if raw not in _TRUE | _FALSE:
                raise EngineError("INVALID_CONFIGURATION", f"{PREFIX}{name} must be true or false, not {raw!r}")
            return raw in _TRUE

        return cls(
            mode=choice("INDEX_MODE", "lazy", ("lazy", "eager", "manual")),
            wait_seconds=whole("INDEX_WAIT_SECONDS", 300, 0, 86_400),
            max_tokens=whole("EMBED_MAX_TOKENS", 1024, 64, 8192),
            overlap_tokens=whole("EMBED_OVERLAP_TOKENS", 64, 0, 4096),
            vector_index=choice("VECTOR_INDEX", "exact", ("exact", "lsh")),
            vector_storage=choice("VECTOR_STORAGE", "float16", ("float32", "float16")),
            vector_width=whole("VECTOR_WIDTH", 64, 8, 4096),
            auto_maintenance=flag("AUTO_MAINTENANCE", True),
            retention_hours=whole("VERSION_RETENTION_HOURS", 168, 1, 8760),
            slot_limit=whole("BRANCH_CACHE_LIMIT", 4, 1, 32),
            largest_file=whole("MAX_FILE_BYTES", 1_048_576, 1, 1 << 31),
        )
