"""Progress and probe records: small documents beside the index."""

from __future__ import annotations

import time
from collections.abc import Callable

from strataquery.sources.hadoop import Folder

#: Seconds between two publications, and after which one says nothing any more.
EVERY, EXPIRES = 0.25, 60
#: Probe records that are kept.
PROBES = 32


def fraction(seen: int, total: int | None) -> float | None:
    return min(1.0, seen / total) if total else None


class Progress:
    """Publishes a run's progress, at most once in ``EVERY`` seconds."""

    def __init__(self, folder: Folder, project_id: str, clock: Callable[[], float] = time.time):
        self.folder, self.name, self.clock, self._last = folder, f"progress/{project_id}.json", clock, 0.0

    def update(self, phase: str, seen: int, total: int | None = None, force: bool = False) -> bool:
        now = self.clock()
        if not force and now - self._last < EVERY:
            return False
        self._last = now
        self.folder.write_json(self.name, {"phase": phase, "seen": seen, "total": total, "fraction": fraction(seen, total), "at": now})
        return True

    def read(self) -> dict | None:
        """The last publication, unless it is too old to hold."""
        found = self.folder.read_json(self.name)
        return found if found and self.clock() - found["at"] <= EXPIRES else None

    def clear(self) -> None:
        self.folder.delete(self.name)


class ProbeCache:
    """Measurements by configuration; the newest ``PROBES`` stay."""

    def __init__(self, folder: Folder):
        self.folder = folder

    def get(self, key: str) -> dict | None:
        return (self.folder.read_json("probes.json") or {}).get(key)

    def store(self, key: str, record: dict) -> None:
        known = self.folder.read_json("probes.json") or {}
        known[key] = record | {"at": time.time_ns()}
        newest = sorted(known, key=lambda k: -known[k]["at"])[:PROBES]
        self.folder.write_json("probes.json", {k: known[k] for k in newest})
