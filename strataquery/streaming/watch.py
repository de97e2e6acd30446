"""When a watched tree is indexed again: debounce, one dirty slot, back-off, reconciliation.

The watcher keeps no queue. A notice raises a counter; a run takes the counter
that it started from, so a notice during a run leaves the slot dirty and is
seen by the next run. Changes are waited out for ``debounce`` seconds, but no
longer than ``longest``. Every ``reconcile`` seconds a run is due without any
notice. A failed run is tried again after a wait that doubles up to
``most_wait``.
"""

from __future__ import annotations

import time
from collections.abc import Callable


class Watcher:
    def __init__(self, run: Callable[[], object], *, debounce: float = 0.25, longest: float = 5.0, reconcile: float = 30.0, wait: float = 1.0, most_wait: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self._run, self._clock = run, clock
        self.debounce, self.longest, self.reconcile, self.first_wait, self.most_wait = debounce, longest, reconcile, wait, most_wait
        self.noticed = self.done = 0
        self._first = self._last = 0.0
        self._finished = clock()
        self._wait, self._not_before = wait, 0.0

    @property
    def dirty(self) -> bool:
        return self.noticed > self.done

    def notice(self) -> None:
        """Something changed."""
        now = self._clock()
        if not self.dirty:
            self._first = now
        self._last = now
        self.noticed += 1

    def due(self) -> bool:
        now = self._clock()
        if now < self._not_before:
            return False
        settled = now - self._last >= self.debounce or now - self._first >= self.longest
        return (self.dirty and settled) or now - self._finished >= self.reconcile

    def step(self) -> bool:
        """Run if that is due; whether a run ended well. An error waits for the next try and isn't raised."""
        if not self.due():
            return False
        took = self.noticed
        try:
            self._run()
        except Exception:  # the tree may be in the middle of a change; the back-off bounds the tries
            self._not_before = self._clock() + self._wait
            self._wait = min(2 * self._wait, self.most_wait)
            self.noticed = max(self.noticed, self.done + 1)
            return False
        self.done, self._finished = took, self._clock()
        self._wait, self._not_before = self.first_wait, 0.0
        if self.dirty:
            self._first = self._last
        return True
