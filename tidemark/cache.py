"""A bounded cache of results, for ``Query.cached``."""

from __future__ import annotations

import threading
import time
from collections import Counter
from collections.abc import Callable, Hashable


class ResultCache:
    """Keeps lists of rows for a time. A full cache drops what has expired; if nothing has, it takes nothing new."""

    def __init__(self, entries: int = 1024, clock: Callable[[], float] = time.monotonic):
        self.size, self.clock, self.lock = entries, clock, threading.Lock()
        self.kept: dict[Hashable, tuple[float, list]] = {}
        self.counters: Counter[str] = Counter()

    def get(self, key: Hashable) -> list | None:
        with self.lock:
            entry = self.kept.get(key)
            if entry and entry[0] > self.clock():
                self.counters["hit"] += 1
                return list(entry[1])  # a copy: what the caller does to it stays with the caller
            self.kept.pop(key, None)
            self.counters["miss"] += 1
            return None

    def put(self, key: Hashable, rows: list, seconds: float) -> bool:
        with self.lock:
            if key not in self.kept and len(self.kept) >= self.size:
                now = self.clock()
                for k in [k for k, (until, _) in self.kept.items() if until <= now]:
                    del self.kept[k]
                    self.counters["evicted"] += 1
                if len(self.kept) >= self.size:
                    return False
            self.kept[key] = (self.clock() + seconds, list(rows))
            return True

    def clear(self) -> None:
        with self.lock:
            self.kept.clear()
