"""Retry, timeouts and a circuit breaker, for explicit use around actions. Spark retries lost tasks by itself."""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from tidemark.errors import CircuitOpen, ConstraintError, QueryError, VersionConflict

TRANSIENT = ("Connection", "timed out", "FetchFailed", "ExecutorLost", "BlockMissing", "Temporarily", "Retry")


def transient(error: BaseException) -> bool:
    """Whether trying again may help. What is wrong in itself never does."""
    if isinstance(error, (QueryError, ConstraintError, VersionConflict, KeyboardInterrupt)):
        return False
    return isinstance(error, (ConnectionError, TimeoutError)) or any(t.lower() in str(error).lower() for t in TRANSIENT)


def unique_violation(error: BaseException) -> bool:
    return isinstance(error, ConstraintError) and "repeated" in str(error)


class Breaker:
    """Opens after so many failures in a row (0: never); after a pause one call may probe."""

    def __init__(self, failures: int = 5, pause: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.limit, self.pause, self.clock, self.lock = failures, pause, clock, threading.Lock()
        self.failures, self.opened, self.probing = 0, 0.0, False

    def enter(self) -> None:
        with self.lock:
            if self.limit and self.failures >= self.limit:
                if self.probing or self.clock() - self.opened < self.pause:
                    raise CircuitOpen("too many failures; calls are refused for now")
                self.probing = True

    def leave(self, ok: bool) -> None:
        with self.lock:
            self.probing = False
            self.failures = 0 if ok else self.failures + 1
            if not ok:
                self.opened = self.clock()


@dataclass(frozen=True)
class Policy:
    """Tries again after 0.1 s, 0.2 s, 0.4 s and so on, 30 s at most."""

    retries: int = 0
    first_pause: float = 0.1
    longest_pause: float = 30.0
    breaker: Breaker | None = None
    sleep: Callable[[float], None] = time.sleep

    def run(self, action: Callable, *args, **kwargs):
        for attempt in range(self.retries + 1):
            if self.breaker:
                self.breaker.enter()
            try:
                out = action(*args, **kwargs)
            except BaseException as error:
                if self.breaker:
                    self.breaker.leave(not transient(error))
                if attempt == self.retries or not transient(error):
                    raise
                self.sleep(min(self.longest_pause, self.first_pause * 2**attempt) * random.uniform(0.9, 1.0))
            else:
                if self.breaker:
                    self.breaker.leave(True)
                return out
        raise AssertionError("unreachable")
