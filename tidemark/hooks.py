"""What happens around statements: interceptors, the audit log, counters."""

from __future__ import annotations

import bisect
import logging
import threading
import time
from collections import Counter
from contextlib import contextmanager
from dataclasses import dataclass, field

log = logging.getLogger("tidemark.audit")


@dataclass
class Statement:
    sql: str
    args: dict[str, object]
    entity: str = ""
    operation: str = "select"
    #: "plan": a lazy frame was made; "run": an action ran, or a write.
    phase: str = "plan"
    metric: str = ""
    seconds: float = 0.0
    notes: dict[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Trace:
    """One run of a traced query; no values, and no names but the entity's."""

    operation: str
    entity: str
    seconds: float
    jobs: int
    stages: int
    tasks: int
    error: str = ""


#: Upper edges of the metrics' duration buckets, in seconds.
BUCKETS = (0.01, 0.1, 1.0, 10.0, 60.0, 600.0)


class Metrics:
    """Counts and durations of runs by operation, entity, name given to the query, and outcome: few values each."""

    def __init__(self) -> None:
        self.lock = threading.Lock()
        self.runs: Counter[tuple[str, str, str, str]] = Counter()
        self.seconds: dict[tuple[str, str, str, str], float] = {}
        self.buckets: dict[tuple[str, str, str, str], list[int]] = {}

    def add(self, s: Statement, outcome: str) -> None:
        key = (s.operation, s.entity, s.metric, outcome)
        with self.lock:
            self.runs[key] += 1
            self.seconds[key] = self.seconds.get(key, 0.0) + s.seconds
            self.buckets.setdefault(key, [0] * (len(BUCKETS) + 1))[bisect.bisect_left(BUCKETS, s.seconds)] += 1


class Interceptor:
    """Lower priorities come first. Errors in ``failed`` are swallowed, so the statement's own error stands."""

    priority = 100

    def before(self, statement: Statement) -> None: ...

    def after(self, statement: Statement) -> None: ...

    def failed(self, statement: Statement, error: BaseException) -> None: ...


class Audit(Interceptor):
    """Logs each statement. Values stay out of the log unless asked for, and of errors only the type is told."""

    priority = 200

    def __init__(self, values: bool = False, sensitive: frozenset[str] = frozenset()):
        self.values, self.sensitive, self.entries = values, sensitive, []

    def _tell(self, s: Statement, end: str) -> None:
        shown = {k: "***" if k in self.sensitive else v for k, v in s.args.items()} if self.values else len(s.args)
        self.entries.append((s.entity, s.sql, shown, end))
        log.info("%s %s %s %s %s %.3fs", s.phase, s.operation, s.entity, shown, end, s.seconds)

    def after(self, statement: Statement) -> None:
        self._tell(statement, "ok")

    def failed(self, statement: Statement, error: BaseException) -> None:
        self._tell(statement, type(error).__name__)


class Hooks:
    def __init__(self) -> None:
        self.list: list[Interceptor] = []
        self.counters: Counter[str] = Counter()
        self.metrics = Metrics()

    def _count(self, statement: Statement, end: str, outcome: str) -> None:
        self.counters[end] += 1
        if statement.phase == "run":
            self.metrics.add(statement, outcome)

    def add(self, interceptor: Interceptor) -> None:
        self.list = sorted([*self.list, interceptor], key=lambda i: i.priority)

    @contextmanager
    def around(self, statement: Statement):
        began = time.monotonic()
        for i in self.list:
            i.before(statement)
        try:
            yield statement
        except BaseException as error:
            statement.seconds = time.monotonic() - began
            self._count(statement, "failed", type(error).__name__)
            for i in self.list:
                try:
                    i.failed(statement, error)
                except Exception:  # noqa: S110  the statement's own error is the one to tell
                    pass
            raise
        statement.seconds = time.monotonic() - began
        self._count(statement, "done", "ok")
        for i in self.list:
            i.after(statement)
