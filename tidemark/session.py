"""A session: tables, tenant, filters and hooks of one caller, over a SparkSession."""

from __future__ import annotations

import os
import sys
import threading
import time
import uuid
import warnings
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.cache import ResultCache
from tidemark.entity import SOFT_DELETE, TENANT, Col, Entity
from tidemark.errors import ConstraintError, DefinitionError, NoRows, NotSupported, QueryError, SessionBusy, TooManyRows, VersionConflict
from tidemark.functions.columns import as_given, decoded, encoded, stored_lit
from tidemark.functions.naming import quoted
from tidemark.hooks import Hooks, Interceptor, Statement, Trace
from tidemark.operators import aggregates, writes
from tidemark.plans.query import Query
from tidemark.resilience import Breaker, Policy
from tidemark.sources.catalog import Catalog, check_columns, schema_issues
from tidemark.sources.snapshots import SnapshotStore, Transaction
from tidemark.template import bind

#: Spark settings that sessions are opened with unless options say otherwise.
PROFILE = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}


@dataclass(frozen=True)
class Options:
    """How a session behaves. ``$ENV:NAME`` as the store's path reads the environment."""

    store: str = ""
    check_columns: bool = True
    cache_entries: int = 1024
    settings: tuple[tuple[str, str], ...] = ()
    setup: tuple[str, ...] = ()
    retries: int = 0
    naming: str = "none"
    auto_tag: bool = False
    timeout_seconds: float | None = None

    @classmethod
    def development(cls, **more: Any) -> Options:
        return cls(**{"check_columns": True, **more})

    @classmethod
    def production(cls, **more: Any) -> Options:
        return cls(**{"check_columns": False, "retries": 3, **more})

    @classmethod
    def testing(cls, **more: Any) -> Options:
        return cls(**{"cache_entries": 16, **more})

    @classmethod
    def from_environment(cls, prefix: str = "TIDEMARK_") -> Options:
        return cls(store=os.environ.get(f"{prefix}STORE", ""), retries=int(os.environ.get(f"{prefix}RETRIES", "0")), naming=os.environ.get(f"{prefix}NAMING", "none")).validated()

    def resolved_store(self) -> str:
        if self.store.startswith("$ENV:"):
            if not os.environ.get(self.store[5:]):
                raise QueryError(f"{self.store[5:]} isn't set")
            return os.environ[self.store[5:]]
        return self.store

    def validated(self) -> Options:
        if self.cache_entries < 0 or self.retries < 0:
            raise QueryError("options can't be negative")
        if self.naming not in ("none", "snake", "lower"):
            raise QueryError(f"unknown naming style {self.naming!r}")
        if self.timeout_seconds is not None and self.timeout_seconds <= 0:
            raise QueryError("a timeout is positive")
        return self

    def __str__(self) -> str:
        return f"Options(store={'***' if self.store else ''}, retries={self.retries})"


def _caller():
    """The frame of the first caller outside this module."""
    frame = sys._getframe(1)
    while frame.f_back is not None and frame.f_code.co_filename == __file__:
        frame = frame.f_back
    return frame


@dataclass(frozen=True)
class Health:
    ok: bool
    seconds: float
    error: str = ""


class Frames:
    """Results of several statements, read one after the other."""

    def __init__(self, frames: list[DataFrame]):
        self._frames, self._at = frames, 0

    def read(self) -> DataFrame:
        if self._at >= len(self._frames):
            raise NoRows("no result is left")
        self._at += 1
        return self._frames[self._at - 1]

    def read_first(self) -> Row:
        row = self.read().first()
        if row is None:
            raise NoRows("the result is empty")
        return row


#: Reads of single rows by key from one line of code after which a session warns.
MANY_GETS = 20


class Shared:
    """What a session and its ``with_*`` copies have in common: the open transaction, the gate, traces, and counts of calls."""

    def __init__(self) -> None:
        self.name, self.gate = uuid.uuid4().hex[:12], threading.RLock()
        self.work: Transaction | None = None
        self.named: dict[Entity, Entity] = {}
        self.gets: Counter[tuple[str, int]] = Counter()
        self.traces: deque[Trace] = deque(maxlen=1000)


@dataclass
class Session:
    """One caller's view of the tables. The ``with_*`` methods give changed copies that share tables, hooks and the open transaction."""

    spark: SparkSession
    catalog: Catalog = field(default_factory=Catalog)
    options: Options = field(default_factory=Options)
    tenant: object | None = None
    unfiltered: bool = False
    hooks: Hooks = field(default_factory=Hooks)
    cache: ResultCache | None = None
    policy: Policy = field(default_factory=Policy)
    procedures: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)
    pinned: dict[str, int] = field(default_factory=dict)
    shared: Shared = field(default_factory=Shared)

    def __post_init__(self) -> None:
        self.options.validated()
        self.cache = self.cache or ResultCache(self.options.cache_entries)

    @property
    def work(self) -> Transaction | None:
        return self.shared.work

    @property
    def traces(self) -> list[Trace]:
        """The last runs of traced queries."""
        return list(self.shared.traces)

    @classmethod
    def open(cls, spark: SparkSession, catalog: Catalog | None = None, options: Options | None = None) -> Session:
        """Applies the profile, the options' settings and the setup statements, in this order."""
        options = options or Options()
        for k, v in [*PROFILE.items(), *options.settings]:
            spark.conf.set(k, v)
        for statement in options.setup:
            spark.sql(statement)
        return cls(spark, catalog or Catalog(), options, policy=Policy(options.retries))

    # --- configuration

    def with_tenant(self, tenant: object) -> Session:
        if tenant is None:
            raise QueryError("a tenant can't be null")
        return replace(self, tenant=tenant)

    def ignore_filters(self) -> Session:
        return replace(self, unfiltered=True)

    def with_retry(self, retries: int, first_pause: float = 0.1) -> Session:
        return replace(self, policy=replace(self.policy, retries=retries, first_pause=first_pause))

    def with_breaker(self, failures: int, pause: float) -> Session:
        return replace(self, policy=replace(self.policy, breaker=Breaker(failures, pause)))

    def with_timeout(self, seconds: float | None) -> Session:
        """Actions of this session end after so many seconds, unless their query has a timeout of its own."""
        return replace(self, options=replace(self.options, timeout_seconds=seconds).validated())

    def with_isolation(self, level: str) -> Session:
        if level.lower() not in ("snapshot", "read committed"):
            raise NotSupported(f"{level}: readers hold to one snapshot, which is all there is")
        return self

    def add_interceptor(self, interceptor: Interceptor) -> None:
        self.hooks.add(interceptor)

    def resilient(self, action: Callable, *args: Any, **kwargs: Any) -> Any:
        """Runs an action under the session's retry and breaker; nothing else does so by itself."""
        return self.policy.run(action, *args, **kwargs)

    # --- tables

    def store(self) -> SnapshotStore:
        root = self.options.resolved_store()
        if not root:
            raise QueryError("the session has no store to write to")
        return SnapshotStore(self.spark, root)

    def named(self, entity: Entity) -> Entity:
        """The entity under the naming style of the options."""
        if self.options.naming == "none":
            return entity
        if entity not in self.shared.named:
            found = entity.renamed(self.options.naming)
            self.shared.named |= {entity: found, found: found}
        return self.shared.named[entity]

    def managed(self, entity: Entity) -> None:
        """Binds an entity to its table in the store. Reads see the open transaction, a pinned manifest, or the newest one."""
        entity = self.named(entity)

        def source(session: Session, snapshot: str | int | None) -> DataFrame:
            if session.work is not None:
                return session.work.read(entity)
            store = session.store()
            number = snapshot if isinstance(snapshot, int) else session.pinned.get(snapshot) if snapshot else None
            return store.read(entity, store.manifest(number))

        self.catalog.register(entity, source, managed=True)

    def pin(self, name: str) -> int:
        """Names the newest manifest, for queries that read a replica."""
        self.pinned[name] = self.store().head()
        return self.pinned[name]

    def newest(self) -> int | None:
        """The number of the newest manifest, where there is a store and no transaction is open."""
        return self.store().head() if self.options.store and self.work is None else None

    def frame(self, entity: Entity, snapshot: str | int | None = None) -> DataFrame:
        """The entity's rows as stored, without filters."""
        return self.catalog.require(self.named(entity))(self, None if self.work is not None else snapshot)

    def view_of(self, entity: Entity, snapshot: str | int | None = None) -> str:
        """The name that the entity's rows have while a statement of this session is planned."""
        return f"__src_{entity.table}_{self.shared.name}" + (f"_{snapshot}" if snapshot is not None else "")

    @contextmanager
    def views(self, frames: dict[str, DataFrame]) -> Iterator[None]:
        """Temporary views of these names while a statement is planned; views of the caller's that had the names come back."""
        before = {n: self.spark.table(quoted(n)) for n in frames if not n.startswith("__") and self.spark.catalog._jcatalog.tableExists(quoted(n))}
        for name, df in frames.items():
            df.createOrReplaceTempView(quoted(name))
        try:
            yield
        finally:
            for name in frames:
                self.spark.catalog.dropTempView(name)
                if name in before:
                    before[name].createOrReplaceTempView(quoted(name))

    def guards(self, entity: Entity) -> list[tuple[str, str, tuple]]:
        """(column, condition on it, values) of the default filters."""
        if self.unfiltered:
            return []
        out = [(SOFT_DELETE, "IS NULL", ())] if entity.soft_delete else []
        return out + ([(TENANT, "= {}", (self.tenant,))] if entity.tenant and self.tenant is not None else [])

    def query(self, entity: Entity) -> Query:
        """A builder over the entity, with soft-deleted rows and other tenants' rows filtered out."""
        entity = self.named(entity)
        self.catalog.require(entity)
        q = Query(self, entity)
        for column, text, values in self.guards(entity):
            q = q.guard(column, text, *values)
        if self.options.auto_tag:
            at = _caller()
            q = q.tag(f"{os.path.basename(at.f_code.co_filename)}:{at.f_lineno} {at.f_code.co_name}")
        return q

    def stored_values(self, column: Col, values: list) -> list:
        """Values of a property as its column stores them; a converter runs on them as it runs on rows."""
        if not column.converter or not values:
            return values
        frame = self.spark.createDataFrame([(i, as_given(column, v)) for i, v in enumerate(values)], f"i int, v {column.model_type().simpleString()}")
        return [r[1] for r in sorted(frame.select("i", column.converter.to_stored(F.col("v")).cast(column.spark_type())).collect())]

    # --- running

    @contextmanager
    def operation(self) -> Iterator[None]:
        """One operation at a time, unless a nested one of the same thread."""
        if not self.shared.gate.acquire(blocking=False):
            raise SessionBusy("another operation of this session is running")
        try:
            yield
        finally:
            self.shared.gate.release()

    def _plan(self, query: Query, count: bool = False) -> DataFrame:
        text, args = query.compile_count() if count else query.compile()
        frames = {self.view_of(e, snapshot): self.frame(e, snapshot).select(*[quoted(c) for c in e.names]) for e, snapshot in query.sources()}
        for v in query.value_lists():
            frames[v.view] = self.spark.createDataFrame([(x,) for x in v.values], f"v {v.column.spark_type().simpleString()}")
        with self.views(frames):
            df = self.spark.sql(text, args=args) if args else self.spark.sql(text)
        return df if count or query.aggregates else decoded(df, query.entity)

    def _plan_sql(self, text: str, values: tuple, tables: dict[str, Entity], entity: Entity | None = None) -> DataFrame:
        text, args = bind(text, values)
        with self.views({name: self.frame(e) for name, e in tables.items()}):
            df = self.spark.sql(text, args=args) if args else self.spark.sql(text)
        if entity is not None and self.options.check_columns:
            check_columns(df, self.named(entity))
        return df

    def planned(self, query: Query, count: bool = False) -> DataFrame:
        """The frame of a query. What hooks see here is the planning; an action on the frame is the caller's own."""
        text, args = query.compile_count() if count else query.compile()
        with self.operation(), self.hooks.around(Statement(text, args, query.entity.table, "count" if count else "select")):
            return self._plan(query, count)

    def act(self, statement: Statement, action: Callable[[], Any], query: Query | None = None) -> Any:
        """Runs an action as one statement: hooks see its end, whether good or bad, and timeouts hold."""
        statement.phase, statement.metric = "run", query.metric if query else ""
        with self.operation(), self.hooks.around(statement):
            return self._timed(query, lambda: self._traced(query, statement, action))

    def _timed(self, query: Query | None, action: Callable) -> Any:
        seconds = (query.timeout_seconds if query else None) or self.options.timeout_seconds
        if not seconds:
            return action()
        tag, context = f"tidemark-{uuid.uuid4().hex}", self.spark.sparkContext
        timer = threading.Timer(seconds, lambda: context.cancelJobsWithTag(tag))
        context.addJobTag(tag)
        timer.start()
        try:
            return action()
        except Exception as error:
            if "cancel" in str(error).lower():
                raise TimeoutError(f"over {seconds} s") from error
            raise
        finally:
            timer.cancel()
            context.removeJobTag(tag)

    def _traced(self, query: Query | None, statement: Statement, action: Callable) -> Any:
        if not query or not query.traced:
            return action()
        context, group, began = self.spark.sparkContext, f"tidemark-{uuid.uuid4().hex}", time.monotonic()
        before = {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description")}
        context.setJobGroup(group, f"{statement.operation} {statement.entity}")
        error = ""
        try:
            return action()
        except BaseException as wrong:
            error = type(wrong).__name__
            raise
        finally:
            tracker = context.statusTracker()
            jobs = tracker.getJobIdsForGroup(group)
            stages = [tracker.getStageInfo(i) for j in jobs if (job := tracker.getJobInfo(j)) for i in job.stageIds]
            tasks = sum(i.numTasks for i in stages if i)
            self.shared.traces.append(Trace(statement.operation, statement.entity, time.monotonic() - began, len(jobs), len(stages), tasks, error))
            for k, v in before.items():
                context.setLocalProperty(k, v)

    def _run(self, query: Query, operation: str, action: Callable[[DataFrame], Any]) -> Any:
        count = operation == "count"
        text, args = query.compile_count() if count else query.compile()
        if query._of("lock"):
            raise NotSupported("Spark has no row locks; explain_sql still shows the text")
        return self.act(Statement(text, args, query.entity.table, operation), lambda: action(self._plan(query, count)), query)

    def fetch(self, query: Query) -> list[Row]:
        """Rows, from the cache where the query asks for that and no transaction is open. A key knows tenant, filters, the
        statement with its values, and the manifest that is read, so a commit leaves the old entry behind."""
        key = None
        if query.cache_key and self.work is None:
            text, args = query.explain_sql()
            at = self.pinned.get(query.replica) if isinstance(query.replica, str) else query.replica
            at = self.newest() if at is None and any(self.catalog.is_managed(e) for e, _ in query.sources()) else at
            key = (query.cache_key, query.entity.table, self.tenant, self.unfiltered, at, text, tuple(map(repr, args.values())))
            if (rows := self.cache.get(key)) is not None:
                return rows
        rows = self._run(query, "select", DataFrame.collect)
        if key:
            self.cache.put(key, rows, query.cache_seconds)
        return rows

    def one(self, query: Query, need: bool, alone: bool = False) -> Row | None:
        rows = self._run(query, "select", DataFrame.collect)
        if not rows and need:
            raise NoRows(query.entity.table)
        if alone and len(rows) > 1:
            raise TooManyRows(query.entity.table)
        return rows[0] if rows else None

    def count(self, query: Query) -> int:
        return self._run(query, "count", lambda df: df.first()[0])

    # --- reading

    def all(self, entity: Entity) -> DataFrame:
        return self.query(entity).df()

    def _by_key(self, entity: Entity, key: object) -> Query:
        column = self.named(entity).key
        return self.query(entity).guard(column.name, "= {}", self.stored_values(column, [key])[0]).take(1)

    def get_df(self, entity: Entity, key: object) -> DataFrame:
        return self._by_key(entity, key).df()

    def get(self, entity: Entity, key: object) -> Row | None:
        """The row of that key. Many such reads from one line of code warn: they are a join, or a ``where_in``."""
        at = _caller()
        at = (at.f_code.co_filename, at.f_lineno)
        self.shared.gets[at] += 1
        if self.shared.gets[at] == MANY_GETS:
            warnings.warn(f"{MANY_GETS} reads by key from {at[0]}:{at[1]}; one query with where_in or a join reads them at once", stacklevel=2)
        return self.one(self._by_key(entity, key), need=False)

    def aggregate(self, entity: Entity, kind: str, expr: str = "", where: str = "", *values: object) -> DataFrame:
        """A one-row frame (value): count, sum, avg, min or max under the default filters."""
        query = self.query(entity)
        rows = (query.where(where, *values) if where else query).df()
        if kind == "count":
            return aggregates.count_rows(rows)
        if kind in ("min", "max"):
            return aggregates.extreme_of(rows, expr, kind == "max")
        return {"sum": aggregates.sum_of, "avg": aggregates.average_of}[kind](rows, expr)

    def sql(self, text: str, *values: object, entity: Entity | None = None, **tables: Entity) -> DataFrame:
        """Raw SQL with bound holes; default filters don't apply. ``tables`` names entities that the text may read. With
        an entity, columns have to stand in its order."""
        bound, args = bind(text, values)
        with self.operation(), self.hooks.around(Statement(bound, args, operation="sql")):
            return self._plan_sql(text, values, tables, entity)

    def _run_sql(self, text: str, values: tuple, tables: dict[str, Entity], action: Callable[[DataFrame], Any]) -> Any:
        bound, args = bind(text, values)
        return self.act(Statement(bound, args, operation="sql"), lambda: action(self._plan_sql(text, values, tables)))

    def rows(self, text: str, *values: object, **tables: Entity) -> Iterator[Row]:
        """Rows one by one; a partition at a time is in memory."""
        bound, args = bind(text, values)
        with self.hooks.around(Statement(bound, args, operation="sql", phase="run")):
            yield from self._plan_sql(text, values, tables).toLocalIterator(prefetchPartitions=True)

    def scalar(self, text: str, *values: object, default: Any = None, **tables: Entity) -> Any:
        row = self._run_sql(text, values, tables, DataFrame.first)
        return default if row is None or row[0] is None else row[0]

    def sql_first(self, text: str, *values: object, **tables: Entity) -> Row:
        row = self._run_sql(text, values, tables, DataFrame.first)
        if row is None:
            raise NoRows(text)
        return row

    def sql_single(self, text: str, *values: object, **tables: Entity) -> Row:
        rows = self._run_sql(text, values, tables, lambda df: df.limit(2).collect())
        if len(rows) != 1:
            raise (TooManyRows if rows else NoRows)(text)
        return rows[0]

    def several(self, *statements: tuple[str, tuple], **tables: Entity) -> Frames:
        """Several statements, read in order: (text, values) each."""
        return Frames([self.sql(text, *values, **tables) for text, values in statements])

    def procedure(self, name: str, made: Callable[..., DataFrame]) -> None:
        if not name.replace("_", "a").isalnum():
            raise QueryError(f"not a procedure's name: {name!r}")
        self.procedures[name] = made

    def call(self, name: str, **params: object) -> DataFrame:
        if name not in self.procedures:
            raise QueryError(f"no procedure {name!r}")
        return self.procedures[name](self, **params)

    # --- writing

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        """Reads and writes inside see each other, those of the session's ``with_*`` copies too; all of it is published at
        once, or none."""
        if self.work is not None:
            raise QueryError("transactions don't nest; use savepoints")
        with self.operation():
            store = self.store()
            with store.transaction() as work:
                self.shared.work = work
                try:
                    yield work
                finally:
                    self.shared.work = None

    @contextmanager
    def _writing(self, entity: Entity, operation: str) -> Iterator[Transaction]:
        """One write: in the open transaction, which it leaves as it was if it fails, or in one of its own."""
        with self.hooks.around(Statement(f"{operation.upper()} {quoted(entity.table)}", {}, entity.table, operation, phase="run")):
            if self.work is not None:
                before = dict(self.work.staged)
                try:
                    yield self.work
                except BaseException:
                    self.work.staged = before
                    raise
            else:
                with self.transaction() as work:
                    yield work

    def _given(self, work: Transaction, entity: Entity, rows: DataFrame | Iterable) -> DataFrame:
        """Given rows as stored values. Frames are written aside first, so that every step sees the same rows."""
        if isinstance(rows, DataFrame):
            return encoded(work.hold(rows), entity)
        names = entity.names
        fit = {"decimal": lambda v: Decimal(str(v)), "double": float, "float": float}
        schema = entity.model_schema()
        change = [fit.get(f.dataType.typeName(), lambda v: v) for f in schema.fields]
        given = [[r.get(c.name, r.get(c.prop)) for c in entity.columns] if isinstance(r, dict) else list(r) for r in rows]
        data = [tuple(None if v is None else f(as_given(c, v)) for v, f, c in zip(r, change, entity.columns, strict=True)) for r in given]
        return encoded(self.spark.createDataFrame(data, schema), entity).select(*[quoted(n) for n in names])

    def _own(self) -> object | None:
        return None if self.unfiltered else self.tenant

    def insert(self, entity: Entity, rows: DataFrame | Iterable) -> int:
        """Appends rows as a part of their own; identities count on from the last one. The number of rows."""
        entity = self.named(entity)
        with self._writing(entity, "insert") as work:
            return self._insert(work, entity, self._given(work, entity, rows))

    def _insert(self, work: Transaction, entity: Entity, given: DataFrame) -> int:
        fresh = writes.prepare_insert(given, entity)
        if entity.key.identity:
            fresh = writes.with_identities(work.hold(fresh), entity, work.last_identity(entity))
        return work.append(entity, fresh)

    def update_rows(self, entity: Entity, rows: DataFrame | Iterable) -> int:
        """Updates by key, all or none. A versioned row that isn't there in its version is a conflict. Only parts that hold
        one of the keys are written anew."""
        entity = self.named(entity)
        with self._writing(entity, "update") as work:
            delta = self._given(work, entity, rows)
            if (again := writes.repeated_keys(delta, entity).first()) is not None:
                raise ConstraintError(f"{entity.table}: key {again[0]} is given twice")
            parts = work.holding(entity, delta)
            base = work.store.read_parts(entity, parts)
            missed = writes.outdated(base, delta, entity, self._own()).count()
            if missed and entity.version:
                raise VersionConflict(f"{missed} rows of {entity.table} changed since they were read")
            if parts:
                work.rewrite(entity, parts, writes.update_by_key(base, delta, entity, self._own()), changed={c.name for c in entity.columns if not c.key})
            return delta.count() - missed

    def update(self, query: Query) -> int:
        """Runs a builder's set and where on the rows that its guards let through."""
        query.compile_update()
        e = query.entity
        with self._writing(e, "update") as work:
            sets = {c.name: stored_lit(e, c.name, c.values[0]) for c in query._of("set")}
            only = replace(query, clauses=tuple(c for c in query.clauses if c.kind in ("default", "where")), columns=(e.key.name,))
            keys = work.hold(self._plan_stored(only).select(F.col(quoted(e.key.name))))
            parts = work.holding(e, keys)
            if parts:
                marks = keys.select(F.col(quoted(e.key.name)).alias("_key"), F.lit(True).alias("_hit"))
                marked = work.store.read_parts(e, parts).join(marks, F.col(quoted(e.key.name)) == F.col("_key"), "left")
                computed = {c.name for c in e.columns if c.computed}
                work.rewrite(e, parts, writes.update_where(marked, e, F.col("_hit"), sets), changed={*sets, *computed})
            return keys.count()

    def _plan_stored(self, query: Query) -> DataFrame:
        """The rows of a query with the values as stored."""
        plain = replace(query.entity, columns=tuple(replace(c, converter=None, json=None) for c in query.entity.columns))
        return self._plan(replace(query, entity=plain))

    def delete(self, entity: Entity, *keys: object) -> int:
        entity = self.named(entity)
        name = quoted(entity.key.name)
        return self.delete_rows(entity, self.spark.createDataFrame([(as_given(entity.key, k),) for k in keys], f"{name} {entity.key.model_type().simpleString()}"))

    def delete_rows(self, entity: Entity, keys: DataFrame) -> int:
        """Soft or hard, by the entity; the number of rows that weren't deleted before."""
        entity = self.named(entity)
        with self._writing(entity, "delete") as work:
            gone = encoded(work.hold(keys.select(quoted(entity.key.name))), entity).dropna()
            parts = work.holding(entity, gone)
            if not parts:
                return 0
            base = work.store.read_parts(entity, parts)
            if entity.soft_delete:
                n = writes.deletable(base, gone, entity, self._own()).count()
                work.rewrite(entity, parts, writes.delete_keys(base, gone, entity, self._own()), changed={SOFT_DELETE})
                return n
            before = sum(p["rows"] for p in parts)
            return before - work.rewrite(entity, parts, writes.delete_keys(base, gone, entity, self._own()), changed=set())

    def save(self, entity: Entity, rows: DataFrame | Iterable) -> int:
        """Upserts by key; rows without a key are inserted. The number of given rows."""
        entity = self.named(entity)
        with self._writing(entity, "upsert") as work:
            given = self._given(work, entity, rows)
            key = F.col(quoted(entity.key.name))
            fresh = key.isNull() | (key == 0) if entity.key.identity else key.isNull()
            known = given.where(~fresh)
            if (again := writes.repeated_keys(known, entity).first()) is not None:
                raise ConstraintError(f"{entity.table}: key {again[0]} is given twice")
            parts = work.holding(entity, known)
            work.rewrite(entity, parts, writes.upsert(work.store.read_parts(entity, parts), known, entity))
            if entity.key.identity:
                self._insert(work, entity, given.where(fresh))
            return given.count()

    def seed(self, entity: Entity, rows: DataFrame | Iterable) -> int:
        """Idempotent: rows come with their keys, and seeding again changes nothing more."""
        entity = self.named(entity)
        given = rows if isinstance(rows, DataFrame) else list(rows)
        key = F.col(quoted(entity.key.name))
        keyless = (
            given.where(key.isNull() | (key == 0) if entity.key.identity else key.isNull()).limit(1).count()
            if isinstance(given, DataFrame)
            else any(k is None or (entity.key.identity and k == 0) for k in [r.get(entity.key.name, r.get(entity.key.prop)) if isinstance(r, dict) else list(r)[entity.names.index(entity.key.name)] for r in given])
        )
        if keyless:
            raise ConstraintError("seeded rows need their keys")
        return self.save(entity, given)

    # --- schema and health

    def migrate(self) -> list[str]:
        for issue in self.catalog.unknown_references():
            warnings.warn(issue, stacklevel=2)
        return self.store().migrate(self.catalog.entities())

    def validate_schema(self, entity: Entity) -> list[str]:
        try:
            return schema_issues(self.frame(entity), self.named(entity))
        except DefinitionError as wrong:
            return [str(wrong)]

    def health(self) -> Health:
        began = time.monotonic()
        try:
            self.spark.range(1).count()
        except Exception as error:
            return Health(False, time.monotonic() - began, type(error).__name__)
        return Health(True, time.monotonic() - began)
