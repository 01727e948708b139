"""The query builder: an immutable list of clauses that compiles to one parameterised Spark SQL statement.

Every method returns a new query and leaves the one it is called on as it was. Nothing runs before a terminal does.
"""

from __future__ import annotations

import inspect
from collections.abc import Iterable
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame

from tidemark.entity import Col, Entity
from tidemark.errors import NotSupported, QueryError
from tidemark.functions.columns import json_path, json_text
from tidemark.functions.naming import qualified, quoted, safe_comment
from tidemark.template import bind

if TYPE_CHECKING:
    from tidemark.session import Session

#: Longer value lists become a small table that the query semi-joins.
INLINE_VALUES = 500


#: Stands in clauses for what the root's columns are qualified with, which a later CTE may change.
SOURCE = "\ue000"


@dataclass(frozen=True)
class Clause:
    """A template with its values; its parameters are numbered from ``first`` when the query compiles."""

    kind: str
    text: str
    values: tuple = ()
    name: str = ""
    first: int = 0
    other: Entity | Query | None = None


@dataclass(frozen=True)
class ValueList:
    """A long list of values as a small table of its own."""

    column: Col
    values: tuple

    @property
    def view(self) -> str:
        return f"__values_{abs(hash((self.column.name, self.column.type, tuple(map(repr, self.values))))):x}"


def _plain(text: str) -> str:
    """Text as a template that says just this."""
    return text.replace("{", "{{").replace("}", "}}")


@dataclass(frozen=True)
class Query:
    """Rows of one entity. ``session`` gives tables and runs it."""

    session: Session
    entity: Entity
    clauses: tuple[Clause, ...] = ()
    numbers: int = 0
    columns: tuple[str, ...] = ()
    aggregates: tuple[tuple[str, str], ...] = ()
    limit_to: int | None = None
    offset_by: int = 0
    split: bool = False
    cache_key: str = ""
    cache_seconds: float = 300.0
    timeout_seconds: float | None = None
    replica: str | int | None = None
    traced: bool = False
    metric: str = ""
    filtered_joins: bool = False
    lists: tuple[ValueList, ...] = ()

    # --- composing

    def _add(self, kind: str, text: str, values: tuple = (), name: str = "", other: Entity | Query | None = None) -> Query:
        bind(text, values)  # malformed templates fail here
        return replace(self, clauses=(*self.clauses, Clause(kind, text, tuple(values), name, self.numbers, other)), numbers=self.numbers + len(values))

    def _of(self, kind: str) -> list[Clause]:
        return [c for c in self.clauses if c.kind == kind]

    @property
    def source(self) -> str:
        """What the root's columns are qualified with: the last CTE, or the table."""
        ctes = self._of("cte")
        return ctes[-1].name if ctes else self.entity.table

    def _col(self, prop: str) -> str:
        return f"{SOURCE}.{_plain(quoted(self.entity.column(prop).name))}"

    def guard(self, column: str, text: str, *values: object) -> Query:
        """A condition on one of the root's columns that user filters can't widen."""
        return self._add("default", f"({SOURCE}.{_plain(quoted(column))} {text})", values)

    def where(self, text: str, *values: object) -> Query:
        return self._add("where", f"AND ({text})" if self._of("where") else f"({text})", values)

    def or_where(self, text: str, *values: object) -> Query:
        """Widens the user's filters by SQL precedence: A or_where B where C is A OR (B AND C)."""
        return self._add("where", f"OR ({text})" if self._of("where") else f"({text})", values)

    def _values(self, prop: str, values: Iterable, negated: bool) -> Query:
        values, column = self.session.stored_values(self.entity.column(prop), list(values)), self._col(prop)
        if not values:
            return self if negated else self.where("1 = 0")
        word = "NOT IN" if negated else "IN"
        if len(values) > INLINE_VALUES:
            given = ValueList(self.entity.column(prop), tuple(values))
            return replace(self.where(f"{column} {word} (SELECT v FROM {quoted(given.view)})"), lists=(*self.lists, given))
        return self.where(f"{column} {word} ({', '.join(['{}'] * len(values))})", *values)

    def where_in(self, prop: str, values: Iterable) -> Query:
        """No values: no rows."""
        return self._values(prop, values, False)

    def where_not_in(self, prop: str, values: Iterable) -> Query:
        """No values: no change. A null among them: no rows, as SQL has it."""
        return self._values(prop, values, True)

    def where_json(self, prop: str, key: str, value: object) -> Query:
        """Compares the text of one JSON key; a null value equals nothing."""
        return self.where(f"get_json_object({self._col(prop)}, {{}}) = {{}}", json_path(key), json_text(value))

    def select(self, *props: str) -> Query:
        if not props:
            raise QueryError("select needs columns")
        return replace(self, columns=tuple(self.entity.column(p).name for p in props))

    def _join(self, kind: str, other: Entity, text: str, values: tuple) -> Query:
        self.session.catalog.require(other)
        return self._add("join", text, values, name=kind, other=other)

    def inner_join(self, other: Entity, on: str, *values: object) -> Query:
        return self._join("INNER", other, on, values)

    def left_join(self, other: Entity, on: str, *values: object) -> Query:
        return self._join("LEFT", other, on, values)

    def right_join(self, other: Entity, on: str, *values: object) -> Query:
        return self._join("RIGHT", other, on, values)

    def include(self, other: Entity, prop: str, other_prop: str | None = None) -> Query:
        """Inner join on one of the root's columns; the rows stay the root's."""
        return self._join("INNER", other, f"{self._col(prop)} = {_plain(qualified(other.table, other.column(other_prop or other.key.name).name))}", ())

    def then_include(self, parent: Entity, other: Entity, prop: str, other_prop: str | None = None) -> Query:
        """Inner join on a column of an entity that was included before."""
        if parent.table not in {c.other.table for c in self._of("join")}:
            raise QueryError(f"{parent.table} isn't included")
        return self._join("INNER", other, _plain(f"{qualified(parent.table, parent.column(prop).name)} = {qualified(other.table, other.column(other_prop or other.key.name).name)}"), ())

    def filter_joined(self) -> Query:
        """Joined entities' own soft-delete and tenant filters hold too, as part of what they are joined on."""
        return replace(self, filtered_joins=True)

    def as_split(self) -> Query:
        """The root alone: joins and their parameters are left out."""
        return replace(self, split=True)

    def group_by(self, *props: str) -> Query:
        out = self
        for p in props:
            out = out._add("group", self._col(p), name=self.entity.column(p).name)
        return out

    def agg(self, **named: str) -> Query:
        """Aggregates by the name that they get, as trusted SQL."""
        return replace(self, aggregates=(*self.aggregates, *named.items()))

    def having(self, text: str, *values: object) -> Query:
        return self._add("having", f"AND ({text})" if self._of("having") else f"({text})", values)

    def window(self, function: str, over: str, name: str) -> Query:
        """A window column under a name of its own; trusted SQL."""
        return self._add("window", _plain(f"{function} OVER ({over}) AS {quoted(name)}"), name=name)

    def order_by(self, prop: str, descending: bool = False) -> Query:
        """Appends a key. Nulls come first ascending and last descending."""
        return self._add("order", f"{self._col(prop)} {'DESC NULLS LAST' if descending else 'ASC NULLS FIRST'}", name=prop)

    def then_by(self, prop: str, descending: bool = False) -> Query:
        if not self._of("order"):
            raise QueryError("then_by comes after order_by")
        return self.order_by(prop, descending)

    def take(self, n: int) -> Query:
        if n <= 0:
            raise QueryError("take needs a positive number")
        return replace(self, limit_to=n)

    def skip(self, n: int) -> Query:
        if n < 0:
            raise QueryError("skip needs a number of zero or more")
        return replace(self, offset_by=n)

    def with_cte(self, name: str, query: Query) -> Query:
        """Reads from ``query`` under ``name``; earlier ones stay visible. Its parameters are numbered after those before
        it, and the root's guards hold for its output."""
        clause = Clause("cte", "", (), name, self.numbers, query)
        return replace(self, clauses=(*self.clauses, clause), numbers=self.numbers + query.numbers)

    def set(self, prop: str, value: object) -> Query:
        c = self.entity.column(prop)
        if not c.updatable:
            raise QueryError(f"{prop} can't be set")
        return self._add("set", "{}", (value,), name=c.name)

    def raw(self, text: str) -> Query:
        """Trusted SQL after the ordering."""
        return self._add("raw", _plain(text))

    def for_update(self, skip_locked: bool = False) -> Query:
        return self._add("lock", "FOR UPDATE" + " SKIP LOCKED" * skip_locked)

    def for_share(self) -> Query:
        return self._add("lock", "FOR SHARE")

    def tag(self, text: str) -> Query:
        return self._add("tag", _plain(safe_comment(text)))

    def tag_caller(self) -> Query:
        at = inspect.stack()[1]
        return self.tag(f"{at.filename.rpartition('/')[2]}:{at.lineno} {at.function}")

    def cached(self, key: str, seconds: float = 300.0) -> Query:
        return replace(self, cache_key=key, cache_seconds=seconds)

    def prepared(self) -> Query:
        """Spark keeps no prepared plans, so nothing changes."""
        return self

    def timeout(self, seconds: float) -> Query:
        if seconds <= 0:
            raise QueryError("a timeout is positive")
        return replace(self, timeout_seconds=seconds)

    def tracing(self) -> Query:
        """Runs of this query leave a trace in the session: time, and Spark's jobs, stages and tasks."""
        return replace(self, traced=True)

    def metrics(self, name: str) -> Query:
        """Runs of this query count under ``name`` in the session's metrics, besides their operation."""
        return replace(self, metric=name)

    def for_read(self, snapshot: str | int = "replica") -> Query:
        """Reads the session's named snapshot, unless a transaction is open."""
        return replace(self, replica=snapshot)

    def for_write(self) -> Query:
        return replace(self, replica=None)

    # --- compiling

    def _emit(self, c: Clause, base: int, args: dict[str, object]) -> str:
        text, own = bind(c.text, c.values, base + c.first)
        args |= own
        return text.replace(SOURCE, quoted(self.source))

    def _where(self, base: int, args: dict[str, object]) -> str:
        default, user = " AND ".join(self._emit(c, base, args) for c in self._of("default")), " ".join(self._emit(c, base, args) for c in self._of("where"))
        if default and user:
            return f"WHERE {default} AND ({user})"
        return f"WHERE {default or user}" if default or user else ""

    def _from(self, replica: str | int | None) -> str:
        ctes = self._of("cte")
        if ctes:
            return f"FROM {quoted(ctes[-1].name)}"
        return f"FROM {quoted(self.session.view_of(self.entity, replica))} AS {quoted(self.entity.table)}"

    def _joins(self, base: int, args: dict[str, object], replica: str | int | None) -> list[str]:
        out = []
        for number, c in enumerate([] if self.split else self._of("join")):
            on = self._emit(c, base, args)
            for k, (column, text, values) in enumerate(self.session.guards(c.other) if self.filtered_joins else []):
                more, own = bind(text, values, 0, prefix=f"j{base}_{number}_{k}_")
                args |= own
                on += f") AND ({qualified(c.other.table, column)} {more}"
            out.append(f"{c.name} JOIN {quoted(self.session.view_of(c.other, replica))} AS {quoted(c.other.table)} ON ({on})")
        return out

    def _ctes(self, base: int, args: dict[str, object], replica: str | int | None) -> str:
        parts = []
        for c in self._of("cte"):
            text, own = c.other.compile(base + c.first, replica)
            args |= own
            parts.append(f"{quoted(c.name)} AS ({text})")
        return "WITH " + ", ".join(parts) if parts else ""

    def _list(self, base: int, args: dict[str, object]) -> str:
        if self.aggregates or self._of("group"):
            if not self.aggregates:
                raise QueryError("grouped rows need aggregates: a group has no single row to return")
            if self._of("window") or self.columns:
                raise QueryError("aggregates would drop the window or the selected columns without a word")
            return ", ".join([*[self._emit(c, base, args) for c in self._of("group")], *[f"{sql} AS {quoted(name)}" for name, sql in self.aggregates]])
        names = self.columns or tuple(self.entity.names)
        return ", ".join([*[qualified(self.source, n) for n in names], *[self._emit(c, base, args) for c in self._of("window")]])

    def _grouping(self, base: int, args: dict[str, object]) -> list[str]:
        grouping, having = self._of("group"), self._of("having")
        return [
            "GROUP BY " + ", ".join(self._emit(c, base, args) for c in grouping) if grouping else "",
            "HAVING " + " ".join(self._emit(c, base, args) for c in having) if having else "",
        ]

    def _ending(self, base: int, args: dict[str, object]) -> list[str]:
        return [
            "ORDER BY " + ", ".join(self._emit(c, base, args) for c in self._of("order")) if self._of("order") else "",
            *[self._emit(c, base, args) for c in self._of("raw")],
            f"LIMIT {self.limit_to}" if self.limit_to is not None else "",
            f"OFFSET {self.offset_by}" if self.offset_by else "",
        ]

    def compile(self, base: int = 0, replica: str | int | None = None) -> tuple[str, dict[str, object]]:
        """The statement and its parameters, numbered from ``base``; a query within another one reads what that reads."""
        if self._of("set"):
            return self.compile_update()
        args: dict[str, object] = {}
        replica = self.replica if replica is None else replica
        parts = [
            *[f"/* {self._emit(c, base, args)} */" for c in self._of("tag")],
            self._ctes(base, args, replica),
            "SELECT " + self._list(base, args),
            self._from(replica),
            *self._joins(base, args, replica),
            self._where(base, args),
            *self._grouping(base, args),
            *self._ending(base, args),
            *[self._emit(c, base, args) for c in self._of("lock")],
        ]
        return " ".join(p for p in parts if p), args

    def compile_count(self) -> tuple[str, dict[str, object]]:
        """Counts rows, or groups where there is a grouping; take and skip hold. Ordering alone and windows don't matter."""
        args: dict[str, object] = {}
        limited = self.limit_to is not None or self.offset_by
        inner = ["SELECT 1 AS one", self._from(self.replica), *self._joins(0, args, self.replica), self._where(0, args), *self._grouping(0, args), *(self._ending(0, args)[-2:] if limited else [])]
        text = " ".join(p for p in [self._ctes(0, args, self.replica), f"SELECT COUNT(*) AS n FROM ({' '.join(p for p in inner if p)}) AS counted"] if p)
        return text, args

    def compile_update(self) -> tuple[str, dict[str, object]]:
        """A preview in SQL of the update that ``Session.update`` runs as a transformation."""
        sets = self._of("set")
        if not sets:
            raise QueryError("an update needs set")
        wrong = [k for k in ("cte", "join", "order", "lock", "window", "group", "having", "raw") if self._of(k)]
        wrong += [k for k, there in (("select", self.columns), ("aggregates", self.aggregates), ("take", self.limit_to is not None), ("skip", self.offset_by), ("cached", self.cache_key)) if there]
        if wrong:
            raise NotSupported(f"an update would drop {', '.join(wrong)} without a word")
        args: dict[str, object] = {}
        tags = [f"/* {self._emit(c, 0, args)} */" for c in self._of("tag")]
        text = f"UPDATE {quoted(self.entity.table)} SET " + ", ".join(f"{quoted(c.name)} = {self._emit(c, 0, args)}" for c in sets)
        return " ".join(p for p in [*tags, text, self._where(0, args)] if p), args

    def explain_sql(self) -> tuple[str, dict[str, object]]:
        text, args = self.compile()
        return text, dict(args)

    def sources(self, replica: str | int | None = None) -> set[tuple[Entity, str | int | None]]:
        """The entities that the statement reads, each with the snapshot that it reads."""
        replica = self.replica if replica is None else replica
        out = {(c.other, replica) for c in self._of("join") if not self.split}
        if not self._of("cte"):
            out.add((self.entity, replica))
        for c in self._of("cte"):
            out |= c.other.sources(replica)
        return out

    def value_lists(self) -> set[ValueList]:
        return {*self.lists, *[v for c in self._of("cte") for v in c.other.value_lists()]}

    # --- terminals

    def df(self) -> DataFrame:
        """The lazy result."""
        if self._of("lock"):
            raise NotSupported("Spark has no row locks; explain_sql still shows the text")
        return self.session.planned(self)

    def to_list(self) -> list:
        return self.session.fetch(self)

    def first(self):
        return self.session.one(self.take(1), need=True)

    def first_or_none(self):
        return self.session.one(self.take(1), need=False)

    def single(self):
        return self.session.one(self.take(2), need=True, alone=True)

    def single_or_none(self):
        return self.session.one(self.take(2), need=False, alone=True)

    def count_df(self) -> DataFrame:
        return self.session.planned(self, count=True)

    def count(self) -> int:
        return self.session.count(self)

    def page(self, size: int, key: str | None = None, after: Any = None, descending: bool = True, strict: bool = True) -> tuple[DataFrame, DataFrame]:
        """Keyset page: rows beyond ``after`` by ``key``, and the total that doesn't depend on where the page stands. Both
        read one snapshot of managed tables: the query's own, or the newest one.

        ``after=None`` asks for the first page; 0 is an anchor like any other. The anchor is a guard, so a user's OR
        can't get round it. An ordering by other keys would skip rows and is refused unless ``strict`` is off.
        """
        if size <= 0:
            raise QueryError("a page has rows")
        if self.limit_to is not None or self.offset_by or self.cache_key:
            raise QueryError("a page would drop take, skip or cached without a word")
        prop = key or self.entity.key.prop or self.entity.key.name
        if strict and any(c.name != prop for c in self._of("order")):
            raise QueryError("pages are ordered by their key")
        held = replace(self, replica=self.session.newest() if self.replica is None else self.replica)
        rows = replace(held, limit_to=size)
        if not self._of("order"):
            rows = rows.order_by(prop, descending)
        if after is not None:
            after = self.session.stored_values(self.entity.column(prop), [after])[0]
            rows = rows.guard(self.entity.column(prop).name, "< {}" if descending else "> {}", after)
        return rows.df(), held.count_df()

    def update(self) -> int:
        return self.session.update(self)
