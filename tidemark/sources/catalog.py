"""Where entities' rows come from."""

from __future__ import annotations

import threading
from collections.abc import Callable
from types import MappingProxyType

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

from tidemark.entity import Entity
from tidemark.errors import DefinitionError

if TYPE_CHECKING:
    from tidemark.session import Session

#: Rows for the session that asks, of a named or numbered snapshot where the source has such.
Source = Callable[["Session", "str | int | None"], DataFrame]


class Catalog:
    """Entities and their sources. Registering publishes a new snapshot of both in one step; readers never see half of one."""

    def __init__(self, folder: str = "") -> None:
        self.folder = folder
        self._lock, self._entries = threading.Lock(), MappingProxyType({})

    def register(self, entity: Entity, source: Source, managed: bool = False) -> None:
        """``managed``: the source is a table of the session's store."""
        with self._lock:
            if entity.table in self._entries:
                raise DefinitionError(f"{entity.table} is registered already")
            self._entries = MappingProxyType({**self._entries, entity.table: (entity, source, managed)})

    def rebind(self, entity: Entity, source: Source) -> None:
        with self._lock:
            self._entries = MappingProxyType({**self._entries, entity.table: (entity, source, False)})

    def parquet(self, entity: Entity, path: str) -> None:
        """Parquet files; columns are checked against the entity when they are read."""
        self.register(entity, lambda session, _: read_parquet(session.spark, path, entity))

    def frame(self, entity: Entity, df: DataFrame) -> None:
        self.register(entity, lambda *_: df)

    def require(self, entity: Entity) -> Source:
        if entity.table not in self._entries:
            raise DefinitionError(f"{entity.table} isn't registered")
        return self._entries[entity.table][1]

    def entities(self) -> list[Entity]:
        return [e for e, _, _ in self._entries.values()]

    def is_managed(self, entity: Entity) -> bool:
        return entity.table in self._entries and self._entries[entity.table][2]

    def unknown_references(self) -> list[str]:
        """References that name a table that isn't registered."""
        return [f"{e.table}.{c.name} refers to {c.references[0]}, which isn't registered" for e in self.entities() for c in e.columns if c.references and c.references[0] not in self._entries]


def read_parquet(spark: SparkSession, path: str, entity: Entity) -> DataFrame:
    df = spark.read.parquet(path)
    if missing := schema_issues(df, entity):
        raise DefinitionError(f"{entity.table}: " + "; ".join(missing))
    return df.select(*entity.names)


def schema_issues(df: DataFrame, entity: Entity) -> list[str]:
    """Columns that an entity expects and the table lacks, and types that differ by more than width."""
    there, out = {f.name.lower(): f.dataType for f in df.schema.fields}, []
    numbers = {"short", "integer", "long", "decimal", "double", "float", "byte"}
    for c in entity.columns:
        found = there.get(c.name.lower())
        if found is None:
            out.append(f"column {c.name} is missing")
        elif (a := found.typeName()) != (b := c.spark_type().typeName()) and not {a, b} <= numbers and not {a, b} <= {"timestamp", "timestamp_ntz"}:
            out.append(f"column {c.name} is {a}, not {b}")
    return out


def check_columns(df: DataFrame, entity: Entity) -> None:
    """Columns of raw SQL stand in the entity's order; more may follow. Checked before anything runs."""
    got = [c.lower() for c in df.columns[: len(entity.columns)]]
    if got != [c.name.lower() for c in entity.columns]:
        raise DefinitionError(f"{entity.table}: columns {df.columns} don't begin with {entity.names}")
