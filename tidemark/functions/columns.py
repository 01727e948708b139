"""Column expressions: JSON, converters, computed and stored values. All of them are Spark's own functions."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.entity import Col, Entity
from tidemark.errors import QueryError
from tidemark.functions.naming import quoted

MICROS = 1_000_000


def json_path(key: str) -> str:
    """The path of one key at the top of a JSON object."""
    if not key or "\0" in key or "'" in key:
        raise QueryError(f"not a JSON key: {key!r}")
    return f"$['{key}']" if not key.isidentifier() else f"$.{key}"


def json_text(value: object) -> str | None:
    """A value as the text that extracting it from JSON gives. Dates and times have no JSON form of their own."""
    if value is None or isinstance(value, str):
        if value and "\0" in value:
            raise QueryError("NUL can't stand in JSON text")
        return value
    if isinstance(value, (dt.date, dt.time, dt.timedelta, bytes)):
        raise QueryError(f"compare {type(value).__name__} values as text")
    return json.dumps(value)


def as_given(column: Col, value: object) -> object:
    """A caller's value in the form that frames are made of: a time of day becomes microseconds, a UUID its text."""
    if isinstance(value, dt.time):
        return time_micros(value)
    if isinstance(value, uuid.UUID):
        return str(value)
    if column.is_struct and isinstance(value, str):
        return json.loads(value)
    return value


def _encode(column: Col, value: SparkColumn, kind: str) -> SparkColumn:
    if column.is_struct and kind == "struct":
        value = F.to_json(value)
    if column.converter:
        value = column.converter.to_stored(value)
    return value


def stored_lit(entity: Entity, name: str, value: object) -> SparkColumn:
    """A value as a column, as the entity stores it."""
    column = next(c for c in entity.columns if c.name == name)
    if column.is_struct and value is not None and not isinstance(value, str):
        value = json.dumps(value.asDict(True) if hasattr(value, "asDict") else value)
    return _encode(column, F.lit(as_given(column, value) if not column.is_struct else value), "string").cast(column.spark_type())


def encoded(df: DataFrame, entity: Entity) -> DataFrame:
    """The entity's columns that ``df`` has, as stored values: structs to JSON text, converters applied. Others stay."""
    known = {c.name: c for c in entity.columns if c.is_struct or c.converter}
    if not known.keys() & set(df.columns):
        return df
    return df.select(*[_encode(known[n], F.col(quoted(n)), df.schema[n].dataType.typeName()).cast(known[n].spark_type()).alias(n) if n in known else F.col(quoted(n)) for n in df.columns])


def decoded(df: DataFrame, entity: Entity) -> DataFrame:
    """The entity's columns that ``df`` has, as model values: JSON text as structs where a schema is declared, converters
    undone. Others stay."""
    known = {c.name: c for c in entity.columns if c.is_struct or c.converter}
    if not known.keys() & set(df.columns):
        return df
    out = []
    for n in df.columns:
        value, c = F.col(quoted(n)), known.get(n)
        if c is not None and c.is_struct:
            value = F.from_json(value, c.json)
        if c is not None and c.converter:
            value = c.converter.from_stored(value)
        out.append(value.alias(n))
    return df.select(*out)


def to_stored(df: DataFrame, entity: Entity) -> DataFrame:
    """Model values as stored values, in the entity's columns: ``encoded``, computed columns filled, types cast."""
    stored = encoded(df, entity)
    stored = stored.select(*[F.col(quoted(c.name)).cast(c.spark_type()).alias(c.name) for c in entity.columns if c.computed is None])
    for c in entity.columns:
        if c.computed is not None:
            stored = stored.withColumn(c.name, F.expr(c.computed).cast(c.spark_type()))
    return stored.select(*[quoted(n) for n in entity.names])


def from_stored(df: DataFrame, entity: Entity) -> DataFrame:
    """Stored values as model values, in the entity's columns."""
    return decoded(df.select(*[quoted(n) for n in entity.names]), entity)


def time_micros(value: dt.time) -> int:
    return ((value.hour * 60 + value.minute) * 60 + value.second) * MICROS + value.microsecond


def micros_time(value: int) -> dt.time:
    seconds, micro = divmod(value, MICROS)
    return dt.time(seconds // 3600, seconds // 60 % 60, seconds % 60, micro)


def breaks_range(c: Col) -> SparkColumn | None:
    """Whether a value doesn't fit a type that Spark lacks."""
    if c.type == "unsigned_byte":
        return ~F.col(c.name).between(0, 255)
    if c.type == "char":
        return F.length(c.name) != 1
    if c.type == "time":
        return ~F.col(c.name).between(0, 24 * 3600 * MICROS - 1)
    return None
