"""Entities: a table declared once, with its types and rules."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column as SparkColumn
from pyspark.sql import types as T

from tidemark.errors import DefinitionError
from tidemark.functions.naming import converted

#: The closed set of column types and what holds each in Spark. Times of day are microseconds, as Parquet has no such type in Spark.
TYPES: dict[str, T.DataType] = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "short": T.ShortType(),
    "unsigned_byte": T.ShortType(),
    "bool": T.BooleanType(),
    "decimal": T.DecimalType(18, 6),
    "double": T.DoubleType(),
    "float": T.FloatType(),
    "string": T.StringType(),
    "char": T.StringType(),
    "timestamp": T.TimestampNTZType(),
    "timestamp_utc": T.TimestampType(),
    "date": T.DateType(),
    "time": T.LongType(),
    "uuid": T.StringType(),
    "binary": T.BinaryType(),
}
SOFT_DELETE, TENANT = "deleted_at", "tenant_id"


@dataclass(frozen=True)
class Converter:
    """How a model value is stored: two functions of a Spark column, so conversion runs in the JVM. ``model`` is the model
    value's type, if it isn't the stored one's."""

    to_stored: Callable[[SparkColumn], SparkColumn]
    from_stored: Callable[[SparkColumn], SparkColumn]
    model: T.DataType | None = None


@dataclass(frozen=True)
class Col:
    """One column. ``prop`` is the name that queries use; it defaults to the column's own."""

    name: str
    type: str = "string"
    prop: str = ""
    key: bool = False
    identity: bool = False
    required: bool = False
    nullable: bool = True
    skip_insert: bool = False
    version: bool = False
    stamp: bool = False
    computed: str | None = None
    json: T.StructType | bool | None = None
    converter: Converter | None = None
    unique: bool = False
    sensitive: bool = False
    references: tuple[str, str] | None = None

    @property
    def not_null(self) -> bool:
        return self.key or self.required or not self.nullable

    @property
    def insertable(self) -> bool:
        return not (self.skip_insert or self.identity or self.computed or self.stamp)

    @property
    def upsertable(self) -> bool:
        return not (self.skip_insert or self.computed or self.stamp)

    @property
    def updatable(self) -> bool:
        return not (self.key or self.version or self.stamp or self.computed)

    def spark_type(self) -> T.DataType:
        return TYPES[self.type]

    @property
    def is_struct(self) -> bool:
        """JSON text with a declared schema, a struct to callers."""
        return self.json is not None and not isinstance(self.json, bool)

    def model_type(self) -> T.DataType:
        """The type that callers give and get."""
        if self.is_struct:
            return self.json
        return self.converter.model if self.converter and self.converter.model else self.spark_type()


@dataclass(frozen=True)
class Entity:
    """A table: its columns in order, and whether deleting marks rows and tenants divide them."""

    table: str
    columns: tuple[Col, ...]
    soft_delete: bool = False
    tenant: bool = False
    indexes: tuple[tuple[str, ...], ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    by_prop: dict[str, Col] = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "columns", tuple(self.columns))
        object.__setattr__(self, "by_prop", {c.prop or c.name: c for c in self.columns})
        check(self)

    def __hash__(self) -> int:
        return hash(self.table)

    @property
    def key(self) -> Col:
        return next(c for c in self.columns if c.key)

    @property
    def version(self) -> Col | None:
        return next((c for c in self.columns if c.version), None)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column(self, prop: str) -> Col:
        """A direct property; dotted paths and unknown names are errors."""
        if prop in self.by_prop:
            return self.by_prop[prop]
        raise DefinitionError(f"{self.table} has no property {prop!r}")

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type(), not c.not_null) for c in self.columns])

    def model_schema(self) -> T.StructType:
        """Of rows that callers give: anything may be left out."""
        return T.StructType([T.StructField(c.name, c.model_type(), True) for c in self.columns])

    def renamed(self, style: str) -> Entity:
        """The entity with table and column names in a naming style; properties keep the names that they were declared
        under, and columns declared beside a property of another name stay."""
        new = {c.name: c.name if c.prop else converted(c.name, style) for c in self.columns}
        columns = tuple(replace(c, name=new[c.name], prop=c.prop or c.name, references=c.references and (converted(c.references[0], style), c.references[1])) for c in self.columns)
        group = lambda rules: tuple(tuple(new[n] for n in g) for g in rules)
        return replace(self, table=converted(self.table, style), columns=columns, indexes=group(self.indexes), unique=group(self.unique))

    def unique_sets(self) -> list[tuple[str, ...]]:
        return [(self.key.name,), *[(c.name,) for c in self.columns if c.unique], *self.unique]


def balanced(text: str) -> bool:
    depth = 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return False
    return depth == 0


def check(e: Entity) -> None:
    """Rules that a declaration keeps; breaking one raises, doubtful ones warn."""
    fail = []
    names = [c.name for c in e.columns]
    keys = [c for c in e.columns if c.key]
    if not re.fullmatch(r"[^\x00-\x1f`]+", e.table) or "." in e.table:
        fail.append("a table name is one identifier; schemas and databases aren't part of it")
    if not names:
        fail.append("no columns")
    if len({n.lower() for n in names}) < len(names) or len(e.by_prop) < len(names):
        fail.append("two columns or properties of one name")
    if len(keys) != 1:
        fail.append("exactly one key column is needed")
    for c in e.columns:
        if c.type not in TYPES:
            fail.append(f"{c.name}: unknown type {c.type!r}")
        if c.identity and (not c.key or c.type not in ("int", "long")):
            fail.append(f"{c.name}: only an int or long key can be an identity")
        if c.key and (c.computed or c.json or c.version or c.stamp):
            fail.append(f"{c.name}: a key is a plain value")
        if c.stamp and c.type not in ("timestamp", "timestamp_utc"):
            fail.append(f"{c.name}: a stamp is a timestamp")
        if c.version and c.type not in ("int", "long"):
            fail.append(f"{c.name}: a version is an int or long")
        if c.version and c.skip_insert:
            fail.append(f"{c.name}: a version has to be inserted")
        if c.computed is not None and (not c.computed.strip() or not balanced(c.computed)):
            fail.append(f"{c.name}: a computed column needs an expression with balanced parentheses")
        if c.json and c.converter:
            fail.append(f"{c.name}: JSON and a converter exclude each other")
        if c.json and c.type != "string":
            fail.append(f"{c.name}: JSON is stored as a string")
        if c.references is not None and not c.references[0]:
            fail.append(f"{c.name}: a reference names a table")
        if c.required and c.nullable and c.type != "string":
            warnings.warn(f"{e.table}.{c.name} is required, so it isn't nullable", stacklevel=4)
    if sum(c.version for c in e.columns) > 1:
        fail.append("more than one version column")
    if e.soft_delete and SOFT_DELETE not in names:
        fail.append(f"soft delete needs a column {SOFT_DELETE}")
    if e.soft_delete and any(c.name == SOFT_DELETE and c.not_null for c in e.columns):
        fail.append(f"{SOFT_DELETE} is null until a row is deleted")
    if e.tenant and TENANT not in names:
        fail.append(f"tenants need a column {TENANT}")
    if e.tenant and any(c.name == TENANT and not c.not_null for c in e.columns):
        warnings.warn(f"{e.table}.{TENANT} can be null; such rows belong to no tenant", stacklevel=4)
    for group in (*e.indexes, *e.unique):
        if not group or set(group) - set(names):
            fail.append(f"an index or unique rule over unknown columns: {group}")
    if names and keys and not any(c.insertable or c.key for c in e.columns):
        fail.append("no column can be inserted")
    if len(names) > 1 and not any(c.updatable for c in e.columns):
        warnings.warn(f"{e.table}: no column can be updated", stacklevel=4)
    if fail:
        raise DefinitionError(f"{e.table}: " + "; ".join(fail))
