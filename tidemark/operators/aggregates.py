"""Aggregates of one entity as one-row frames; empty inputs give the type's zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

ZERO = {"string": None, "binary": None, "timestamp": None, "timestamp_ntz": None, "date": None, "boolean": False}
#: Decimals that sums of floating-point numbers are added with, and those that they are told with.
FLOAT_SCALE, TOLD_SCALE = 12, 6
WIDEST = 38


def count_rows(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("value"))


def _exact(rows: DataFrame, expr: str) -> tuple[Column, int]:
    """The values in the widest decimal of their own scale (floating point: FLOAT_SCALE), and the scale to tell them with."""
    kind = rows.select(F.expr(expr).alias("value")).schema["value"].dataType
    own = kind.scale if isinstance(kind, DecimalType) else FLOAT_SCALE if kind.typeName() in ("double", "float") else 0
    told = own if isinstance(kind, DecimalType) else TOLD_SCALE
    return F.expr(expr).cast(DecimalType(WIDEST, own)), max(told, TOLD_SCALE) if own <= TOLD_SCALE else told


def sum_of(rows: DataFrame, expr: str) -> DataFrame:
    """A decimal; 0 over no rows. Decimals keep their scale, six at least. Floating-point numbers are added with twelve
    decimals, so up to 26 digits before the point, and told with six; cast them to a decimal for more."""
    value, scale = _exact(rows, expr)
    return rows.agg(F.coalesce(F.sum(value), F.lit(0)).cast(DecimalType(WIDEST, scale)).alias("value"))


def average_of(rows: DataFrame, expr: str) -> DataFrame:
    """A double, the quotient of the exact sum and the number of values; 0.0 over no rows."""
    value, _ = _exact(rows, expr)
    return rows.agg(F.coalesce(F.sum(value).cast("double") / F.nullif(F.count(value), F.lit(0)), F.lit(0.0)).cast("double").alias("value"))


def extreme_of(rows: DataFrame, expr: str, greatest: bool) -> DataFrame:
    """The greatest or least value; over no rows zero for numbers, null for text and times."""
    picked = rows.select(F.expr(expr).alias("value")).agg((F.max if greatest else F.min)("value").alias("value"))
    zero = ZERO.get(picked.schema["value"].dataType.typeName(), 0)
    return picked if zero is None else picked.select(F.coalesce("value", F.lit(zero)).cast(picked.schema["value"].dataType).alias("value"))
