"""Exact vector search: the measures of a nearest-neighbour query as array expressions. Beyond the reference's own operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, v: t + v)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda t, v: t + v))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def negative_inner_product(a: Column, b: Column) -> Column:
    return -dot(a, b)


MEASURES = {"l2": l2, "cosine": cosine_distance, "ip": negative_inner_product}


def nearest(rows: DataFrame, vector: str, target: list[float], k: int, measure: str = "l2", tie: str = "vec_id") -> DataFrame:
    """The k rows nearest to one vector: a scan and a top-k, without a sort of all rows."""
    distance = MEASURES[measure](F.col(vector), F.array(*[F.lit(float(x)) for x in target]))
    return rows.withColumn("distance", distance).orderBy(F.col("distance").asc(), F.col(tie).asc()).limit(k)
