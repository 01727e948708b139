"""Event-time windows, the same over a stream and over a table. Beyond the reference's own operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(rows: DataFrame, window: Column, *keys: str, watermark: str | None = None, time: str = "ts", **aggregates: Column) -> DataFrame:
    """Aggregates by window and keys; over a stream, ``watermark`` says how late rows may come. Watermarks need a
    timestamp with a zone, so a stream's zoneless times are read in the session's zone."""
    source = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, watermark) if watermark and rows.isStreaming else rows
    out = source.groupBy(window.alias("_w"), *keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, *aggregates)


def tumbling(rows: DataFrame, size: str, *keys: str, time: str = "ts", watermark: str | None = None, **aggregates: Column) -> DataFrame:
    return windowed(rows, F.window(time, size), *keys, watermark=watermark, time=time, **aggregates)


def sliding(rows: DataFrame, size: str, step: str, *keys: str, time: str = "ts", watermark: str | None = None, **aggregates: Column) -> DataFrame:
    return windowed(rows, F.window(time, size, step), *keys, watermark=watermark, time=time, **aggregates)


def sessions(rows: DataFrame, gap: str, *keys: str, time: str = "ts", watermark: str | None = None, **aggregates: Column) -> DataFrame:
    return windowed(rows, F.session_window(time, gap), *keys, watermark=watermark, time=time, **aggregates)
