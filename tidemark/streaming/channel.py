"""Notification channels as Structured Streaming: messages are rows in a channel's folder, listeners are streaming queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.errors import QueryError

SCHEMA = "channel string, payload string, sent timestamp"


@dataclass(frozen=True)
class Channels:
    """Channels under one folder. Unlike a database's notifications, messages sent while nobody listens are kept, and a
    listener that starts again from its checkpoint gets each of them once."""

    spark: SparkSession
    root: str

    def _folder(self) -> str:
        return f"{self.root.rstrip('/')}/messages"

    def notify(self, channel: str, payload: str = "") -> None:
        if not channel or len(payload.encode()) > 8000:
            raise QueryError("a channel has a name, and a payload has up to 8000 bytes")
        row = self.spark.createDataFrame([(channel, payload)], "channel string, payload string").withColumn("sent", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(self._folder())

    def stream(self, *channels: str) -> DataFrame:
        """An unbounded frame of the channels' messages."""
        rows = self.spark.readStream.schema(SCHEMA).parquet(self._folder())
        return rows.where(F.col("channel").isin(*channels)) if channels else rows

    def listen(self, *channels: str, on_message: Callable[[str, str], None], on_error: Callable[[Exception], None] | None = None, name: str | None = None, once: bool = False) -> StreamingQuery:
        """Starts a listener; ``stop()`` of what it returns ends it. A handler's error goes to ``on_error`` or ends the query."""

        def deliver(batch: DataFrame, _: int) -> None:
            for row in batch.orderBy("sent").toLocalIterator():
                try:
                    on_message(row["channel"], row["payload"])
                except Exception as error:
                    if on_error is None:
                        raise
                    on_error(error)

        checkpoint = f"{self.root.rstrip('/')}/checkpoints/{name or uuid.uuid4().hex}"
        writer = self.stream(*channels).writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
