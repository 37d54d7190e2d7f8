"""Periodic synchronisation, and source updates as a stream."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

log = logging.getLogger(__name__)


def poll(spark: SparkSession, synchronise: Callable[[], object], seconds: int = 60, checkpoint: str | None = None) -> StreamingQuery:
    """Calls synchronise() every so many seconds, never twice at once; a failure is logged and the next round goes on.

    File streams report neither deletions nor changes, so each round lists the files anew and compares.
    """

    def step(_: DataFrame, epoch: int) -> None:
        try:
            synchronise()
        except Exception:  # noqa: BLE001
            log.exception("synchronisation %d failed", epoch)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(step).trigger(processingTime=f"{seconds} seconds")
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def latest_updates(events: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Per window and source the number of updates and the newest: source updates as an unbounded table."""
    watermarked = events.withWatermark("ts", delay) if events.isStreaming else events
    return watermarked.groupBy(F.window("ts", window).alias("w"), "source").agg(F.count("*").alias("updates"), F.max("ts").alias("newest")).select(F.col("w.start").alias("window_start"), "source", "updates", "newest")
