"""Resumable increments: what has been read stays read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def increment(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Appends the transform of the files that are new in ``source`` to ``target``, then ends.

    The checkpoint knows what was read, so that a second run adds nothing and a broken one goes on.
    """
    rows = spark.readStream.schema(schema).parquet(source)
    query = transform(rows).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def pending(items: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    return items.join(processed.select(key).distinct(), key, "left_anti")


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums by event type in tumbling windows, over a stream or a table; late rows count up to ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
