"""Incremental processing with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def process_new(spark: SparkSession, source: str, schema: StructType, target: str, state: str, transform, files_a_batch: int = 4) -> None:
    """Transform files of `source` that no earlier call has, and append to `target`;
    `state` keeps what was done, so that a run that stopped goes on where it was."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    query = transform(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and window; works on streams, which forget after `late`."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def since(log: DataFrame, cursor: int, most: int) -> DataFrame:
    """Entries after a cursor, the newest `most` of all at that; in order."""
    newest = log.orderBy(F.desc("event_id")).limit(most)
    return newest.where(F.col("event_id") > cursor)
