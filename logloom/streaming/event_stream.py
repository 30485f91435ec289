"""Structured Streaming over events.

Redaction and filters are stateless, so the batch functions apply unchanged.
Bursts keep a state (``burst_state``). Stitching lines stays a batch job:
micro-batches of files carry no line order from one to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from logloom.schema import EVENT_COLUMNS, EVENT_SCHEMA
from logloom.sinks.event_files import to_ndjson
from logloom.sources.event_files import parse_json_events


def stream_json_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Events from a folder to which JSON-lines files are added."""
    reader = spark.readStream.format("text")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return parse_json_events(reader.load(path)).select(*EVENT_COLUMNS)


def stream_parquet_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def write_json_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is available as JSON lines and stop; restarts go on from the checkpoint."""
    return (
        to_ndjson(events)
        .writeStream.format("text")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

