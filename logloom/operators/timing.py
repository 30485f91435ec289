"""Relative time, silent stretches and log metadata."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import fold
from logloom.operators.filters import with_base_timestamp
from logloom.operators.ordered import BLOCK, BLOCK_KEYS, BLOCK_ROWS, across_blocks, block_table, in_block, with_block


def with_relative_time(
    events: DataFrame, bases: DataFrame | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Fill ``relative_time`` with the offset from the earliest timestamp of the source."""
    based = with_base_timestamp(events, bases, block_rows)
    return based.withColumn("relative_time", F.col("timestamp") - F.col("base_timestamp")).select(*events.columns)


def time_gaps(events: DataFrame, threshold: timedelta, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Silences longer than ``threshold`` between neighbouring timestamped events.

    Inside a block a plain lag; between blocks the gap follows from one row per
    block, so no event is joined with anything.
    """
    timed = with_block(
        events.filter(F.col("timestamp").isNotNull()).select("source_id", "line_number", "timestamp"), block_rows
    )
    order = in_block()
    inside = timed.select(
        *BLOCK_KEYS,
        F.lag("line_number").over(order).alias("previous_line"),
        "line_number",
        F.lag("timestamp").over(order).alias("previous_timestamp"),
        "timestamp",
    ).drop(BLOCK)
    borders = block_table(
        timed,
        F.min("line_number").alias("line_number"),
        F.max("line_number").alias("_last_line"),
        F.min_by("timestamp", "line_number").alias("timestamp"),
        F.max_by("timestamp", "line_number").alias("_last_timestamp"),
    ).select(
        "source_id",
        F.lag("_last_line").over(across_blocks()).alias("previous_line"),
        "line_number",
        F.lag("_last_timestamp").over(across_blocks()).alias("previous_timestamp"),
        "timestamp",
    )
    gap = F.col("timestamp") - F.col("previous_timestamp")
    return inside.unionByName(borders).withColumn("gap", gap).filter(F.col("gap") > F.lit(threshold))


def log_metadata(events: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Per source: event count, categories, time range and, given the lines, physical lines."""
    counts = events.groupBy("source_id", fold(F.col("category")).alias("_category")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last")
    )
    metadata = counts.groupBy("source_id").agg(
        F.sum("_n").alias("event_count"),
        F.count(F.lit(1)).alias("category_count"),
        F.min("_first").alias("first_timestamp"),
        F.max("_last").alias("last_timestamp"),
    ).withColumn("duration", F.col("last_timestamp") - F.col("first_timestamp"))
    if lines is None:
        return metadata.withColumn("physical_lines", F.lit(None).cast("bigint"))
    physical = lines.groupBy("source_id").agg(F.count(F.lit(1)).alias("physical_lines"))
    return metadata.join(physical, "source_id", "left")
