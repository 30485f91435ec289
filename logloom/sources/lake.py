"""An index of many logs: Parquet files in a fixed number of folders, and a manifest of what each file holds.

Sources are dealt to ``buckets`` folders by hash, however many there are; inside,
files follow (source, line). Every load is a folder of its own, with statistics
of each source, from which base times and log metadata are read without the
events. Its manifest, one row per file with the ranges of sources, lines and
times and the categories, is written last: a load counts from then on, and one
that failed is not seen. Readers choose files by manifest, before any of them is
opened.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.severity import rank_of, severity_rank
from logloom.functions.text import fold
from logloom.schema import EVENT_COLUMNS, EVENT_SCHEMA
from logloom.sources.scratch import settle

BUCKETS = 64
# A file with more categories than this is read for any of them.
LISTED_CATEGORIES = 256
STORED = T.StructType(
    [
        *EVENT_SCHEMA.fields,
        T.StructField("category_key", T.StringType()),
        T.StructField("severity_rank", T.IntegerType()),
    ]
)
MANIFEST = (
    "file string, bucket int, events bigint, first_source string, last_source string, first_line bigint, "
    "last_line bigint, first_timestamp timestamp_ntz, last_timestamp timestamp_ntz, highest_rank int, "
    "categories array<string>"
)


def _bucket(source: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(buckets)).cast("int")


def write_lake(events: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Add events to the lake at ``path``; the number of buckets is the same for all loads of a lake.

    Ranges of (bucket, source, line) keep a dominant source spread over many
    tasks, and the number of files near the number of tasks and buckets.
    """
    spark, load = events.sparkSession, f"load={uuid.uuid4().hex}"
    keyed = events.select(
        *EVENT_COLUMNS,
        fold(F.col("category")).alias("category_key"),
        severity_rank(F.col("verbosity")).alias("severity_rank"),
        _bucket(F.col("source_id"), buckets).alias("bucket"),
    )
    order = ["bucket", "source_id", "line_number"]
    # Written down first, or everything before would run for the sample of the ranges once more.
    rows = settle(keyed, "to-sort").repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.partitionBy("bucket").parquet(f"{path}/events/{load}")

    schema = T.StructType([*STORED.fields, T.StructField("bucket", T.IntegerType())])
    written = spark.read.schema(schema).parquet(f"{path}/events/{load}").withColumn("file", F.col("_metadata.file_path"))
    by_category = written.groupBy("file", "bucket", "category_key").agg(
        F.count(F.lit(1)).alias("events"),
        F.min("source_id").alias("first_source"),
        F.max("source_id").alias("last_source"),
        F.min("line_number").alias("first_line"),
        F.max("line_number").alias("last_line"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
        F.max("severity_rank").alias("highest_rank"),
    )
    per_source = written.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.min("line_number").alias("first_line"),
        F.max("line_number").alias("last_line"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
    )
    per_source.write.parquet(f"{path}/sources/{load}")
    place = F.row_number().over(Window.partitionBy("file").orderBy("category_key"))
    listed = by_category.withColumn("_place", place)
    named = F.sort_array(F.collect_list(F.when(F.col("_place") <= LISTED_CATEGORIES, F.col("category_key"))))
    files = listed.groupBy("file", "bucket").agg(
        F.sum("events").alias("events"),
        F.min("first_source").alias("first_source"),
        F.max("last_source").alias("last_source"),
        F.min("first_line").alias("first_line"),
        F.max("last_line").alias("last_line"),
        F.min("first_timestamp").alias("first_timestamp"),
        F.max("last_timestamp").alias("last_timestamp"),
        F.max("highest_rank").alias("highest_rank"),
        F.when(F.max("_place") <= LISTED_CATEGORIES, named).alias("categories"),
    )
    files.coalesce(1).write.parquet(f"{path}/manifest/{load}")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of the finished loads, with ``load``."""
    return spark.read.schema(f"{MANIFEST}, load string").parquet(f"{path}/manifest")


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Statistics per source over all finished loads: events, range of lines, range of times."""
    schema = (
        "source_id string, events bigint, first_line bigint, last_line bigint, first_timestamp timestamp_ntz, "
        "last_timestamp timestamp_ntz, load string"
    )
    finished = read_manifest(spark, path).select("load").distinct()
    stored = spark.read.schema(schema).parquet(f"{path}/sources").join(finished, "load", "left_semi")
    return stored.groupBy("source_id").agg(
        F.sum("events").alias("events"),
        F.min("first_line").alias("first_line"),
        F.max("last_line").alias("last_line"),
        F.min("first_timestamp").alias("first_timestamp"),
        F.max("last_timestamp").alias("last_timestamp"),
    )


def base_timestamps(spark: SparkSession, path: str) -> DataFrame:
    """Earliest timestamp of each source, as stored."""
    return read_sources(spark, path).select("source_id", F.col("first_timestamp").alias("base_timestamp"))


def read_lake(
    spark: SparkSession,
    path: str,
    sources: Sequence[str] | None = None,
    categories: Sequence[str] | None = None,
    since: datetime | None = None,
    until: datetime | None = None,
    min_verbosity: str | None = None,
) -> DataFrame:
    """Events of the lake that meet all that is asked for, with ``category_key`` and ``severity_rank``.

    ``since`` and ``until`` are points in time, both included; an event without
    a time meets neither. Only files whose row in the manifest may hold such
    events are opened. Their names pass through the driver.
    """
    files, rows = F.lit(True), F.lit(True)
    if sources is not None:
        inside = [F.lit(s).between(F.col("first_source"), F.col("last_source")) for s in sources]
        files &= reduce(lambda a, b: a | b, inside, F.lit(False))
        rows &= F.col("source_id").isin(*sources)
    if categories is not None:
        keys = [c.lower() for c in categories]
        files &= F.col("categories").isNull() | F.arrays_overlap("categories", F.array(*map(F.lit, keys)).cast("array<string>"))
        rows &= F.col("category_key").isin(*keys)
    if min_verbosity is not None:
        files &= F.col("highest_rank") >= rank_of(min_verbosity)
        rows &= F.col("severity_rank") >= rank_of(min_verbosity)
    for limit, own, meets in (
        (since, "last_timestamp", lambda column, at: column >= at),
        (until, "first_timestamp", lambda column, at: column <= at),
    ):
        if limit is not None:
            at = F.lit(limit.isoformat(" ")).cast("timestamp_ntz")
            files &= meets(F.col(own), at)
            rows &= meets(F.col("timestamp"), at)
    names = [row["file"] for row in read_manifest(spark, path).where(files).select("file").collect()]
    if not names:
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(*names).where(rows)
