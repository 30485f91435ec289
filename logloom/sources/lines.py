"""Text files as rows of physical lines."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.parsing import with_line_kind
from logloom.schema import LANDED_SCHEMA, LINE_SCHEMA
from logloom.sources.scratch import scratch_path


# A block's place in its source: the file's place, then the byte offset in the file (below 2 ** OFFSET_BITS).
OFFSET_BITS = 44
# Names of files that Spark reads as one split, and lines of a block that is cut from one.
COMPRESSED = r"(?i)\.(gz|gzip|zst|zstd|snappy|lz4|deflate|xz)$"
LANDED_LINES = 1 << 16
# Tasks of one look at text, at most: this many, or so many for every core.
SCAN_TASKS, SCAN_TASKS_PER_CORE = 1024, 64
MAX_TASKS = "spark.sql.files.maxPartitionNum"


@contextmanager
def packed_splits(spark: SparkSession) -> Iterator[None]:
    """Splits stay as they are cut, but a task reads many of them if there are more than tasks pay for.

    A split is a block, and may be as small as one likes: without this, each
    would be a task, and a file of its own in the landing.
    """
    if spark.conf.get(MAX_TASKS, None) is not None:
        yield
        return
    spark.conf.set(MAX_TASKS, str(max(SCAN_TASKS, SCAN_TASKS_PER_CORE * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.unset(MAX_TASKS)


def scan_lines(
    spark: SparkSession, path: str | list[str], source_id: Column | None = None, file_place: Column | None = None
) -> DataFrame:
    """Scan text; ``\\n``, ``\\r\\n`` and ``\\r`` end a line.

    Each file is a source, unless ``source_id`` (over ``_metadata``) gives
    several files one name: then ``file_place`` must number the files of a
    source in order, 0 to 2 ** 19 - 1. ``block`` is the place of the file and
    the byte offset of the file split; ``pos`` grows by one per line inside it,
    because one task reads a split in order and the id is taken directly above
    the scan. ``read_lines`` fails files that share a source and a place when
    they are numbered.
    """
    scanned = spark.read.text(path)
    location, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return scanned.select(
        (location if source_id is None else source_id).alias("source_id"),
        location.alias("source_path"),
        (start if file_place is None else F.shiftleft(file_place.cast("long"), OFFSET_BITS) + start).alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        "value",
    )


def read_lines(
    spark: SparkSession,
    path: str | list[str],
    source_id: Column | None = None,
    landing: str | None = None,
    file_place: Column | None = None,
    block_lines: int = LANDED_LINES,
) -> DataFrame:
    """Land the scanned lines as a table and return it.

    Numbering needs two looks at the lines, and split borders and ``pos`` are
    only the same in both if they were written down: a second scan may be cut
    differently when executors come or go. The table also makes the first look
    a narrow one. ``landing`` names the folder; by default it is a new one
    under the session's checkpoint folder.

    A compressed file is one split however large it is. It is read by one task
    once; its lines are landed as blocks of ``block_lines``, which are work of
    their own from then on.
    """
    lines = scan_lines(spark, path, source_id, file_place)
    # Ids of a task begin at a multiple of 2 ** 33. A later block takes a later byte of the file as its name.
    part = F.expr(f"(pos & {(1 << 33) - 1}L) div {int(block_lines)}L")
    block = F.when(F.rlike("source_path", F.lit(COMPRESSED)), F.col("block") + part).otherwise(F.col("block"))
    # A task may read files one after the other; every file has positions of its own, so that two never pass for one.
    pos = F.col("pos") + F.shiftleft(F.crc32(F.col("source_path").cast("binary")), 30)
    with packed_splits(spark):
        return _landed(lines.withColumns({"block": block, "pos": pos}), landing, block_lines)


def land_lines(lines: DataFrame, landing: str | None = None) -> DataFrame:
    """Land lines of another origin, with ``block`` and an order inside it, like those of a file."""
    keys = ["source_id", "block"]
    in_order = lines.repartition(*keys).sortWithinPartitions(*keys, "pos")
    return _landed(in_order.withColumn("pos", F.monotonically_increasing_id()), landing, LANDED_LINES)


def _landed(lines: DataFrame, landing: str | None, block_lines: int) -> DataFrame:
    target = landing or scratch_path(lines.sparkSession, "lines")
    judged = with_line_kind(lines.select(*LINE_SCHEMA.names)).withColumnsRenamed({"_starts": "starts", "_blank": "blank"})
    # Files of bounded size, so that what one task has read many can work on.
    judged.select(*LANDED_SCHEMA.names).write.option("maxRecordsPerFile", 16 * block_lines).parquet(target)
    return landed_lines(lines.sparkSession, target)


def landed_lines(spark: SparkSession, landing: str) -> DataFrame:
    return spark.read.schema(LANDED_SCHEMA).parquet(landing)
