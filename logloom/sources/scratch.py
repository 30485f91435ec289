"""Tables written to the cluster's shared folder to cut lineage.

The folder is the session's ``spark.checkpoint.dir``. Only a local session
without that setting falls back to a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# What may be broadcast after its size has been counted.
BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 128 << 20
# Spark's setting that deletes an execution's shuffle files at its end, not when the driver next collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    chosen = tempfile.mkdtemp(prefix="logloom-")
    spark.conf.set("spark.checkpoint.dir", chosen)
    return chosen


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder, never used before."""
    return f"{scratch_root(spark)}/logloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete what this application wrote under the shared folder; tables read from it are gone then."""
    delete_folder(spark, f"{scratch_root(spark)}/logloom/{spark.sparkContext.applicationId}")


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settle(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once and return the table read back from the shared folder.

    What was shuffled for it is deleted as soon as the table is written. A
    caller that names the ``path`` may delete the table when it is used up.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Lookup:
    table: DataFrame
    small: bool


def settle_lookup(df: DataFrame, label: str) -> Lookup:
    """Settle a table meant to be looked up by ``source_id`` and count what is written.

    ``small`` is true when the count proves that the table may be broadcast.
    """
    seen = Observation()
    table = settle(
        df.observe(
            seen,
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(F.octet_length("source_id")), F.lit(0)).alias("text_bytes"),
        ),
        label,
    )
    # A task that ran twice is counted twice, which only errs towards "not small".
    rows, text_bytes = seen.get["rows"], seen.get["text_bytes"]
    return Lookup(table, rows <= BROADCAST_MAX_ROWS and text_bytes + 64 * rows <= BROADCAST_MAX_BYTES)


def sized_lookup(df: DataFrame, label: str) -> DataFrame:
    """A settled table, marked for broadcast if proven small; else Spark joins it by shuffle."""
    lookup = settle_lookup(df, label)
    return F.broadcast(lookup.table) if lookup.small else lookup.table
