"""Session settings the jobs profit from. Nothing depends on them for its result."""

from __future__ import annotations

from pyspark.sql import SparkSession

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Parsing is heavy per byte: small shuffles may stay spread over the cores.
    # Large ones are cut by the advisory size, not by this.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128KB",
}

# The JVM does not compile methods above 8000 bytes of code. In long tasks, wide
# projections run faster split into several methods, outside whole-stage code;
# in short ones the splitting costs more than it gains.
FOR_LARGE_TASKS = {**RECOMMENDED, "spark.sql.codegen.hugeMethodLimit": "8000"}


def tune(spark: SparkSession, large_tasks: bool = False) -> SparkSession:
    """Apply the recommended runtime settings to a session the caller owns."""
    for key, value in (FOR_LARGE_TASKS if large_tasks else RECOMMENDED).items():
        spark.conf.set(key, value)
    return spark
