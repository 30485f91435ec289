"""Order-dependent work without one task per source.

A window over ``partitionBy(source_id)`` would put a whole source, possibly a
third of all rows, into one task. Here a source is cut into ordered blocks of
bounded size. Work inside a block is an ordinary window over
``(source_id, block)``; what one block owes the next is a single small row per
block, carried over by a window across the block table only and joined back on
the same two keys the rows are already partitioned by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from logloom.sources.scratch import settle

BLOCK = "_block"
BLOCK_KEYS = ["source_id", BLOCK]
# Lines per block of a numbered source: some hundred megabytes of rows, and
# fewer than a million block rows for 10^12 lines.
BLOCK_ROWS = 1 << 20


def with_block(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return df.withColumn(BLOCK, F.expr(f"line_number div {int(block_rows)}L"))


def in_block(order: str = "line_number") -> WindowSpec:
    return Window.partitionBy(*BLOCK_KEYS).orderBy(order)


def so_far_in_block(order: str = "line_number") -> WindowSpec:
    return in_block(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def across_blocks() -> WindowSpec:
    """For block tables only: one row per block."""
    return Window.partitionBy("source_id").orderBy(BLOCK)


def earlier_blocks() -> WindowSpec:
    return across_blocks().rowsBetween(Window.unboundedPreceding, -1)


def block_table(df: DataFrame, *aggregates: Column) -> DataFrame:
    return df.groupBy(*BLOCK_KEYS).agg(*aggregates)


# Rows of a table of blocks that one window looks at are at most this many, as a power of two.
GROUP_BITS = 12


def carried(
    table: DataFrame,
    order: str,
    value: str,
    output: str,
    keys: Sequence[str] = (),
    total: bool = False,
    bits: int = GROUP_BITS,
    levels: int = 5,
) -> DataFrame:
    """``keys``, ``order`` and what the rows before each row hand on to it, as ``output``.

    That is the last ``value`` that is not null, or the sum of values if
    ``total``. ``order`` is a whole number, unique within the keys, of at most
    ``bits * (levels + 1)`` bits. Rows are taken in groups by their leading
    bits, groups in groups again, so every window is keyed and short however
    long the table is.
    """
    rows = table.select(*keys, F.col(order).alias("_place"), F.col(value).alias("_value"))
    up = f"_up{levels}"
    # The last level is one group, of both signs.
    rows = rows.withColumn(up, F.shiftright("_place", bits) if levels else F.col("_place") * 0)
    before = Window.partitionBy(*keys, up).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    if total:
        inside, whole = F.coalesce(F.sum("_value").over(before), F.lit(0)), F.sum("_value")
    else:
        inside = F.last("_value", ignorenulls=True).over(before)
        whole = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_place")))
    local = rows.select(*keys, F.col("_place").alias(order), up, inside.alias("_inside"))
    if levels == 0:
        return local.select(*keys, order, F.col("_inside").alias(output))
    above = rows.groupBy(*keys, up).agg(whole.alias("_value"))
    handed = carried(above, up, "_value", "_handed", keys, total, bits, levels - 1)
    both = F.col("_inside") + F.coalesce("_handed", F.lit(0)) if total else F.coalesce("_inside", "_handed")
    return local.join(handed, [*keys, up]).select(*keys, order, both.alias(output))


def _rows_of_sources_before(counts: DataFrame) -> DataFrame:
    """Per source the rows of all sources with a smaller name.

    Sources are cut into ranges of names, which are written down with the number
    of their range. Sums run inside the ranges, and over the table of ranges.
    """
    sizes = counts.groupBy("source_id").agg(F.sum("_rows").alias("_rows"))
    ranged = sizes.repartitionByRange("source_id").withColumn("_range", F.spark_partition_id().cast("bigint"))
    ranged = settle(ranged, "source-ranges")
    inside = Window.partitionBy("_range").orderBy("source_id").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("_range").agg(F.sum("_rows").alias("_rows"))
    # Ranges are shuffle partitions: two levels of groups hold 16 million.
    handed = carried(ranges, "_range", "_rows", "_handed", total=True, levels=1)
    local = ranged.withColumn("_inside", F.coalesce(F.sum("_rows").over(inside), F.lit(0)))
    return local.join(handed, "_range").select("source_id", (F.col("_inside") + F.col("_handed")).alias("_sources"))


def with_event_index(
    df: DataFrame, output: str = "event_index", block_rows: int = BLOCK_ROWS, across_sources: bool = False
) -> DataFrame:
    """Add the dense 0-based position of each event in its source.

    With ``across_sources`` the position runs on from source to source.
    """
    blocked = with_block(df, block_rows)
    counts = block_table(blocked, F.count(F.lit(1)).alias("_rows"))
    carry = counts.select(*BLOCK_KEYS, F.coalesce(F.sum("_rows").over(earlier_blocks()), F.lit(0)).alias("_before"))
    if across_sources:
        carry = carry.join(_rows_of_sources_before(counts), "source_id").select(
            *BLOCK_KEYS, (F.col("_before") + F.col("_sources")).alias("_before")
        )
    ranked = blocked.withColumn("_rank", F.row_number().over(in_block()))
    return (
        ranked.join(carry, BLOCK_KEYS)
        .withColumn(output, F.col("_before") + F.col("_rank") - 1)
        .drop(BLOCK, "_rank", "_before")
    )
