"""De-duplication of events: none, exact, normalized and burst."""

from __future__ import annotations

from datetime import timedelta
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.redaction import STANDARD_RULES, RedactionRule
from logloom.operators.ordered import (
    BLOCK,
    BLOCK_KEYS,
    BLOCK_ROWS,
    across_blocks,
    block_table,
    in_block,
    with_block,
)
from logloom.operators.redact import redact
from logloom.sources.scratch import settle, sized_lookup

# What a de-duplicated text needs of an event.
KEY_COLUMNS = ["source_id", "line_number", "timestamp", "category", "verbosity", "message", "continuation_lines"]
# The longest pause inside a burst, and the joint of the
# continuation lines in the key.
BURST_WINDOW = timedelta(seconds=10)
CONTINUATION_JOINT = "\x1f"


class DedupeMode(Enum):
    NONE = "none"
    EXACT = "exact"
    NORMALIZED = "normalized"
    BURST = "burst"

    @classmethod
    def parse(cls, name: str) -> DedupeMode:
        """By name in any letter case, or by position in the list of modes; all else is refused."""
        for position, mode in enumerate(cls):
            if name.strip().lower() in (mode.value, str(position)):
                return mode
        raise ValueError(f"invalid dedupe mode {name!r}, expected one of: {', '.join(m.value for m in cls)}")


def key_digest() -> Column:
    """Digest of (category, verbosity, message, joined continuation), case-sensitive.

    Lengths go in front of the parts, so that no two keys share a text.
    """
    parts = ["category", "verbosity", "message"]
    joined = F.concat_ws(CONTINUATION_JOINT, "continuation_lines")
    lengths = F.concat_ws(",", *[F.length(part).cast("string") for part in parts])
    return F.unhex(F.sha2(F.concat_ws(CONTINUATION_JOINT, lengths, *parts, joined).cast("binary"), 256))


def deduplicate(
    events: DataFrame,
    mode: DedupeMode | str,
    block_rows: int = BLOCK_ROWS,
    rules: tuple[RedactionRule, ...] = STANDARD_RULES,
) -> DataFrame:
    """Events with ``count``; in bursts also ``span``, the time from first to last.

    ``rules`` say what the normalized form does not tell apart; a profile has
    its own (``normalizing_rules``).
    """
    mode = DedupeMode.parse(mode) if isinstance(mode, str) else mode
    if mode is DedupeMode.NONE:
        return events.withColumn("count", F.lit(1).cast("bigint"))
    if mode is DedupeMode.EXACT:
        return dedupe_by_key(events)
    if mode is DedupeMode.NORMALIZED:
        return dedupe_by_key(redact(events, rules))
    return dedupe_bursts(events, block_rows)


def dedupe_by_key(events: DataFrame) -> DataFrame:
    """One row per key and source: the first occurrence, with the number of occurrences.

    Copies are combined before the shuffle, so a key that makes up much of the
    log arrives as one row per task.
    """
    columns = events.columns
    return (
        events.groupBy(key_digest().alias("_key"), "source_id")
        .agg(
            F.min_by(F.struct(*columns), "line_number").alias("_first"),
            F.count(F.lit(1)).alias("count"),
        )
        .select("_first.*", "count")
    )


def dedupe_bursts(events: DataFrame, block_rows: int = BLOCK_ROWS, window: timedelta = BURST_WINDOW) -> DataFrame:
    """Merge an event into the one just before it if keys agree and the pause is short.

    Runs are formed inside blocks and written down, one row per run with the
    event it begins with: that is the one look at the events. A run that
    crosses into later blocks is put together from the first and last run of
    each block, read back from that table. ``events`` may have any columns
    besides those of the key, the order and the time; all of them are written,
    so callers leave out what they do not need.
    """
    runs = settle(_runs_in_blocks(with_block(events, block_rows), window), "runs")
    seams = sized_lookup(_seams(runs, window), "seams")
    joined = runs.join(seams, BLOCK_KEYS, "left")
    extra = F.when(F.col("_is_last") & F.col("_extra").isNotNull(), F.col("_extra"))
    end = F.when(F.col("_is_last") & F.col("_extra").isNotNull(), F.col("_extra_end")).otherwise(F.col("_end"))
    return joined.filter(~(F.col("_is_first") & F.coalesce("_absorbed", F.lit(False)))).select(
        *events.columns,
        (F.col("_size") + F.coalesce(extra, F.lit(0))).alias("count"),
        (end - F.col("timestamp")).alias("span"),
    )


def _continues(key: Column, last_key: Column, time: Column, last_time: Column, window: timedelta) -> Column:
    return F.coalesce((key == last_key) & (time - last_time <= F.lit(window)), F.lit(False))


def _runs_in_blocks(blocked: DataFrame, window: timedelta) -> DataFrame:
    """The first event of each run inside its block.

    Adds ``_key, _size, _end`` (timestamp of the last event), ``_is_first`` and
    ``_is_last`` run of the block. All windows share one partitioning and sort.
    """
    order = in_block()
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = blocked.withColumn("_key", key_digest()).withColumns(
        {
            "_rank": F.row_number().over(order),
            "_last_key": F.lag("_key").over(order),
            "_last_time": F.lag("timestamp").over(order),
            "_rows": F.count(F.lit(1)).over(whole),
            "_block_end": F.last("timestamp").over(whole),
        }
    )
    starts = marked.filter(
        ~_continues(F.col("_key"), F.col("_last_key"), F.col("timestamp"), F.col("_last_time"), window)
    )
    following = F.lead("_rank").over(order)
    return starts.withColumns(
        {
            "_size": (F.coalesce(following, F.col("_rows") + 1) - F.col("_rank")).cast("bigint"),
            "_end": F.when(following.isNull(), F.col("_block_end")).otherwise(F.lead("_last_time").over(order)),
            "_is_first": F.col("_rank") == 1,
            "_is_last": following.isNull(),
        }
    ).drop("_last_key", "_last_time", "_rows", "_block_end", "_rank")


def _seams(runs: DataFrame, window: timedelta) -> DataFrame:
    """Per block: is its first run absorbed by an earlier block, and what does its last run absorb."""
    edge = F.struct("_key", "timestamp", "_end", "_size")
    blocks = block_table(
        runs.filter(F.col("_is_first") | F.col("_is_last")),
        F.max(F.when(F.col("_is_first"), edge)).alias("_head"),
        F.max(F.when(F.col("_is_last"), edge)).alias("_tail"),
        F.bool_or(F.col("_is_first") & F.col("_is_last")).alias("_single"),
    )
    before = across_blocks()
    tail = F.lag("_tail").over(before)
    linked = blocks.withColumns(
        {
            "_absorbed": _continues(
                F.col("_head._key"), tail["_key"], F.col("_head.timestamp"), tail["_end"], window
            ),
            "_previous": F.lag(BLOCK).over(before),
            "_previous_single": F.coalesce(F.lag("_single").over(before), F.lit(False)),
        }
    )
    # A chain passes through a block that is one absorbed run from end to end.
    through = F.col("_previous_single") & F.coalesce(F.lag("_absorbed").over(before), F.lit(False))
    owner = F.last(F.when(F.col("_absorbed") & ~F.col("_through"), F.col("_previous")), ignorenulls=True)
    owned = linked.withColumn("_through", through).withColumn("_owner", owner.over(before))
    gains = (
        owned.filter("_absorbed")
        .groupBy("source_id", F.col("_owner").alias(BLOCK))
        .agg(
            F.sum("_head._size").alias("_extra"),
            F.max_by("_head._end", BLOCK).alias("_extra_end"),
        )
    )
    absorbed = owned.filter("_absorbed").select(*BLOCK_KEYS, "_absorbed")
    return absorbed.join(gains, BLOCK_KEYS, "full_outer")


def top_repeated(events: DataFrame, limit: int) -> DataFrame:
    """The most repeated redacted messages over all sources, ties by first occurrence."""
    key = ["category", "verbosity", "message", "continuation"]
    keyed = redact(events).withColumn("continuation", F.concat_ws(CONTINUATION_JOINT, "continuation_lines"))
    per_source = keyed.groupBy(*key, "source_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("line_number").alias("_line")
    )
    return (
        per_source.groupBy(*key)
        .agg(F.sum("_n").alias("count"), F.min(F.struct("source_id", "_line")).alias("_first"))
        .orderBy(F.desc("count"), "_first")
        .limit(limit)
        .select(*key, "count")
    )
