"""Comparing two logs: alignment by time, by order, and where they diverge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.time import minute_slice
from logloom.operators.dedupe import key_digest
from logloom.operators.findings import TEXTS, Findings, judged
from logloom.operators.ordered import BLOCK, BLOCK_ROWS, carried, with_block, with_event_index
from logloom.operators.redact import redact
from logloom.operators.semantics import FALLBACKS
from logloom.plans.rules import DEFAULT_RULES, SemanticRule
from logloom.schema import ORDER_KEYS
from logloom.sources.scratch import settle

# Keys under one digest.
DIGEST_FAN = 1024


def align_by_time(events: DataFrame, left: str, right: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each timestamped event of ``left`` the last event of ``right`` at or before it.

    Places and times are written down once. Both sides are then reduced to their
    distinct timestamps, so any number of events at one instant costs one row
    (per block on the left). A minute then holds a bounded number of rows, and
    minutes are the unit of work; the last match before a minute is carried in
    from a table of one row per minute.
    """
    timed = events.filter(F.col("timestamp").isNotNull() & F.col("source_id").isin(left, right))
    timed = settle(timed.select("source_id", "line_number", "timestamp"), "times")
    lefts = with_block(timed.filter(F.col("source_id") == left), block_rows)
    rights = (
        timed.filter(F.col("source_id") == right)
        .groupBy("timestamp")
        .agg(F.max("line_number").alias("_line"))
        .select("timestamp", F.lit(None).cast("bigint").alias(BLOCK), "_line")
    )
    instants = lefts.select("timestamp", BLOCK).distinct().withColumn("_line", F.lit(None).cast("bigint"))
    merged = rights.unionByName(instants).withColumn("_minute", minute_slice(F.col("timestamp")))
    is_right = F.col("_line").isNotNull()
    # At an equal timestamp the right side sorts first, so that it is a match.
    inside = (
        Window.partitionBy("_minute")
        .orderBy("timestamp", (~is_right).cast("int"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    match = F.when(is_right, F.struct(F.col("timestamp").alias("at"), F.col("_line").alias("line")))
    right_time = F.when(is_right, F.col("timestamp"))
    minutes = merged.groupBy("_minute").agg(
        F.max(right_time).alias("at"), F.max_by("_line", right_time).alias("line")
    )
    last = F.when(F.col("at").isNotNull(), F.struct("at", "line"))
    # A calendar has fewer than 2 ** 36 minutes.
    earlier = carried(minutes.select("_minute", last.alias("_last")), "_minute", "_last", "_carried", levels=2)
    matched = (
        merged.withColumn("_match", F.last(match, ignorenulls=True).over(inside))
        .filter(~is_right)
        .join(earlier, "_minute")
        .select("timestamp", BLOCK, F.coalesce("_match", "_carried").alias("_match"))
    )
    return lefts.join(matched, ["timestamp", BLOCK]).select(
        F.col("line_number").alias("left_line"),
        F.col("timestamp").alias("left_timestamp"),
        F.col("_match.line").alias("right_line"),
        F.col("_match.at").alias("right_timestamp"),
    )


def _keys(events: DataFrame, left: str, right: str, *more: str) -> DataFrame:
    """Place and redacted key of the events of both logs, and ``more`` of their columns, written down once."""
    pair = redact(events.filter(F.col("source_id").isin(left, right)))
    return settle(pair.select(*ORDER_KEYS, key_digest().alias("_key"), *more), "keys")


def _side_by_side(indexed: DataFrame, left: str) -> DataFrame:
    is_left = F.col("source_id") == left
    side = F.struct("line_number", "_key")
    both = indexed.groupBy("event_index").agg(
        F.max(F.when(is_left, side)).alias("_left"), F.max(F.when(~is_left, side)).alias("_right")
    )
    return both.select(
        "event_index",
        F.col("_left.line_number").alias("left_line"),
        F.col("_right.line_number").alias("right_line"),
        F.coalesce(F.col("_left._key") == F.col("_right._key"), F.lit(False)).alias("same"),
    )


def align_by_order(events: DataFrame, left: str, right: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The n-th event of ``left`` beside the n-th of ``right``; ``same`` compares redacted keys.

    A position without partner, when one log is longer, is not ``same``.
    """
    return _side_by_side(with_event_index(_keys(events, left, right), "event_index", block_rows), left)


def first_difference(indexed: DataFrame, left: str, fan: int = DIGEST_FAN) -> DataFrame | None:
    """The first position that is not ``same``, as a row; None if there is none.

    A tree of digests: one for every ``fan`` neighbouring keys of a log, one for
    every ``fan`` of these. The first block that differs is looked for from
    above, and only its events are put side by side.
    """
    leaves = indexed.select("source_id", F.expr(f"event_index div {fan}L").alias("_node"), "event_index", "_key")
    blocks = settle(_digests(leaves, "event_index", "_key"), "digests")
    parents = blocks.withColumn("_child", F.col("_node")).withColumn("_node", F.expr(f"_child div {fan}L"))
    top = _first_that_differs(_digests(parents, "_child", "_digest"), left)
    if top is None:
        return None
    block = _first_that_differs(blocks.where(F.expr(f"_node div {fan}L") == top), left)
    inside = indexed.where(F.col("event_index").between(block * fan, (block + 1) * fan - 1))
    different = _side_by_side(inside, left).where(~F.col("same"))
    row = F.struct("event_index", "left_line", "right_line")
    return different.agg(F.min_by(row, "event_index").alias("_first")).select("_first.*")


def _digests(rows: DataFrame, order: str, key: str) -> DataFrame:
    """One digest per log and node over the keys of at most ``fan`` rows, in order."""
    keys = F.transform(F.sort_array(F.collect_list(F.struct(order, key))), lambda pair: F.hex(pair[key]))
    return rows.groupBy("source_id", "_node").agg(F.unhex(F.sha2(F.array_join(keys, ""), 256)).alias("_digest"))


def _first_that_differs(digests: DataFrame, left: str) -> int | None:
    is_left = F.col("source_id") == left
    sides = digests.groupBy("_node").agg(
        F.max(F.when(is_left, F.col("_digest"))).alias("_left"), F.max(F.when(~is_left, F.col("_digest"))).alias("_right")
    )
    return sides.where(~F.col("_left").eqNullSafe(F.col("_right"))).agg(F.min("_node")).first()[0]


def divergence(
    events: DataFrame,
    left: str,
    right: str,
    rules: Sequence[SemanticRule] = DEFAULT_RULES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row: first position that differs, first failure of each side, who went on alone.

    ``continued`` names the side without a failure that still has events after
    the other side's failure. The events are judged and their redacted keys
    taken in one look; the rest reads that narrow table and the table of
    positions.
    """
    pair = judged(events.filter(F.col("source_id").isin(left, right)), rules, None)
    bits = [c for c in pair.columns if c.startswith("bits_")]
    keys = _keys(pair, left, right, "timestamp", "level", *bits, *TEXTS)
    indexed = settle(
        with_event_index(keys.select(*ORDER_KEYS, "_key"), "event_index", block_rows), "positions"
    )
    named = F.lit(f"{left}|{right}").alias("pair")
    differs = first_difference(indexed, left)
    if differs is None:
        differs = events.sparkSession.createDataFrame(
            [(None, None, None)], "event_index bigint, left_line bigint, right_line bigint"
        )
    differs = differs.select(named, "*")
    failures = Findings(keys, (*rules, *FALLBACKS)).first_failure()
    ends = keys.groupBy("source_id").agg(F.max("timestamp").alias("_end"))
    sides = ends.join(failures, "source_id", "left")

    def of(source: str, column: str, name: str):
        return F.max(F.when(F.col("source_id") == source, F.col(column))).alias(name)

    facts = sides.agg(
        of(left, "line_number", "left_failure_line"),
        of(left, "kind", "left_failure_kind"),
        of(left, "timestamp", "_left_at"),
        of(left, "_end", "_left_end"),
        of(right, "line_number", "right_failure_line"),
        of(right, "kind", "right_failure_kind"),
        of(right, "timestamp", "_right_at"),
        of(right, "_end", "_right_end"),
    )
    left_failed, right_failed = F.col("left_failure_line").isNotNull(), F.col("right_failure_line").isNotNull()
    continued = F.when(left_failed & ~right_failed & (F.col("_right_end") > F.col("_left_at")), F.lit(right)).when(
        right_failed & ~left_failed & (F.col("_left_end") > F.col("_right_at")), F.lit(left)
    )
    failed = facts.select(
        named,
        "left_failure_line",
        "left_failure_kind",
        "right_failure_line",
        "right_failure_kind",
        continued.alias("continued"),
    )
    return failed.join(differs, "pair")
