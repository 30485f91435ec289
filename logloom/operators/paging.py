"""Pages, context windows and previews of ordered events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.text import shorten
from logloom.operators.ordered import BLOCK_ROWS, with_event_index
from logloom.schema import ORDER_KEYS
from logloom.sources.scratch import settle

# Fixed value: rows of a preview.
PREVIEW_ROWS = 500
# Pages reaching further into the log are cut by event index instead of by a
# top-k, whose rows all pass through one task.
TOP_K_REACH = 100_000


@dataclass(frozen=True)
class Page:
    """A page of matches. ``total`` is one row, ``total_matches``, also when the page is empty."""

    offset: int
    limit: int
    events: DataFrame
    total: DataFrame


def page(matches: DataFrame, offset: int, limit: int, block_rows: int = BLOCK_ROWS) -> Page:
    """Rows ``offset .. offset + limit`` in log order; negative numbers count as 0."""
    offset, limit = max(0, offset), max(0, limit)
    total = matches.agg(F.count(F.lit(1)).alias("total_matches"))
    if offset + limit <= TOP_K_REACH:
        rows = matches.orderBy(*ORDER_KEYS).offset(offset).limit(limit)
    else:
        rows = _index_slice(matches, offset, limit, block_rows)
    return Page(offset, limit, rows, total)


def _index_slice(matches: DataFrame, offset: int, limit: int, block_rows: int) -> DataFrame:
    """The matches are written down once; only their places are numbered, and the rows of the page fetched."""
    written = settle(matches, "matches")
    indexed = with_event_index(written.select(*ORDER_KEYS), "_index", block_rows, across_sources=True)
    inside = (F.col("_index") >= offset) & (F.col("_index") < offset + limit)
    return written.join(indexed.filter(inside).select(*ORDER_KEYS), ORDER_KEYS, "left_semi").orderBy(*ORDER_KEYS)


def context_window(events: DataFrame, source_id: str, line: int, before: int, after: int) -> DataFrame:
    """The event at ``line`` with its neighbours; empty when no event has that line number."""
    before, after = max(0, before), max(0, after)
    log = events.filter(F.col("source_id") == source_id)
    earlier = log.filter(F.col("line_number") < line).orderBy(F.desc("line_number")).limit(before)
    later = log.filter(F.col("line_number") >= line).orderBy("line_number").limit(after + 1)
    anchor = log.filter(F.col("line_number") == line).select("source_id").limit(1)
    return earlier.unionByName(later).join(F.broadcast(anchor), "source_id", "left_semi")


def context_many(
    events: DataFrame, anchors: DataFrame, before: int, after: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Context of many anchors (``source_id, line_number``) at once, with column ``anchor_line``.

    The events are written down once, and only their places are numbered. An
    anchor is an interval of positions. Intervals of a source that overlap or
    touch become one, so that however close anchors stand, every position is
    looked up once; the lines found are then dealt out to the anchors around
    them by equi joins. Anchors that are not events yield nothing.
    """
    before, after = max(0, before), max(0, after)
    written = settle(events, "events")
    index = settle(with_event_index(written.select(*ORDER_KEYS), "_index", block_rows), "places")
    wanted = anchors.select(*ORDER_KEYS).distinct()
    found = settle(index.join(wanted, ORDER_KEYS).select("source_id", F.col("line_number").alias("anchor_line"), "_index"), "anchors")
    lines = index.join(_positions(found, before, after, block_rows), ["source_id", "_index"])
    # Every line names the positions at which an anchor would show it.
    reach = F.sequence(F.greatest(F.col("_index") - after, F.lit(0)), F.col("_index") + before)
    around = lines.withColumn("_index", F.explode(reach)).join(found, ["source_id", "_index"]).drop("_index")
    return written.join(around, ORDER_KEYS)


def _positions(found: DataFrame, before: int, after: int, block_rows: int) -> DataFrame:
    """The positions in the merged intervals of the anchors, each once; clipped to blocks of positions on the way."""
    first, last = F.greatest(F.col("_index") - before, F.lit(0)), F.col("_index") + after
    block = F.sequence(F.expr(f"_first div {int(block_rows)}L"), F.expr(f"_last div {int(block_rows)}L"))
    spans = found.select("source_id", first.alias("_first"), last.alias("_last"))
    clipped = spans.withColumn("_block", F.explode(block)).select(
        "source_id",
        "_block",
        F.greatest("_first", F.col("_block") * block_rows).alias("_first"),
        F.least("_last", (F.col("_block") + 1) * block_rows - 1).alias("_last"),
    )
    order = Window.partitionBy("source_id", "_block").orderBy("_first", "_last")
    reached = F.max("_last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # What an interval adds to those that begin before it.
    own = clipped.withColumn("_first", F.greatest("_first", F.coalesce(reached + 1, F.lit(0))))
    return own.where("_first <= _last").select("source_id", F.explode(F.sequence("_first", "_last")).alias("_index"))


def preview(matches: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first matches as fixed-width text rows, in column ``row``."""
    text = F.format_string(
        "%6d %-18s %-7s %s",
        F.col("line_number"),
        shorten(F.col("category"), 18),
        shorten(F.col("verbosity"), 7),
        shorten(F.col("message"), 100),
    )
    return matches.orderBy(*ORDER_KEYS).limit(rows).select(*ORDER_KEYS, text.alias("row"))
