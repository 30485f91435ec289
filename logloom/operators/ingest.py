"""Lines to events: numbering, head detection, stitching, parsing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.parsing import parse_heads, raw_text_hash, with_fields, with_line_kind, with_prefix
from logloom.functions.text import is_blank, strip, strip_left
from logloom.operators.ordered import (
    BLOCK,
    BLOCK_KEYS,
    block_table,
    earlier_blocks,
    in_block,
    so_far_in_block,
)
from logloom.sources.scratch import sized_lookup
from logloom.schema import DEFAULT_SCHEMA_VERSION, EVENT_COLUMNS


@dataclass(frozen=True)
class ParserOptions:
    """What the parse job keeps.

    ``strict_schema_version`` validates nothing: it only chooses between the
    expected and the default version text as the stamp on each event.
    """

    include_continuation_lines: bool = True
    capture_raw_text_hash: bool = True
    strict_schema_version: bool = True
    expected_schema_version: str = DEFAULT_SCHEMA_VERSION

    @property
    def stamp(self) -> str:
        return self.expected_schema_version if self.strict_schema_version else DEFAULT_SCHEMA_VERSION


def _contiguous_rows() -> Column:
    """Rows of a block, which fails if its positions have gaps, as when two files are taken for one."""
    rows = F.count(F.lit(1))
    gap = F.max("pos") - F.min("pos") + 1 != rows
    message = "a block has gaps: files of one source need a place each (file_place)"
    return F.when(gap, F.raise_error(F.lit(message)).cast("bigint")).otherwise(rows)


def number_lines(lines: DataFrame, contiguous: bool = False) -> DataFrame:
    """Add ``line_number``, 1-based per source; blank lines count.

    With ``contiguous`` (``pos`` grows by exactly one inside a block, as in
    landed text) the number is plain arithmetic on the block table, and no
    line is shuffled as long as that table may be broadcast.
    """
    blocked = lines.withColumnRenamed("block", BLOCK)
    rows = _contiguous_rows() if contiguous else F.count(F.lit(1))
    counts = block_table(blocked, rows.alias("_rows"), F.min("pos").alias("_first"))
    carry = counts.select(
        *BLOCK_KEYS, "_first", F.coalesce(F.sum("_rows").over(earlier_blocks()), F.lit(0)).alias("_before")
    )
    if contiguous:
        carry = sized_lookup(carry, "line-blocks")
        rank = F.col("pos") - F.col("_first") + 1
    else:
        blocked = blocked.withColumn("_rank", F.row_number().over(in_block("pos")))
        rank = F.col("_rank")
    return blocked.join(carry, BLOCK_KEYS).select(
        *[F.col(BLOCK).alias("block") if name == "block" else F.col(name) for name in lines.columns],
        (F.col("_before") + rank).alias("line_number"),
    )


def drop_blank_lines(lines: DataFrame) -> DataFrame:
    """Remove white-space-only lines; done after numbering, so numbers keep their gaps."""
    return lines.filter(~is_blank(F.col("value")))


def _block_facts(blocked: DataFrame, contiguous: bool) -> DataFrame:
    """One row per block: what it holds and what it inherits.

    ``_first``: the first position. ``_before``: lines in earlier blocks.
    ``_forced``: position of the first text of the source if it stands here;
    that line is a head even when indented. ``_first_head``: the first head of
    the block. ``_lead``: lines before it. ``_owner``: the block whose last
    event those lines continue, ``_owner_line``: the line number of that event.
    """
    starts, blank, place = F.col("_starts"), F.col("_blank"), F.col("_place")
    narrow = blocked.select(*BLOCK_KEYS, "pos", "_starts", "_blank")
    # Places in the block; positions with gaps have to be counted.
    narrow = narrow.withColumn("_place", F.col("pos") if contiguous else F.row_number().over(in_block("pos")))
    first = F.min("_place")
    table = block_table(
        narrow,
        (_contiguous_rows() if contiguous else F.count(F.lit(1))).alias("_rows"),
        F.min("pos").alias("_first"),
        F.min(F.when(starts, F.col("pos"))).alias("_first_start"),
        F.min(F.when(~blank, F.col("pos"))).alias("_first_text"),
        (F.min(F.when(starts, place)) - first).alias("_to_start"),
        (F.min(F.when(~blank, place)) - first).alias("_to_text"),
        (F.max(F.when(starts, place)) - first).alias("_to_last"),
    )
    first_text_of_source = F.count("_first_text").over(earlier_blocks()) == 0
    table = table.withColumns(
        {
            "_forced": F.when(first_text_of_source, F.col("_first_text")),
            "_before": F.coalesce(F.sum("_rows").over(earlier_blocks()), F.lit(0)),
        }
    )
    forced = F.col("_forced").isNotNull()
    last_head = F.col("_before") + F.coalesce("_to_last", F.when(forced, F.col("_to_text"))) + 1
    return table.withColumn("_last_head", last_head).select(
        *BLOCK_KEYS,
        "_first",
        "_before",
        "_forced",
        F.coalesce("_forced", "_first_start").alias("_first_head"),
        F.when(forced, F.col("_to_text")).otherwise(F.col("_to_start")).alias("_lead"),
        F.last(F.when(F.col("_last_head").isNotNull(), F.col(BLOCK)), ignorenulls=True)
        .over(earlier_blocks())
        .alias("_owner"),
        F.last("_last_head", ignorenulls=True).over(earlier_blocks()).alias("_owner_line"),
    )


def _located(lines: DataFrame, contiguous: bool) -> DataFrame:
    """Lines with ``line_number``, ``is_head`` and the facts of their block.

    Only the table of blocks is looked up. Contiguous lines are numbered by
    arithmetic, so their text stays where it is as long as that table is small.
    """
    blocked = with_line_kind(lines.withColumnRenamed("block", BLOCK))
    facts = sized_lookup(_block_facts(blocked, contiguous), "event-blocks")
    if not contiguous:
        blocked = blocked.withColumn("_rank", F.row_number().over(in_block("pos")))
    rank = F.col("pos") - F.col("_first") + 1 if contiguous else F.col("_rank")
    head = F.col("_starts") | F.coalesce(F.col("pos") == F.col("_forced"), F.lit(False))
    return blocked.join(facts, BLOCK_KEYS).withColumns({"line_number": F.col("_before") + rank, "is_head": head})


def _anchor(lines: DataFrame, contiguous: bool) -> DataFrame:
    """Give each text line to the block of its head and number the heads.

    Lines before a block's first head move to the block that owns them, so one
    shuffle by ``(source_id, _home)`` brings every event together. The small
    block table is settled first and looked up on the way. Rows get
    ``is_head``, ``line_number`` on heads, and ``event_line``.
    """
    blocked = with_line_kind(lines.withColumnRenamed("block", BLOCK))
    facts = sized_lookup(_block_facts(blocked, contiguous), "event-blocks")
    pos = F.col("pos")
    leading = F.col("_first_head").isNull() | (pos < F.col("_first_head"))
    homed = (
        blocked.join(facts, BLOCK_KEYS)
        .withColumns(
            {
                "_home": F.when(leading, F.col("_owner")).otherwise(F.col(BLOCK)),
                "is_head": ~leading & (F.col("_starts") | F.coalesce(pos == F.col("_forced"), F.lit(False))),
                "_base": F.col("_before") + F.col("_lead"),
            }
        )
        # Leading blank lines are already counted in `_lead`; other blanks still take a number.
        .filter(~(leading & F.col("_blank")))
    )
    order = Window.partitionBy("source_id", "_home").orderBy(BLOCK, "pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = homed.withColumn(
        "line_number", F.when(F.col("is_head"), F.col("_base") + F.row_number().over(order))
    )
    return numbered.withColumn("event_line", F.max("line_number").over(so_far)).filter(~F.col("_blank"))


def mark_heads(lines: DataFrame, contiguous: bool = False) -> DataFrame:
    """Non-blank lines with ``line_number`` and ``is_head``."""
    names = [name for name in lines.columns if name not in ("starts", "blank")]
    columns = [F.col(BLOCK).alias("block") if name == "block" else F.col(name) for name in names]
    return _located(lines, contiguous).filter(~F.col("_blank")).select(*columns, "line_number", "is_head")


def assign_event_lines(lines: DataFrame, contiguous: bool = False) -> DataFrame:
    """Non-blank lines with ``event_line``, the line number of the event they belong to.

    The long form of stitching: it builds no arrays, for logs in which single
    events have more continuation lines than one row should hold. Every block
    stays by itself. The lines before its first head learn from the table of
    blocks whose they are, so an event that spans many blocks is many partitions.
    """
    head_line = F.when(F.col("is_head"), F.col("line_number"))
    event_line = F.coalesce(F.max(head_line).over(so_far_in_block("pos")), F.col("_owner_line"))
    rows = _located(lines, contiguous).withColumn("event_line", event_line).filter(~F.col("_blank"))
    return rows.select("source_id", "source_path", F.col(BLOCK).alias("block"), "pos", "value", "is_head", "event_line")


def stitch_in_chunks(lines: DataFrame, contiguous: bool = False) -> DataFrame:
    """Events of any length: one row per event and block that it has lines in.

    The row of the block with the head has ``raw``, the others only
    ``continuation_lines``; ``block`` tells their order. No row holds more
    lines than a block.
    """
    rows = assign_event_lines(lines, contiguous)
    head = F.col("is_head")
    return (
        rows.groupBy("source_id", "block", "event_line")
        .agg(
            F.max(F.when(head, F.col("source_path"))).alias("source_path"),
            F.max(F.when(head, F.col("value"))).alias("raw"),
            F.sort_array(F.collect_list(F.when(~head, F.struct("pos", strip(F.col("value")).alias("text")))))["text"].alias(
                "continuation_lines"
            ),
        )
        .select("source_id", "source_path", F.col("event_line").alias("line_number"), "block", "raw", "continuation_lines")
    )


def stitch_continuations(lines: DataFrame, include: bool = True, contiguous: bool = False) -> DataFrame:
    """One row per event: ``line_number``, head text ``raw`` and ``continuation_lines``.

    Without continuation lines only heads are kept, and nothing is regrouped.
    """
    if not include:
        return _located(lines, contiguous).filter("is_head").select(
            "source_id",
            "source_path",
            "line_number",
            F.col("value").alias("raw"),
            F.array().cast("array<string>").alias("continuation_lines"),
        )
    rows = _anchor(lines, contiguous)
    head = F.col("is_head")
    piece = F.struct(F.col(BLOCK), F.col("pos"), strip(F.col("value")).alias("text"))
    return (
        rows.groupBy("source_id", "_home", "event_line")
        .agg(
            F.first(F.when(head, F.col("source_path")), ignorenulls=True).alias("source_path"),
            F.first(F.when(head, F.col("value")), ignorenulls=True).alias("raw"),
            F.collect_list(F.when(~head, piece)).alias("_pieces"),
        )
        .select(
            "source_id",
            "source_path",
            F.col("event_line").alias("line_number"),
            "raw",
            F.when(F.size("_pieces") == 0, F.array().cast("array<string>"))
            .otherwise(F.sort_array("_pieces")["text"])
            .alias("continuation_lines"),
        )
    )


def base_timestamps(lines: DataFrame, contiguous: bool = False) -> DataFrame:
    """Earliest timestamp of each source, from the prefixes of its head lines; nothing else of them is parsed."""
    heads = stitch_continuations(lines, include=False, contiguous=contiguous)
    stamped = with_prefix(heads, strip_left(F.col("raw")))
    return stamped.groupBy("source_id").agg(F.min("timestamp").alias("base_timestamp"))


def parse_events(
    lines: DataFrame, options: ParserOptions = ParserOptions(), contiguous: bool = False
) -> DataFrame:
    """Lines to events, the whole parse job."""
    stitched = stitch_continuations(lines, options.include_continuation_lines, contiguous)
    return events_from_heads(stitched, options)


def events_from_heads(stitched: DataFrame, options: ParserOptions = ParserOptions()) -> DataFrame:
    """Parse stitched heads (``source_id, source_path, line_number, raw, continuation_lines``)."""
    parsed = with_fields(parse_heads(stitched, "raw"))
    hashed: Column = raw_text_hash(F.col("raw")) if options.capture_raw_text_hash else F.lit("")
    return (
        parsed.withColumn("raw_text_hash", hashed)
        .withColumn("schema_version", F.lit(options.stamp))
        .withColumn("relative_time", F.lit(None).cast("interval day to second"))
        .select(*EVENT_COLUMNS)
    )
