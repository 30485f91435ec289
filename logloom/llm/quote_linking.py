"""Conversations from quotations.

A line's quote level is the number of ``>`` marks before its text, with spaces
between them or not. Level 0 lines are the message's own; a line that only
introduces a quotation ("... wrote:" right before a quoted line) is dropped
with it. Adjacent quoted lines of one level form a passage. Lines are normalised
(lower case, single spaces, no marks; blank ones do not count). A passage is
hashed whole, by every two lines that follow each other, and by line; own text
is hashed whole, by stretch between quotations, by paragraph, by twos and by
line. Each hash is linked to the latest earlier message of the conversation
that has it as its own. Of a passage only the widest kind that is linked counts:
the whole, else twos, else lines. Of the shallowest level that is linked, the
message with the most linked characters is the one replied to, the latest if
several tie. A message without a linked quotation continues the one before it.

A branch is a run of messages each continuing the one before it; a linked
reply to an older message opens a new branch. ``branch`` is the position of
its first message and ``branch_step`` the place in it, so a conversation in
reply order is its branches, each by step, hung on ``reply_to``.

Windows run over (conversation, block of turns), and what a block needs of the
earlier ones is carried over in one row a block, so one conversation may hold
any part of all rows.

Defined results: null text counts as empty. Rows without a conversation or
turn form a conversation or a turn of their own (null). Messages of one turn
are ordered by role and text; equal rows stay, each with a position of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.sources.scratch import settle

QUOTED = regex.compile(r"^[\x20\t]*((?:>[\x20\t]*)+)(.*)$")
INTRODUCES = regex.compile(r":[\x20\t]*$")
PARSED = "own string, own_lines array<struct<hash:long,size:int>>, quoted array<struct<hash:long,size:int,level:int,passage:int,rank:int>>, n_quoted_lines int, max_level int"
TURNS_A_BLOCK = 1024


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def hashed(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "replace")) - (1 << 63)


def parse(text: str | None) -> tuple[str, list[tuple[int, str]], list[list[str]], list[tuple[int, list[str]]]]:
    """A message's own text, its quoted lines with their level, its own stretches, and its passages with their level."""
    own, quoted, passages = [], [], []
    for line in (text or "").split("\n"):
        mark = QUOTED.match(line)
        if mark is None:
            own.append(line)
            continue
        adjoins = quoted_last(own, quoted)
        if own and not adjoins and INTRODUCES.search(own[-1]) and own[-1].strip():
            own.pop()
        level = mark[1].count(">")
        if adjoins and passages[-1][0] == level:
            passages[-1][1].append(mark[2])
        else:
            passages.append((level, [mark[2]]))
        quoted.append((level, mark[2]))
        own.append(None)
    stretches = [list(g) for is_own, g in groupby(own, key=lambda x: x is not None) if is_own]
    return "\n".join(x for x in own if x is not None).strip("\n"), quoted, stretches, passages


def quoted_last(own: list, quoted: list) -> bool:
    """Whether the line before was quoted, too."""
    return bool(quoted) and own[-1] is None


def normals(lines: list[str]) -> list[str]:
    return [n for line in lines if (n := normal(line))]


def paragraphs(lines: list[str]) -> list[list[str]]:
    """Runs of lines with text."""
    return [list(g) for filled, g in groupby((normal(x) for x in lines), key=bool) if filled]


def twos(lines: list[str]) -> list[list[str]]:
    return [lines[i : i + 2] for i in range(len(lines) - 1)]


def parsed(text: str | None) -> tuple:
    own, quoted, stretches, passages = parse(text)
    own_units: dict[int, int] = {}
    for stretch in [*stretches, own.split("\n")]:
        lines = normals(stretch)
        for unit in [lines, *paragraphs(stretch), *twos(lines), *([x] for x in lines)]:
            if unit:
                own_units[hashed("\n".join(unit))] = sum(map(len, unit))
    known: dict[tuple[str, ...], int] = {}
    for level, block in passages:
        if lines := tuple(normals(block)):
            known[lines] = min(level, known.get(lines, level))
    links: dict[tuple[int, int], tuple[int, int, int]] = {}
    for passage, (key, level) in enumerate(known.items()):
        lines = list(key)
        for rank, units in ((0, [lines]), (1, twos(lines)), (2, [[x] for x in lines])):
            for unit in units:
                links.setdefault((passage, hashed("\n".join(unit))), (sum(map(len, unit)), level, rank))
    return (
        own,
        [{"hash": h, "size": s} for h, s in own_units.items()],
        [{"hash": h, "size": s, "level": v, "passage": p, "rank": r} for (p, h), (s, v, r) in links.items()],
        len(quoted),
        max((v for v, _ in quoted), default=0),
    )


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def running_before(table: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """``table`` (one row per key and block) with ``value`` over the earlier blocks of the key."""
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumn("carried", value.over(earlier))


def positions(messages: DataFrame) -> DataFrame:
    """Number the messages of each conversation from 0, block by block."""
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    placed = messages.withColumn("inside", F.row_number().over(inside) - 1)
    counts = messages.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    carried = running_before(counts, ["conv_id"], F.sum("n")).select(
        F.col("conv_id").alias("c_conv"), F.col("block").alias("c_block"), "carried"
    )
    return (
        placed.join(carried, same("conv_id", "c_conv") & same("block", "c_block"), "left")
        .withColumn("position", F.coalesce("carried", F.lit(0)) + F.col("inside"))
        .drop("c_conv", "c_block", "carried", "inside")
    )


def link(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per message, without its quotations and with the message it replies to."""
    messages = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    ).withColumn("block", F.floor(F.coalesce("turn", F.lit(0)) / TURNS_A_BLOCK).cast("long"))
    numbered = positions(messages)
    schema = f"{', '.join(f'{n} {t}' for n, t in numbered.drop('text').dtypes)}, {PARSED}"
    names = ["own", "own_lines", "quoted", "n_quoted_lines", "max_level"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = pd.DataFrame([parsed(t if isinstance(t, str) else None) for t in batch["text"]], columns=names)
            yield pd.concat([batch.drop(columns="text").reset_index(drop=True), made], axis=1)

    table = settle(numbered.mapInPandas(run, schema), "messages")

    quotes = table.select("conv_id", "position", F.explode("quoted").alias("q")).select(
        "conv_id", "position", *[F.col(f"q.{c}").alias(c) for c in ("hash", "size", "level", "passage", "rank")]
    )
    asked = quotes.select(F.col("conv_id").alias("a_conv"), F.col("hash").alias("a_hash")).distinct()
    # Only what something quotes goes further.
    originals = (
        table.select("conv_id", "position", F.explode("own_lines.hash").alias("hash"))
        .join(asked, same("conv_id", "a_conv") & (F.col("hash") == F.col("a_hash")), "left_semi")
        .withColumns({c: F.lit(0) for c in ("size", "level", "passage", "rank")})
    )
    both = (
        originals.withColumn("is_quote", F.lit(False))
        .unionByName(quotes.withColumn("is_quote", F.lit(True)))
        .withColumn("block", F.floor(F.col("position") / TURNS_A_BLOCK))
        .withColumn("source", F.when(~F.col("is_quote"), F.col("position")))
    )
    keys = ["conv_id", "hash"]
    # A message's own line is no original of its own quotation: quotes sort first.
    inside = Window.partitionBy(*keys, "block").orderBy("position", F.col("is_quote").desc())
    latest = F.last("source", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    carried = running_before(both.groupBy(*keys, "block").agg(F.max("source").alias("latest")), keys, F.max("latest"))
    carried = carried.select(*[F.col(c).alias(f"c_{c}") for c in [*keys, "block"]], "carried")
    linked = (
        both.withColumn("found", latest)
        .where("is_quote")
        .join(
            carried, same("conv_id", "c_conv_id") & (F.col("hash") == F.col("c_hash")) & same("block", "c_block"), "left"
        )
        .withColumn("target", F.coalesce("found", "carried"))
        .where(F.col("target").isNotNull())
    )
    widest = F.min("rank").over(Window.partitionBy("conv_id", "position", "passage"))
    counted = linked.withColumn("widest", widest).where("rank = widest")
    votes = counted.groupBy("conv_id", "position", "level", "target").agg(F.sum("size").alias("size"))
    # The shallowest level comes first.
    order = F.struct((-F.col("level")).alias("depth"), "size", "target")
    chosen = votes.groupBy("conv_id", "position").agg(F.max(order).alias("best"))
    chosen = chosen.select(
        F.col("conv_id").alias("l_conv"), F.col("position").alias("l_position"), F.col("best.target").alias("target")
    )
    replies = (
        table.join(chosen, same("conv_id", "l_conv") & (F.col("position") == F.col("l_position")), "left")
        .withColumn("linked", F.col("target").isNotNull())
        .withColumn("reply_to", F.coalesce("target", F.when(F.col("position") > 0, F.col("position") - 1)))
        .withColumn("opens", (F.col("position") == 0) | (F.col("reply_to") != F.col("position") - 1))
        .withColumn("block", F.floor(F.col("position") / TURNS_A_BLOCK))
        .withColumn("opened", F.when(F.col("opens"), F.col("position")))
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("position")
    starts = running_before(
        replies.groupBy("conv_id", "block").agg(F.max("opened").alias("latest")), ["conv_id"], F.max("latest")
    ).select(F.col("conv_id").alias("s_conv"), F.col("block").alias("s_block"), "carried")
    return (
        replies.withColumn("here", F.max("opened").over(inside))
        .join(starts, same("conv_id", "s_conv") & same("block", "s_block"), "left")
        .withColumn("branch", F.coalesce("here", "carried"))
        .select(
            "conv_id",
            "turn",
            "role",
            "position",
            F.col("own").alias("body"),
            "n_quoted_lines",
            "max_level",
            "linked",
            "reply_to",
            "branch",
            (F.col("position") - F.col("branch")).alias("branch_step"),
        )
    )
