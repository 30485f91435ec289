"""From one physical line to the pieces of an event.

The pieces are built in layers of small projections, so that each split or
substring is computed once and later expressions refer to it by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.severity import KNOWN_VERBOSITIES
from logloom.functions.text import WHITESPACE_CLASS, fold, is_ascii, is_blank, is_indented, strip, strip_left

# The line format `[yyyy.MM.dd-HH.mm.ss:fff][frame]Category: Verbosity: Message`.
# The frame is whatever stands between the next `[` anywhere later and the `]` after it.
PREFIX = (
    r"^\[[0-9]{4}\.[0-9]{2}\.[0-9]{2}-[0-9]{2}\.[0-9]{2}\.[0-9]{2}:[0-9]{3}\][^\[]*"
    rf"\[[{WHITESPACE_CLASS}]*[+-]?[0-9]+[{WHITESPACE_CLASS}]*\]"
)
# Letters and digits of the basic plane only: a category is judged in UTF-16 units.
CATEGORY = (
    r"^(Log[A-Za-z0-9_]*(?:[\p{L}\p{Nd}_&&[\x{0}-\x{FFFF}]]+)?)"
    rf"[{WHITESPACE_CLASS}]*:"
)
DEFAULT_CATEGORY = "Unknown"
DEFAULT_VERBOSITY = "Display"



def _field_token(blank: str) -> str:
    """Either a field (``key=`` and a quoted, bare or empty value) or any other run of text."""
    return rf'[^{blank}=]+=(?:"[^"]*(?:"|\z)|[^{blank}"][^{blank}]*|[{blank}])|[^{blank}]+'


def _stamp(line: Column) -> Column:
    """Timestamp at the start of a line whose prefix has the right form; null unless a real date."""
    date = F.translate(F.substring(line, 2, 10), ".", "-")
    time = F.translate(F.substring(line, 13, 8), ".", ":")
    text = F.concat(date, F.lit(" "), time, F.lit("."), F.substring(line, 22, 3))
    return F.when(F.substring(line, 2, 4) != "0000", text).try_cast("timestamp_ntz")


def with_prefix(df: DataFrame, text: Column) -> DataFrame:
    """Add ``timestamp``, ``frame`` and ``remainder`` of the left-trimmed ``text``.

    The prefix counts only when both parts are good: a stamp without a frame
    is rejected whole.
    """
    line, prefix = F.col("_line"), F.col("_prefix")
    frame_text = strip(F.substring_index(F.substring_index(prefix, "[", -1), "]", 1))
    good = F.col("_moment").isNotNull() & F.col("_number").isNotNull()
    return (
        df.withColumns(
            {
                "_line": text,
                "_prefix": F.when(F.startswith(text, F.lit("[")), F.regexp_extract(text, PREFIX, 0)).otherwise(
                    F.when(text.isNotNull(), F.lit(""))
                ),
            }
        )
        .withColumns(
            {
                "_moment": F.when(prefix != "", _stamp(line)),
                "_number": F.when(prefix != "", frame_text.try_cast("int")),
            }
        )
        .withColumns(
            {
                "timestamp": F.when(good, F.col("_moment")),
                "frame": F.when(good, F.col("_number")),
                "remainder": F.when(
                    good, strip_left(F.substring(line, F.length(prefix) + 1, F.length(line)))
                ).otherwise(line),
            }
        )
    )


def with_head_parts(df: DataFrame) -> DataFrame:
    """Add ``_category`` and, where there is one, ``_tail``: the text after the first colon."""
    rem = F.col("remainder")
    start = F.length(F.substring_index(rem, ":", 1)) + 2
    return df.withColumns(
        {
            "_category": F.when(F.startswith(rem, F.lit("Log")), F.regexp_extract(rem, CATEGORY, 1)).otherwise(""),
            "_tail": strip(F.substring(rem, start, F.length(rem))),
        }
    )


def looks_like_event(df: DataFrame, text: Column, output: str) -> DataFrame:
    """Add boolean ``output``: the left-trimmed ``text`` has a category and something after it.

    A known verbosity is itself text after the category, so the three-part
    form needs no test of its own here.
    """
    kept = df.columns
    df = with_head_parts(with_prefix(df, text))
    eventlike = (F.col("_category") != "") & (F.col("_tail") != "")
    return df.select(*kept, F.coalesce(eventlike, F.lit(False)).alias(output))


def with_line_kind(lines: DataFrame) -> DataFrame:
    """Add ``_blank`` and ``_starts``: the line opens an event wherever it stands.

    A line that does not start with white space always opens one; an indented
    line only when it looks like an event itself. The parse of the indented
    text is skipped for all other lines. Landed lines have been judged before.
    """
    if "starts" in lines.columns and "blank" in lines.columns:
        return lines.withColumnsRenamed({"starts": "_starts", "blank": "_blank"})
    value = F.col("value")
    inner = F.when(is_indented(value), strip_left(value))
    kinds = looks_like_event(lines, inner, "_eventlike")
    blank = is_blank(value)
    return kinds.withColumns(
        {"_blank": blank, "_starts": ~blank & (~is_indented(value) | F.col("_eventlike"))}
    ).drop("_eventlike")


def parse_heads(df: DataFrame, raw: str) -> DataFrame:
    """Turn head lines into ``timestamp, frame, category, verbosity, message``.

    Order of attempts: category, verbosity and message; category and message;
    the whole trimmed raw line.
    """
    kept = df.columns
    parts = F.split(F.col("_tail_raw"), ":", 2)
    df = with_head_parts(with_prefix(df, strip_left(F.col(raw))))
    rem = F.col("remainder")
    start = F.length(F.substring_index(rem, ":", 1)) + 2
    df = df.withColumn("_tail_raw", F.when(F.col("_category") != "", F.substring(rem, start, F.length(rem))))
    df = df.withColumns({"_word": strip(F.get(parts, F.lit(0))), "_rest": strip(F.get(parts, F.lit(1)))})
    known = fold(F.col("_word")).isin(*KNOWN_VERBOSITIES) & F.col("_rest").isNotNull()
    three = F.coalesce(known, F.lit(False))
    two = (F.col("_category") != "") & (F.col("_tail") != "")
    # One row in, one row out: the generator keeps later filters from being
    # pushed into the layers above, where each would repeat the whole parse.
    return df.select(
        *kept,
        F.inline(
            F.array(
                F.struct(
                    F.col("timestamp").alias("timestamp"),
                    F.col("frame").alias("frame"),
                    F.when(three | two, F.col("_category")).otherwise(F.lit(DEFAULT_CATEGORY)).alias("category"),
                    F.when(three, F.col("_word")).otherwise(F.lit(DEFAULT_VERBOSITY)).alias("verbosity"),
                    F.when(three, F.col("_rest"))
                    .when(two, F.col("_tail"))
                    .otherwise(strip(F.col(raw)))
                    .alias("message"),
                )
            )
        ),
    )


def with_fields(df: DataFrame, message: str = "message", output: str = "fields") -> DataFrame:
    """Add the map of ``key=value`` tokens in ``message``; the last value of a key wins.

    One regex pass cuts the text into tokens. A token is a field when it has
    text before its first ``=`` and anything after it.
    """
    msg = F.col(message)
    # The full white space class is slow, and not needed for ASCII text.
    tokens = F.when(
        F.contains(msg, F.lit("=")),
        F.when(is_ascii(msg), F.regexp_extract_all(msg, F.lit(_field_token(r"\s")), F.lit(0))).otherwise(
            F.regexp_extract_all(msg, F.lit(_field_token(WHITESPACE_CLASS)), F.lit(0))
        ),
    )
    df = df.withColumn("_tokens", F.filter(tokens, _is_field))
    df = df.withColumn("_pairs", F.sort_array(F.transform("_tokens", _pair)))
    last_of_key = F.filter(
        "_pairs",
        lambda pair, i: (i == 0) | (F.get(F.col("_pairs"), i - 1)["key"] != pair["key"]),
    )
    entries = F.transform(last_of_key, lambda pair: F.struct(pair["key"], pair["value"]))
    empty = F.create_map().cast("map<string,string>")
    return df.withColumn(
        output, F.when(F.size("_pairs") > 0, F.map_from_entries(entries)).otherwise(empty)
    ).drop("_tokens", "_pairs")


def _is_field(token: Column) -> Column:
    at = F.instr(token, "=")
    return (at > 1) & (at < F.length(token))


def _pair(token: Column, index: Column) -> Column:
    at = F.instr(token, "=")
    value = F.substring(token, at + 1, F.length(token))
    quoted = F.startswith(value, F.lit('"'))
    return F.struct(
        F.substring(token, F.lit(1), at - 1).alias("key"),
        (-index).alias("recency"),
        F.when(quoted, F.replace(value, F.lit('"'), F.lit("")))
        .otherwise(F.rtrim(strip(value), F.lit(",;")))
        .alias("value"),
    )


def raw_text_hash(raw: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(raw.cast("binary"), 256))
