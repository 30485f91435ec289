"""Writers of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.time import duration_text, iso_utc
from logloom.schema import EVENT_COLUMNS, ORDER_KEYS
from logloom.sources.scratch import settle


def json_name(column: str) -> str:
    """``line_number`` is written as ``LineNumber``."""
    return "".join(part.capitalize() for part in column.split("_"))


def as_json_columns(events: DataFrame) -> DataFrame:
    """Events with the names and text forms of the JSON contract."""
    special: dict[str, Column] = {
        "timestamp": iso_utc(F.col("timestamp")),
        "relative_time": duration_text(F.col("relative_time")),
    }
    return events.select(*[special.get(name, F.col(name)).alias(json_name(name)) for name in EVENT_COLUMNS])


def to_ndjson(events: DataFrame) -> DataFrame:
    """One JSON text per event in column ``value``; nulls are kept."""
    columns = as_json_columns(events)
    return columns.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def in_log_order(events: DataFrame) -> DataFrame:
    """Range-partition and sort, so that files read one after the other follow the log.

    The ranges come from a sample of the rows. They are written down first, or
    everything before this would run once for the sample and once for the rows.
    """
    written = settle(events, "to-sort")
    return written.repartitionByRange(*ORDER_KEYS).sortWithinPartitions(*ORDER_KEYS)


def write_json(events: DataFrame, path: str, ordered: bool = True) -> None:
    """All events as JSON lines in a folder; ``ordered`` keeps them in log order."""
    rows = in_log_order(events) if ordered else events
    as_json_columns(rows).write.option("ignoreNullFields", "false").json(path)


def write_text(rows: DataFrame, path: str) -> None:
    """Column ``value`` to a folder of text files.

    Rows that have the order keys (matched, clean and burst lines) are written
    in log order: files in order of their names, read one after the other.
    """
    if set(ORDER_KEYS) <= set(rows.columns):
        rows = in_log_order(rows)
    rows.select("value").write.text(path)
