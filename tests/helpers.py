"""Small builders for logs and events."""

from __future__ import annotations

from datetime import datetime, timedelta

from logloom.schema import EVENT_SCHEMA, LINE_SCHEMA

START = datetime(2030, 5, 1, 10, 0, 0)


def lines_frame(spark, logs: dict[str, list[str]], block: int = 3):
    """Logs as a line table, ``block`` lines per block, positions with gaps."""
    rows = [
        (source, f"{source}.log", i // block, 7 * i + 2, text)
        for source, texts in logs.items()
        for i, text in enumerate(texts)
    ]
    return spark.createDataFrame(rows, LINE_SCHEMA).repartition(4)


def event(line, category="LogGame", verbosity="Display", message="hello", seconds=None, source="a", **more):
    row = {
        "schema_version": "logevent.v1",
        "source_id": source,
        "source_path": f"{source}.log",
        "line_number": line,
        "timestamp": None if seconds is None else START + timedelta(seconds=seconds),
        "relative_time": None,
        "frame": None,
        "category": category,
        "verbosity": verbosity,
        "message": message,
        "continuation_lines": [],
        "fields": {},
        "raw_text_hash": "",
    }
    row.update(more)
    return row


def events_frame(spark, *rows):
    return spark.createDataFrame([tuple(row[name] for name in EVENT_SCHEMA.names) for row in rows], EVENT_SCHEMA)


def by_line(df):
    return {(row["source_id"], row["line_number"]): row for row in df.collect()}


def lines_of(df):
    return sorted(row["line_number"] for row in df.collect())
