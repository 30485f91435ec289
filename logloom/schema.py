"""The one row shape every operator reads and returns.

An *event* is a parsed log entry. Events have no implicit order in Spark, so
``(source_id, line_number)`` travels with every row and is the order key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEFAULT_SCHEMA_VERSION = "logevent.v1"

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("line_number", T.LongType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("relative_time", T.DayTimeIntervalType()),
        T.StructField("frame", T.IntegerType()),
        T.StructField("category", T.StringType()),
        T.StructField("verbosity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("continuation_lines", T.ArrayType(T.StringType())),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("raw_text_hash", T.StringType()),
    ]
)

EVENT_COLUMNS = [field.name for field in EVENT_SCHEMA.fields]
ORDER_KEYS = ["source_id", "line_number"]

# Raw lines: `block` is an ordered slice of a source that one task can hold,
# `pos` is the order inside that block.
LINE_SCHEMA = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("pos", T.LongType()),
        T.StructField("value", T.StringType()),
    ]
)

# Lines that were written down: with what they are, judged once, and with `pos` growing by one inside a block.
LANDED_SCHEMA = T.StructType(
    [*LINE_SCHEMA.fields, T.StructField("starts", T.BooleanType()), T.StructField("blank", T.BooleanType())]
)


class SchemaMismatch(ValueError):
    """A DataFrame offered as an event source lacks the event columns."""


def assert_event_schema(df: DataFrame) -> DataFrame:
    """Return ``df`` cut down to the event columns, or fail at plan time.

    Any producer of these columns is a valid source; nullability and column
    order are free, names and types are not.
    """
    actual = {field.name: field.dataType for field in df.schema.fields}
    problems = []
    for field in EVENT_SCHEMA.fields:
        if field.name not in actual:
            problems.append(f"missing {field.name}")
        elif actual[field.name].simpleString() != field.dataType.simpleString():
            problems.append(
                f"{field.name} is {actual[field.name].simpleString()}, "
                f"expected {field.dataType.simpleString()}"
            )
    if problems:
        raise SchemaMismatch("; ".join(problems))
    return df.select(*EVENT_COLUMNS)
