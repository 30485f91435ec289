"""Readers of structured events."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.time import from_duration_text, from_iso
from logloom.schema import EVENT_COLUMNS, EVENT_SCHEMA


def parse_json_events(texts: DataFrame, fail_fast: bool = True) -> DataFrame:
    """Column ``value`` with one JSON object per row to events and ``_broken``.

    Property names match in any letter case, as other writers spell them
    differently; Spark's JSON reader would not do that. Blank rows are no
    records. A record is broken if it is no JSON object or if a value does not
    have the type of its column; ``fail_fast`` then fails the job.
    """
    loose = F.col("_loose")
    rows = (
        texts.where(F.col("value").rlike(r"\S"))
        .select("value", F.from_json("value", T.MapType(T.StringType(), T.StringType()), {"mode": "PERMISSIVE"}).alias("_loose"))
        .select(
            F.transform_keys(loose, lambda key, _: F.lower(key)).alias("_json"),
            (loose.isNull() & F.col("value").isNotNull()).alias("_broken"),
            "value",
        )
    )

    def column(name: str, kind: T.DataType) -> Column:
        text = F.try_element_at("_json", F.lit(name.replace("_", "")))
        if name == "timestamp":
            return from_iso(text)
        if name == "relative_time":
            return from_duration_text(text)
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return F.from_json(text, kind)
        return text.try_cast(kind)

    typed = rows.withColumns({f"_typed_{f.name}": column(f.name, f.dataType) for f in EVENT_SCHEMA.fields})
    broken = F.col("_broken")
    for f in EVENT_SCHEMA.fields:
        given = F.try_element_at("_json", F.lit(f.name.replace("_", ""))).isNotNull()
        broken = broken | F.coalesce(given & F.col(f"_typed_{f.name}").isNull(), F.lit(False))
    # One row in, one row out: the generator keeps filters, such as the one below, from being pushed into the
    # layers above, where each of their columns would parse the record again.
    names = [F.col(f"_typed_{f.name}").alias(f.name) for f in EVENT_SCHEMA.fields]
    read = typed.select(F.inline(F.array(F.struct(*names, broken.alias("_broken"), F.col("value").alias("value")))))
    if fail_fast:
        message = F.concat(F.lit("broken event record: "), F.col("value"))
        read = read.where(F.when(F.col("_broken"), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    return read


def read_json_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Events from JSON lines; a broken record fails the job."""
    return parse_json_events(spark.read.text(path)).select(*EVENT_COLUMNS)


def read_json_events_with_errors(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Events, and the texts of the records that could not be read."""
    parsed = parse_json_events(spark.read.text(path), fail_fast=False)
    good = parsed.filter(~F.col("_broken")).select(*EVENT_COLUMNS)
    return good, parsed.filter("_broken").select(F.col("value").alias("record"))


def events_from_rows(spark: SparkSession, rows: Iterable[dict | tuple]) -> DataFrame:
    """In-memory events, for small fixed inputs."""
    return spark.createDataFrame(list(rows), EVENT_SCHEMA)
