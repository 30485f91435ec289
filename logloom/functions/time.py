"""Arithmetic on timestamps without zone and on day-time intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def milliseconds(interval: Column) -> Column:
    """Length of a day-time interval in milliseconds; smaller fractions are dropped."""
    return (
        F.extract(F.lit("DAY"), interval).cast("bigint") * 86_400_000
        + F.extract(F.lit("HOUR"), interval).cast("bigint") * 3_600_000
        + F.extract(F.lit("MINUTE"), interval).cast("bigint") * 60_000
        + (F.extract(F.lit("SECOND"), interval) * 1000).cast("bigint")
    )


def minute_slice(timestamp: Column) -> Column:
    """Minute number of a timestamp, the same in every session time zone."""
    since_epoch = timestamp - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(milliseconds(since_epoch) / 60_000)


def iso_utc(timestamp: Column) -> Column:
    """ISO 8601 text with a zero offset; trailing zeros of the fraction are dropped."""
    return F.concat(F.replace(timestamp.cast("string"), F.lit(" "), F.lit("T")), F.lit("+00:00"))


def from_iso(text: Column) -> Column:
    """Timestamp in UTC from ISO 8601 text with ``Z``, an offset, or nothing behind the time."""
    pattern = r"^(.+?)(?:Z|([+-])([0-9]{2}):?([0-9]{2}))?$"
    clock = F.regexp_extract(text, pattern, 1).try_cast("timestamp_ntz")
    minutes = F.regexp_extract(text, pattern, 3).try_cast("int") * 60 + F.regexp_extract(text, pattern, 4).try_cast(
        "int"
    )
    shift = F.make_dt_interval(mins=F.coalesce(minutes, F.lit(0)))
    return F.when(F.regexp_extract(text, pattern, 2) == "-", clock + shift).otherwise(clock - shift)


def duration_text(interval: Column) -> Column:
    """``[-][d.]hh:mm:ss[.fffffff]``, the constant duration format."""
    micros = F.extract(F.lit("SECOND"), interval) * 1_000_000
    total = (
        F.extract(F.lit("DAY"), interval).cast("bigint") * 86_400
        + F.extract(F.lit("HOUR"), interval).cast("bigint") * 3_600
        + F.extract(F.lit("MINUTE"), interval).cast("bigint") * 60
    ) * 1_000_000 + micros.cast("bigint")
    size = F.abs(total)
    second = F.lit(1_000_000).cast("bigint")
    days = F.floor(size / (86_400 * second))
    text = F.concat(
        F.when(total < 0, "-").otherwise(""),
        F.when(days > 0, F.concat(days.cast("string"), F.lit("."))).otherwise(""),
        F.format_string(
            "%02d:%02d:%02d",
            F.floor(size / (3_600 * second)) % 24,
            F.floor(size / (60 * second)) % 60,
            F.floor(size / second) % 60,
        ),
        F.when(size % second > 0, F.format_string(".%06d0", size % second)).otherwise(""),
    )
    return F.when(interval.isNotNull(), text)


def from_duration_text(text: Column) -> Column:
    pattern = r"^(-)?(?:([0-9]+)\.)?([0-9]{1,2}):([0-9]{2}):([0-9]{2}(?:\.[0-9]{1,7})?)$"

    def part(group: int, kind: str) -> Column:
        return F.coalesce(F.regexp_extract(text, pattern, group).try_cast(kind), F.lit(0).cast(kind))

    value = F.make_dt_interval(part(2, "int"), part(3, "int"), part(4, "int"), part(5, "decimal(18,6)"))
    signed = F.when(F.regexp_extract(text, pattern, 1) == "-", -value).otherwise(value)
    return F.when(F.rlike(text, F.lit(pattern)), signed)
