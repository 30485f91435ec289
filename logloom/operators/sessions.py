"""Sessions per key: intervals of time that lie close enough together.

A *fragment* is a key, the first and last time of some of its events, and their
number; a single event is a fragment whose times are equal. Fragments of a key
that overlap or lie at most ``gap`` apart belong to one session. Merging
is associative and does not depend on order, so sessions may be merged in as
many steps and from as many batches as one likes.

A key may hold any part of all events. Events of one instant are one row, and a
key is cut into minutes, so a window over events holds a bounded number of rows.
What remains of a minute is a row per session inside it, however many events it
had; only these are looked at key by key. Rows are shuffled twice, by key and
minute and by key, and joined with nothing.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.time import minute_slice

KEY, FIRST, LAST, SIZE = "key", "first_timestamp", "last_timestamp", "count"
FRAGMENT = [KEY, FIRST, LAST, SIZE]


def as_fragments(events: DataFrame, key: Column, time: Column) -> DataFrame:
    """One fragment per key and instant; rows without a time are left out."""
    timed = events.select(key.alias(KEY), time.alias(FIRST)).where(F.col(FIRST).isNotNull())
    counted = timed.groupBy(KEY, FIRST).agg(F.count(F.lit(1)).alias(SIZE))
    return counted.select(KEY, FIRST, F.col(FIRST).alias(LAST), SIZE)


def _merged(rows: DataFrame, gap: timedelta, *keys: str) -> DataFrame:
    """Rows with the same ``keys`` merged by one look at them in order of time; ``keys`` stay."""
    inside = Window.partitionBy(*keys).orderBy(FIRST, LAST)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = F.max(LAST).over(before)
    opens = ended.isNull() | (F.col(FIRST) - ended > F.lit(gap))
    marked = rows.withColumn("_opens", opens.cast("bigint")).withColumn("_session", F.sum("_opens").over(so_far))
    sums = F.min(FIRST).alias(FIRST), F.max(LAST).alias(LAST), F.sum(SIZE).alias(SIZE)
    return marked.groupBy(*keys, "_session").agg(*sums).drop("_session")


def merge_sessions(fragments: DataFrame, gap: timedelta) -> DataFrame:
    """The sessions that the fragments form, as fragments again."""
    timed = fragments.select(*FRAGMENT).where(F.col(FIRST).isNotNull())
    of_minutes = _merged(timed.withColumn("_minute", minute_slice(F.col(FIRST))), gap, KEY, "_minute")
    return _merged(of_minutes.drop("_minute"), gap, KEY).select(*FRAGMENT)
