"""The structured query applied to events."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.severity import rank_of, severity_rank
from logloom.functions.text import contains_ignore_case, fold
from logloom.operators.ordered import BLOCK, BLOCK_KEYS, BLOCK_ROWS, block_table, with_block
from logloom.plans.log_query import EMPTY_QUERY, LogQuery
from logloom.plans.profiles import LogProfile
from logloom.sources.scratch import BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS, settle_lookup

# Longer name lists are joined instead of inlined into the plan.
INLINE_NAMES = 1000


def _folded(names: Sequence[str]) -> list[str]:
    return sorted({name.lower() for name in names})


def _join_names(events: DataFrame, names: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join with a long list of category names."""
    rows = [(name,) for name in _folded(names)]
    table = events.sparkSession.createDataFrame(rows, "_name string")
    size = sum(len(name.encode()) for (name,) in rows)
    if len(rows) <= BROADCAST_MAX_ROWS and size + 64 * len(rows) <= BROADCAST_MAX_BYTES:
        table = F.broadcast(table)
    return events.join(table, fold(F.col("category")) == F.col("_name"), how)


def include_categories(events: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keep the named categories; an empty list keeps all."""
    if not names:
        return events
    if len(names) > INLINE_NAMES:
        return _join_names(events, names, "left_semi")
    return events.filter(fold(F.col("category")).isin(*_folded(names)))


def exclude_categories(events: DataFrame, names: Sequence[str]) -> DataFrame:
    if not names:
        return events
    if len(names) > INLINE_NAMES:
        return _join_names(events, names, "left_anti")
    # An event without a category is in no list, as in the joined form.
    return events.filter(~F.coalesce(fold(F.col("category")).isin(*_folded(names)), F.lit(False)))


def exclude_noise(events: DataFrame, profile: LogProfile | None) -> DataFrame:
    return events if profile is None else exclude_categories(events, profile.noise_categories)


def min_level(events: DataFrame, verbosity: str | None) -> DataFrame:
    """Keep events at least as severe; an unknown name has the lowest rank and keeps all."""
    if verbosity is None or rank_of(verbosity) <= 1:
        return events
    return events.filter(severity_rank(F.col("verbosity")) >= rank_of(verbosity))


def contains_text(events: DataFrame, text: str | None) -> DataFrame:
    """Keep events whose message, not its continuation, contains the text in any letter case."""
    if text is None or not text.strip():
        return events
    return events.filter(contains_ignore_case(F.col("message"), text))


def base_timestamps(events: DataFrame) -> DataFrame:
    """Earliest timestamp of each source, null when it has none."""
    return events.groupBy("source_id").agg(F.min("timestamp").alias("base_timestamp"))


def with_base_timestamp(
    events: DataFrame, bases: DataFrame | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``base_timestamp``, the earliest of the whole source.

    ``bases`` (``source_id, base_timestamp``) may come from a cheaper look at
    the log than its events are: from the prefixes of its lines or from the
    statistics of a lake. The bases, one row per source, are settled and
    broadcast if proven small. If not, they are spread over the blocks of their
    source, so that a dominant source does not hang on a single join key.
    """
    lookup = settle_lookup(base_timestamps(events) if bases is None else bases, "base-timestamps")
    if lookup.small:
        return events.join(F.broadcast(lookup.table), "source_id", "left")
    blocked = with_block(events, block_rows)
    per_block = block_table(blocked, F.count(F.lit(1)).alias("_rows")).drop("_rows").join(lookup.table, "source_id")
    return blocked.join(per_block, BLOCK_KEYS, "left").drop(BLOCK)


def _in_window(since: timedelta | None, until: timedelta | None) -> Column:
    offset = F.col("timestamp") - F.col("base_timestamp")
    inside = F.lit(True)
    if since is not None:
        inside = inside & (offset >= F.lit(since))
    if until is not None:
        inside = inside & (offset <= F.lit(until))
    return F.col("base_timestamp").isNull() | inside


def time_window(
    events: DataFrame,
    since: timedelta | None = None,
    until: timedelta | None = None,
    bases: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Keep events whose offset from the source's base time lies in ``[since, until]``.

    A source without any timestamp keeps all its events; elsewhere an event
    without one is dropped. ``bases`` must describe the unfiltered log.
    """
    if since is None and until is None:
        return events
    based = with_base_timestamp(events, bases, block_rows)
    return based.filter(_in_window(since, until)).select(*events.columns)


def apply_query(
    events: DataFrame,
    query: LogQuery = EMPTY_QUERY,
    profile: LogProfile | None = None,
    bases: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """All constraints of the query; the base time is taken over all events, before any of them."""
    result = events
    if query.has_time_window:
        result = with_base_timestamp(events, bases, block_rows).filter(_in_window(query.since, query.until))
    result = include_categories(result, query.included_categories)
    result = exclude_categories(result, query.excluded_categories)
    if query.exclude_profile_noise:
        result = exclude_noise(result, profile)
    result = min_level(result, query.min_verbosity)
    result = contains_text(result, query.contains_text)
    return result.select(*events.columns)


def is_important(profile: LogProfile) -> Column:
    """Category listed as important, or message holding one of the patterns in any letter case."""
    tests = [F.lit(False)]
    if profile.important_categories:
        tests.append(fold(F.col("category")).isin(*_folded(profile.important_categories)))
    tests += [contains_ignore_case(F.col("message"), pattern) for pattern in profile.important_patterns]
    return reduce(lambda a, b: a | b, tests)


def important_events(events: DataFrame, profile: LogProfile) -> DataFrame:
    return events.filter(is_important(profile))
