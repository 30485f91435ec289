"""Counts by category and verbosity, and the summary made of them.

All of it derives from one small table: events counted by exact spelling of
category and verbosity and by source, with first line and time range. Its
aggregation buffers are fixed-width, so Spark hashes and combines map-side,
and what is shuffled does not grow with the number of events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.severity import is_error, is_warning
from logloom.functions.text import fold
from logloom.operators.filters import is_important
from logloom.plans.profiles import LogProfile


def _spelling_counts(events: DataFrame, *columns: str) -> DataFrame:
    return events.groupBy(*columns, "source_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("line_number").alias("_line")
    )


def _label(column: str) -> Column:
    """The spelling seen first."""
    return F.min_by(column, F.struct("source_id", "_line"))


def facet(events: DataFrame, column: str, by_source: bool = False) -> DataFrame:
    """``name, count`` of a text column, grouped without regard to letter case.

    Ordered by count descending, then by name without regard to case.
    """
    keys = ["source_id"] if by_source else []
    counts = _spelling_counts(events, column)
    return (
        counts.groupBy(*keys, fold(F.col(column)).alias("_key"))
        .agg(_label(column).alias("name"), F.sum("_n").alias("count"))
        .select(*keys, "name", "count")
        .orderBy(*keys, F.desc("count"), F.upper("name"))
    )


def summary(events: DataFrame) -> DataFrame:
    """One row: ``total_events, warning_count, error_count, first_timestamp, last_timestamp``."""
    return events.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(is_warning(F.col("verbosity"))).alias("warning_count"),
        F.count_if(is_error(F.col("verbosity"))).alias("error_count"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
    )


def summary_metrics(events: DataFrame, profile: LogProfile | None = None) -> DataFrame:
    """The summary as ``position, metric, value`` rows; noise is never removed here."""
    aggregates = [
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_warning(F.col("verbosity"))).alias("warnings"),
        F.count_if(is_error(F.col("verbosity"))).alias("errors"),
    ]
    labels = [("total", "Total events"), ("warnings", "Warnings"), ("errors", "Errors")]
    if profile is not None:
        aggregates.append(F.count_if(is_important(profile)).alias("important"))
        labels.append(("important", "Important events"))
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(label).alias("metric"), F.col(name).alias("value"))
            for i, (name, label) in enumerate(labels, 1)
        ]
    )
    return events.agg(*aggregates).select(F.inline(rows))


def important_count(events: DataFrame, profile: LogProfile) -> DataFrame:
    return events.agg(F.count_if(is_important(profile)).alias("important_events"))


def facet_summary(events: DataFrame) -> DataFrame:
    """The summary row with ``category_counts`` and ``verbosity_counts`` as ordered arrays.

    One pass over the events; the two facets and the totals are grouping sets
    of the small spelling table.
    """
    spellings = events.groupBy("category", "verbosity", "source_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("line_number").alias("_line"),
        F.min("timestamp").alias("_first"),
        F.max("timestamp").alias("_last"),
    )
    keyed = spellings.withColumns({"_cat": fold(F.col("category")), "_verb": fold(F.col("verbosity"))})
    sets = keyed.groupingSets([["_cat"], ["_verb"], []], "_cat", "_verb").agg(
        F.grouping_id("_cat", "_verb").alias("_set"),
        _label("category").alias("_cat_name"),
        _label("verbosity").alias("_verb_name"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"),
        F.coalesce(F.sum(F.when(is_warning(F.col("verbosity")), F.col("_n"))), F.lit(0)).alias("_warnings"),
        F.coalesce(F.sum(F.when(is_error(F.col("verbosity")), F.col("_n"))), F.lit(0)).alias("_errors"),
        F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
    )
    # Grouping ids: 1 = by category, 2 = by verbosity, 3 = all.
    total = F.col("_set") == 3
    return sets.agg(
        F.coalesce(F.max(F.when(total, F.col("_n"))), F.lit(0)).alias("total_events"),
        F.coalesce(F.max(F.when(total, F.col("_warnings"))), F.lit(0)).alias("warning_count"),
        F.coalesce(F.max(F.when(total, F.col("_errors"))), F.lit(0)).alias("error_count"),
        F.max(F.when(total, F.col("_first"))).alias("first_timestamp"),
        F.max(F.when(total, F.col("_last"))).alias("last_timestamp"),
        _ordered_counts(F.col("_set") == 1, "_cat_name").alias("category_counts"),
        _ordered_counts(F.col("_set") == 2, "_verb_name").alias("verbosity_counts"),
    )


def _ordered_counts(chosen: Column, name: str) -> Column:
    entry = F.struct((-F.col("_n")).alias("order"), F.upper(name).alias("folded"), F.col(name).alias("name"))
    listed = F.sort_array(F.collect_list(F.when(chosen, entry)))
    return F.transform(listed, lambda e: F.struct(e["name"].alias("name"), (-e["order"]).alias("count")))


def suppressed_counts(events: DataFrame, profile: LogProfile) -> DataFrame:
    """For each noise category: events suppressed, their time range and its length."""
    names = sorted({name.lower() for name in profile.noise_categories})
    noise = events.filter(fold(F.col("category")).isin(*names)) if names else events.limit(0)
    counts = noise.groupBy("category", "source_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("line_number").alias("_line"),
        F.min("timestamp").alias("_first"),
        F.max("timestamp").alias("_last"),
    )
    return (
        counts.groupBy(fold(F.col("category")).alias("_key"))
        .agg(
            _label("category").alias("category"),
            F.sum("_n").alias("suppressed"),
            F.min("_first").alias("first_timestamp"),
            F.max("_last").alias("last_timestamp"),
        )
        .select(
            "category",
            "suppressed",
            "first_timestamp",
            "last_timestamp",
            (F.col("last_timestamp") - F.col("first_timestamp")).alias("duration"),
        )
    )
