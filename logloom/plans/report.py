"""Text forms of results: matched lines, clean lines, listings, summaries and the report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.time import iso_utc
from logloom.operators.facets import facet, facet_summary
from logloom.operators.findings import land_findings
from logloom.operators.redact import redact
from logloom.operators.ordered import BLOCK_ROWS
from logloom.plans.profiles import LogProfile
from logloom.plans.rules import DEFAULT_RULES, SemanticRule
from logloom.schema import ORDER_KEYS

TIMELINE_ENTRIES = 20


def matched_lines(matches: DataFrame) -> DataFrame:
    """``line: [category] verbosity: message`` in column ``value``, with the order keys."""
    text = F.concat(
        F.col("line_number").cast("string"),
        F.lit(": ["),
        "category",
        F.lit("] "),
        "verbosity",
        F.lit(": "),
        "message",
    )
    return matches.select(*ORDER_KEYS, text.alias("value"))


def clean_lines(deduped: DataFrame) -> DataFrame:
    """``[Nx] category: verbosity: message`` of redacted representatives; no prefix for single events."""
    prefix = F.when(F.col("count") > 1, F.concat(F.lit("["), F.col("count").cast("string"), F.lit("x] "))).otherwise("")
    text = F.concat(prefix, "category", F.lit(": "), "verbosity", F.lit(": "), "message")
    return redact(deduped.select(*ORDER_KEYS, "category", "verbosity", "message", "count")).select(*ORDER_KEYS, text.alias("value"))


def burst_lines(bursts: DataFrame) -> DataFrame:
    """Clean lines that also tell how long a burst lasted: ``[17x over 8.2s] ...``."""
    seconds = F.format_string("%.1f", F.extract(F.lit("SECOND"), F.col("span")).cast("double") + 60.0 * _minutes())
    prefix = F.when(
        F.col("count") > 1,
        F.concat(F.lit("["), F.col("count").cast("string"), F.lit("x over "), seconds, F.lit("s] ")),
    ).otherwise("")
    text = F.concat(prefix, "category", F.lit(": "), "verbosity", F.lit(": "), "message")
    return redact(bursts.select(*ORDER_KEYS, "category", "verbosity", "message", "count", "span")).select(*ORDER_KEYS, text.alias("value"))


def _minutes():
    span = F.col("span")
    return (
        F.extract(F.lit("DAY"), span) * 1440 + F.extract(F.lit("HOUR"), span) * 60 + F.extract(F.lit("MINUTE"), span)
    ).cast("double")


def category_listing(events: DataFrame) -> DataFrame:
    """``name<TAB>count`` in column ``value``, in facet order."""
    return facet(events, "category").select(
        F.concat_ws("\t", "name", F.col("count").cast("string")).alias("value")
    )


def facet_summary_json(events: DataFrame) -> DataFrame:
    """The facet summary as one JSON text."""
    row = facet_summary(events).select(
        F.col("total_events").alias("totalEvents"),
        F.col("warning_count").alias("warningCount"),
        F.col("error_count").alias("errorCount"),
        iso_utc(F.col("first_timestamp")).alias("firstTimestamp"),
        iso_utc(F.col("last_timestamp")).alias("lastTimestamp"),
        F.col("category_counts").alias("categoryCounts"),
        F.col("verbosity_counts").alias("verbosityCounts"),
    )
    return row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def markdown_report(
    events: DataFrame,
    profile: LogProfile | None = None,
    rules: Sequence[SemanticRule] = DEFAULT_RULES,
    entries: int = TIMELINE_ENTRIES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One text per source: counts, then the sections that have content.

    All sections are read from one landed table of findings. What is collected
    per source is bounded: four counts, one failure, one row per rule kind,
    ``entries`` timeline rows.
    """
    findings = land_findings(events, rules, profile)

    def lines(df: DataFrame, section: int, place, text) -> DataFrame:
        return df.select(
            "source_id", F.lit(section).alias("section"), place.cast("bigint").alias("place"), text.alias("text")
        )

    def text(*parts: str) -> Column:
        """Column names, and texts that begin or end with something else than a letter."""
        return F.concat(*[F.col(p).cast("string") if p.isidentifier() else F.lit(p) for p in parts])

    labels = [("total", "Total events: "), ("warnings", "Warnings: "), ("errors", "Errors: ")]
    if profile is not None:
        labels.append(("important", "Important events: "))
    count_rows = findings.counts().select("source_id", F.posexplode(F.array(*[text(label, name) for name, label in labels])))
    failure = text("- [", "line_number", "] ", "kind", " ", "severity", ": ", "reason")
    step = text("- [", "line_number", "] ", "category", " ", "verbosity", ": ", "message")
    rows = (
        lines(count_rows, 0, F.col("pos"), F.col("col"))
        .unionByName(lines(findings.first_failure(), 1, F.lit(0), failure))
        .unionByName(lines(findings.kinds("source_id"), 2, -F.col("count"), text("- ", "kind", ": ", "count")))
        .unionByName(lines(findings.timeline(entries, block_rows), 3, F.col("line_number"), step))
    )
    # A section is its rows; the heading is put in front when the text is joined.
    grouped = rows.groupBy("source_id").agg(
        F.sort_array(F.collect_list(F.struct("section", "place", "text"))).alias("_rows")
    )
    headings = ["", "First likely failure:", "Semantic findings:", "Important timeline:"]

    def section(number: int):
        body = F.transform(F.filter("_rows", lambda row: row["section"] == number), lambda row: row["text"])
        text = F.array_join(body, "\n")
        if not headings[number]:
            return text
        return F.when(F.size(body) > 0, F.concat(F.lit(headings[number] + "\n"), text))

    return grouped.select("source_id", F.concat_ws("\n\n", *[section(i) for i in range(4)]).alias("report"))
