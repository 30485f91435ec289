"""The user-level jobs: each puts operators together and returns a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from logloom.functions.redaction import STANDARD_RULES, RedactionRule
from logloom.operators.dedupe import KEY_COLUMNS, DedupeMode, deduplicate
from logloom.operators.facets import facet, facet_summary, summary_metrics
from logloom.operators.filters import apply_query, exclude_noise
from logloom.operators.ingest import ParserOptions, parse_events
from logloom.operators.ordered import BLOCK_ROWS
from logloom.operators.redact import extract_profile_fields, redact
from logloom.plans.log_query import EMPTY_QUERY, LogQuery
from logloom.plans.profiles import LogProfile
from logloom.plans.report import category_listing, clean_lines, facet_summary_json, matched_lines


def parse(
    lines: DataFrame,
    options: ParserOptions = ParserOptions(),
    normalize: bool = False,
    contiguous: bool = False,
    profile: LogProfile | None = None,
) -> DataFrame:
    """Events; a profile adds the fields that its patterns find, and its placeholders to the normalized texts."""
    events = parse_events(lines, options, contiguous)
    if profile is not None:
        events = extract_profile_fields(events, dict(profile.field_patterns))
    return redact(events, _rules(profile)) if normalize else events


def _rules(profile: LogProfile | None) -> tuple[RedactionRule, ...]:
    return STANDARD_RULES if profile is None else profile.normalizing_rules


def summarize(events: DataFrame, profile: LogProfile | None = None) -> DataFrame:
    """Counts; a profile adds the important events and never removes noise."""
    return summary_metrics(events, profile)


def filter_lines(
    events: DataFrame,
    query: LogQuery = EMPTY_QUERY,
    profile: LogProfile | None = None,
    normalize: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Matched lines; giving a profile always switches noise removal on."""
    if profile is not None:
        query = replace(query, exclude_profile_noise=True)
    matches = apply_query(events, query, profile, block_rows=block_rows)
    return matched_lines(redact(matches, _rules(profile)) if normalize else matches)


def clean(
    events: DataFrame,
    mode: DedupeMode | str = DedupeMode.NONE,
    block_rows: int = BLOCK_ROWS,
    profile: LogProfile | None = None,
) -> DataFrame:
    """Clean lines; a profile's placeholders decide what the normalized form does not tell apart."""
    return clean_lines(deduplicate(events.select(*KEY_COLUMNS), mode, block_rows, _rules(profile)))


def categories(events: DataFrame, profile: LogProfile | None = None, as_json: bool = False) -> DataFrame:
    counted = exclude_noise(events, profile)
    return facet_summary_json(counted) if as_json else category_listing(counted)


@dataclass(frozen=True)
class Inspection:
    """Faceted search: matches obey the whole query, facets only its noise switch."""

    matches: DataFrame
    categories: DataFrame
    facets: DataFrame


def inspect(
    events: DataFrame, query: LogQuery = EMPTY_QUERY, profile: LogProfile | None = None, block_rows: int = BLOCK_ROWS
) -> Inspection:
    counted = exclude_noise(events, profile) if query.exclude_profile_noise else events
    return Inspection(
        matches=apply_query(events, query, profile, block_rows=block_rows),
        categories=facet(counted, "category"),
        facets=facet_summary(counted),
    )
