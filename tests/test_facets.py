from __future__ import annotations

import json
from datetime import timedelta

import pytest

from logloom.operators import facets, timing
from logloom.operators.filters import with_base_timestamp
from logloom.plans import commands, report
from logloom.plans.log_query import LogQuery
from logloom.plans.profiles import LogProfile
from tests.helpers import START, event, events_frame, lines_of

PROFILE = LogProfile("p", noise_categories=("LogSlate",), important_categories=("LogNet",))


@pytest.fixture(scope="module")
def events(spark):
    return events_frame(
        spark,
        event(1, "lognet", "warning", "user=a", 0),
        event(2, "LogNet", "Error", "two", 5),
        event(3, "LOGNET", "FATAL", "three", 65),
        event(4, "LogSlate", "Display", "four"),
        event(5, "Log_Z", "Display", "five"),
        event(6, "LogZ", "Display", "six", 7),
    ).repartition(3).cache()


def test_facet_labels_and_order(events):
    rows = [(r["name"], r["count"]) for r in facets.facet(events, "category").collect()]
    # The underscore comes after letters, as names are compared in upper case.
    assert rows == [("lognet", 3), ("LogSlate", 1), ("LogZ", 1), ("Log_Z", 1)]
    assert [(r["name"], r["count"]) for r in facets.facet(events, "verbosity").collect()] == [
        ("Display", 3), ("Error", 1), ("FATAL", 1), ("warning", 1),
    ]


def test_summary_record(events, spark):
    (row,) = facets.facet_summary(events).collect()
    assert (row["total_events"], row["warning_count"], row["error_count"]) == (6, 1, 2)
    assert (row["first_timestamp"], row["last_timestamp"]) == (START, START + timedelta(seconds=65))
    assert [tuple(c) for c in row["category_counts"]][0] == ("lognet", 3)
    (empty,) = facets.facet_summary(events.filter("line_number > 99")).collect()
    assert (empty["total_events"], empty["first_timestamp"], empty["category_counts"]) == (0, None, [])
    assert facets.summary(events).first()["error_count"] == 2


def test_summarize_command(events):
    def values(df):
        return [(r["metric"], r["value"]) for r in df.orderBy("position").collect()]

    plain = [("Total events", 6), ("Warnings", 1), ("Errors", 2)]
    assert values(commands.summarize(events)) == plain
    assert values(commands.summarize(events, PROFILE)) == [*plain, ("Important events", 3)]


def test_category_command(events):
    listing = [r["value"] for r in commands.categories(events, PROFILE).collect()]
    assert listing == ["lognet\t3", "LogZ\t1", "Log_Z\t1"]
    data = json.loads(commands.categories(events, as_json=True).first()["value"])
    assert data["totalEvents"] == 6 and data["firstTimestamp"] == "2030-05-01T10:00:00+00:00"
    assert data["categoryCounts"][1] == {"name": "LogSlate", "count": 1}
    assert list(data) == [
        "totalEvents", "warningCount", "errorCount", "firstTimestamp", "lastTimestamp", "categoryCounts", "verbosityCounts",
    ]


def test_filter_command_removes_noise_and_redacts(events):
    found = commands.filter_lines(events, LogQuery(), PROFILE, normalize=True).orderBy("line_number").collect()
    assert [r["value"] for r in found][:2] == ["1: [lognet] warning: user=<user_id>", "2: [LogNet] Error: two"]
    assert [r["line_number"] for r in found] == [1, 2, 3, 5, 6]


def test_clean_command(spark):
    rows = [event(i, "LogA", "Log", "user=x" if i < 3 else "user=y", i) for i in range(1, 5)]
    found = commands.clean(events_frame(spark, *rows), "exact").orderBy("line_number").collect()
    assert [r["value"] for r in found] == ["[2x] LogA: Log: user=<user_id>", "[2x] LogA: Log: user=<user_id>"]
    single = commands.clean(events_frame(spark, rows[0]), "normalized").first()["value"]
    assert single == "LogA: Log: user=<user_id>"
    from logloom.operators.dedupe import deduplicate

    burst = report.burst_lines(deduplicate(events_frame(spark, *[event(i, message="p", seconds=4.1 * i) for i in (0, 1, 2)]), "burst"))
    assert [r["value"] for r in burst.collect()] == ["[3x over 8.2s] LogGame: Display: p"]


def test_inspection(events):
    query = LogQuery.from_options(category="LogZ", exclude_profile_noise=True)
    found = commands.inspect(events, query, PROFILE)
    assert lines_of(found.matches) == [6]
    assert [r["name"] for r in found.categories.collect()] == ["lognet", "LogZ", "Log_Z"]
    assert found.facets.first()["total_events"] == 5


def test_suppressed_and_metadata(spark, events):
    rows = [event(1, "LogSlate", seconds=1), event(2, "LOGSLATE", seconds=61), event(3, "LogA", seconds=99)]
    (row,) = facets.suppressed_counts(events_frame(spark, *rows), PROFILE).collect()
    assert (row["category"], row["suppressed"], row["duration"]) == ("LogSlate", 2, timedelta(seconds=60))
    (meta,) = timing.log_metadata(events).collect()
    assert (meta["event_count"], meta["category_count"], meta["physical_lines"]) == (6, 4, None)


def test_relative_time(events):
    rows = timing.with_relative_time(events).collect()
    assert {r["line_number"]: r["relative_time"] for r in rows}[3] == timedelta(seconds=65)
    assert {r["line_number"]: r["relative_time"] for r in rows}[4] is None
    bases = with_base_timestamp(events).select("source_id", "base_timestamp").distinct()
    assert timing.with_relative_time(events, bases).count() == 6
