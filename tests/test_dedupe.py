from __future__ import annotations

import pytest

from logloom.operators import dedupe
from logloom.operators.dedupe import DedupeMode
from tests.helpers import event, events_frame


def counts(df):
    return sorted((r["line_number"], r["count"]) for r in df.collect())


@pytest.fixture(scope="module")
def events(spark):
    return events_frame(
        spark,
        event(1, message="user=a", seconds=0, frame=1),
        event(2, message="other", seconds=1),
        event(3, message="user=b", seconds=2, frame=2),
        event(4, message="user=a", seconds=90, frame=3, fields={"x": "1"}),
        event(5, message="user=a", verbosity="display", seconds=91),
        event(6, message="user=a", seconds=92, continuation_lines=["a\x1fb"]),
        event(7, message="user=a", seconds=93, continuation_lines=["a", "b"]),
        event(1, message="user=a", seconds=1, source="b"),
    ).cache()


def test_none(events):
    assert {c for _, c in counts(dedupe.deduplicate(events, DedupeMode.NONE))} == {1}


def test_exact_keeps_first_and_case(events):
    found = dedupe.deduplicate(events.filter("source_id = 'a'"), "exact")
    assert counts(found) == [(1, 2), (2, 1), (3, 1), (5, 1), (6, 2)]
    first = [r for r in found.collect() if r["line_number"] == 1][0]
    assert (first["frame"], first["fields"]) == (1, {})


def test_sources_stay_apart(events):
    assert dedupe.deduplicate(events, "exact").count() == 6


def test_normalized_compares_and_shows_redacted(events):
    found = dedupe.deduplicate(events.filter("source_id = 'a'"), "normalized")
    assert counts(found) == [(1, 3), (2, 1), (5, 1), (6, 2)]
    assert "user=<user_id>" in {r["message"] for r in found.collect()}


def test_burst_needs_neighbours_times_and_equal_raw_keys(spark):
    rows = [
        event(1, message="p", seconds=0),
        event(2, message="p", seconds=10),
        event(3, message="p", seconds=20.5),
        event(4, message="q", seconds=21),
        event(5, message="p", seconds=22),
        event(6, message="p"),
        event(7, message="p"),
        event(8, message="p", seconds=30),
        event(9, message="p", seconds=25),
        event(10, message="user=a", seconds=26),
        event(11, message="user=b", seconds=26),
    ]
    found = dedupe.deduplicate(events_frame(spark, *rows), "burst")
    assert counts(found) == [(1, 2), (3, 1), (4, 1), (5, 1), (6, 1), (7, 1), (8, 2), (10, 1), (11, 1)]


def test_one_hot_key(spark):
    """A key that makes up most of the log is combined before the shuffle."""
    rows = [event(i, message="hot" if i % 10 else f"cold {i}") for i in range(1, 201)]
    found = dedupe.deduplicate(events_frame(spark, *rows).repartition(8), "exact")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_min_by" in plan
    assert max(c for _, c in counts(found)) == 180


@pytest.mark.parametrize("name, mode", [("EXACT", DedupeMode.EXACT), (" burst ", DedupeMode.BURST), ("2", DedupeMode.NORMALIZED)])
def test_mode_names(name, mode):
    assert DedupeMode.parse(name) is mode


@pytest.mark.parametrize("name", ["", "42", "-1", "exactly"])
def test_bad_mode_names(name):
    with pytest.raises(ValueError):
        DedupeMode.parse(name)


def test_top_repeated(events):
    found = dedupe.top_repeated(events, 2).collect()
    assert [(r["message"], r["count"]) for r in found] == [("user=<user_id>", 4), ("user=<user_id>", 2)]
