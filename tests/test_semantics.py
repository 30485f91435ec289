from __future__ import annotations

import pytest

from logloom.operators import compare, paging, semantics
from logloom.plans.profiles import LogProfile
from logloom.plans.report import markdown_report
from logloom.plans.rules import DEFAULT_RULES, load_rules
from tests.helpers import event, events_frame, lines_of

RULES = load_rules(
    {
        "rules": [
            {
                "id": "r1",
                "kind": "disk.full",
                "severity": "medium",
                "reason": "Disk full",
                "match": {"categories": ["LogDisk"], "min_verbosity": "Warning", "message_contains_any": ["full", "no space"]},
            },
            {
                "id": "r2",
                "kind": "disk.slow",
                "severity": "low",
                "reason": "Disk slow",
                "match": {"message_contains_all": ["disk", "SLOW"]},
                "confidence": 0.4,
            },
        ]
    }
)


@pytest.fixture(scope="module")
def events(spark):
    return events_frame(
        spark,
        event(1, "LogDisk", "Display", "disk full", 0),
        event(2, "logdisk", "warning", "Disk FULL and slow", 1),
        event(3, "LogDisk", "Error", "no space", 2),
        event(4, "LogGame", "Error", "odd", 3),
        event(5, "LogGame", "Display", "a Fatal Error follows", 4),
        event(6, "LogGame", "Fatal", "stop", 5),
        event(7, "LogGame", "Display", "fine", 6),
    ).cache()


def test_rules_and_fallbacks(events):
    found = {(r["line_number"], r["rule_id"]) for r in semantics.match_rules(events, RULES).collect()}
    assert found == {(2, "r1"), (2, "r2"), (3, "r1")}
    rest = {(r["line_number"], r["kind"], r["severity"]) for r in semantics.fallback_findings(events, RULES).collect()}
    assert rest == {(4, "runtime.error", "high"), (5, "runtime.fatal", "critical"), (6, "runtime.fatal", "critical")}
    both = semantics.classify(events, RULES)
    assert both.count() == 6
    counts = {r["kind"]: r["count"] for r in semantics.finding_counts(both).collect()}
    assert counts == {"disk.full": 2, "disk.slow": 1, "runtime.error": 1, "runtime.fatal": 2}
    assert semantics.classify(events, ()).count() == 4


def test_first_failure_order(events):
    def first(df):
        rows = semantics.first_failure(semantics.classify(df, RULES)).collect()
        return [(r["line_number"], r["kind"]) for r in rows]

    assert first(events) == [(5, "runtime.fatal")]
    assert first(events.filter("line_number < 5")) == [(4, "runtime.error")]
    assert first(events.filter("line_number < 4")) == [(2, "disk.full")]
    assert first(events.filter("line_number = 1")) == []
    systems = semantics.first_failure_by_system(semantics.classify(events, RULES), ["disk"]).collect()
    assert [(r["system"], r["line_number"]) for r in systems] == [("disk", 2)]


def test_timeline(events):
    profile = LogProfile("p", important_patterns=("fine",))
    rows = semantics.timeline(events, RULES, profile, limit=5, block_rows=2).orderBy("line_number").collect()
    assert [r["line_number"] for r in rows] == [2, 3, 4, 5, 6]
    assert rows[0]["kinds"] == "disk.full,disk.slow"
    assert lines_of(semantics.timeline(events, RULES, profile)) == [2, 3, 4, 5, 6, 7]


def test_bad_rules():
    with pytest.raises(ValueError):
        load_rules([{"id": "x", "kind": "k", "severity": "huge", "reason": "r"}])
    with pytest.raises(ValueError):
        load_rules([{"id": "x", "kind": "k", "severity": "low", "reason": "r"}] * 2)
    assert len({rule.id for rule in DEFAULT_RULES}) == len(DEFAULT_RULES)


def test_report(spark, events):
    quiet = event(1, "LogGame", "Display", "fine", 0, source="q")
    both = events.unionByName(events_frame(spark, quiet))
    found = {r["source_id"]: r["report"] for r in markdown_report(both, None, RULES, entries=2).collect()}
    assert found["q"] == "Total events: 1\nWarnings: 0\nErrors: 0"
    assert found["a"] == (
        "Total events: 7\nWarnings: 1\nErrors: 3\n\n"
        "First likely failure:\n- [5] runtime.fatal critical: Fatal error\n\n"
        "Semantic findings:\n- disk.full: 2\n- runtime.fatal: 2\n- disk.slow: 1\n- runtime.error: 1\n\n"
        "Important timeline:\n- [2] logdisk warning: Disk FULL and slow\n- [3] LogDisk Error: no space"
    )


def test_pages_and_context(events):
    page = paging.page(events, -3, 2)
    assert [r["line_number"] for r in page.events.collect()] == [1, 2] and page.offset == 0
    far = paging.page(events, 50, 2)
    assert far.events.count() == 0 and far.total.first()[0] == 7
    assert paging.page(events, 0, -1).events.count() == 0
    assert lines_of(paging.context_window(events, "a", 2, 5, 1)) == [1, 2, 3]
    assert lines_of(paging.context_window(events, "a", 6, 0, 9)) == [6, 7]
    assert lines_of(paging.context_window(events, "a", 4, -1, -1)) == [4]
    assert lines_of(paging.context_window(events, "a", 99, 5, 5)) == []


def test_preview(spark):
    rows = [event(7, "LogAVeryLongCategoryName", "VeryVerbose", "m" * 101), event(8, message="m" * 100)]
    first, second = paging.preview(events_frame(spark, *rows)).orderBy("line_number").collect()
    assert first["row"] == "     7 LogAVeryLongCateg... VeryVe... " + "m" * 99 + "..."
    assert second["row"] == "     8 LogGame            Display " + "m" * 100


@pytest.mark.parametrize("block_rows", [1, 1000])
def test_alignment(spark, block_rows):
    left = [event(1, seconds=0, source="l"), event(2, seconds=100, source="l"), event(3, seconds=100, source="l"),
            event(4, source="l"), event(5, seconds=500, source="l")]
    right = [event(1, seconds=50, source="r"), event(2, seconds=100, source="r"), event(3, seconds=100, source="r"),
             event(4, seconds=501, source="r")]
    frame = events_frame(spark, *left, *right)
    found = compare.align_by_time(frame, "l", "r", block_rows).collect()
    assert sorted((r["left_line"], r["right_line"]) for r in found if r["right_line"]) == [(2, 3), (3, 3), (5, 3)]
    assert [r["left_line"] for r in found if r["right_line"] is None] == [1]


def test_order_and_divergence(spark):
    left = [event(1, message="user=a", seconds=0, source="l"), event(2, message="join", seconds=1, source="l"),
            event(3, verbosity="Error", message="lost", seconds=2, source="l")]
    right = [event(1, message="user=b", seconds=0, source="r"), event(4, message="joined", seconds=1, source="r"),
             event(6, message="playing", seconds=9, source="r"), event(7, message="more", seconds=10, source="r")]
    frame = events_frame(spark, *left, *right)
    rows = compare.align_by_order(frame, "l", "r", 2).orderBy("event_index").collect()
    assert [(r["left_line"], r["right_line"], r["same"]) for r in rows] == [
        (1, 1, True), (2, 4, False), (3, 6, False), (None, 7, False),
    ]
    (row,) = compare.divergence(frame, "l", "r").collect()
    assert (row["event_index"], row["left_line"], row["right_line"]) == (1, 2, 4)
    assert (row["left_failure_line"], row["right_failure_line"], row["continued"]) == (3, None, "r")
    same = [event(1, source="l"), event(1, source="r")]
    assert compare.divergence(events_frame(spark, *same), "l", "r").count() == 1
