"""What a profile's own patterns change in jobs."""

from __future__ import annotations

from logloom.operators.dedupe import deduplicate
from logloom.plans import commands
from logloom.plans.log_query import LogQuery
from logloom.plans.profiles import load_profile
from logloom.sources.event_files import events_from_rows
from tests.helpers import event, events_frame, lines_frame

PROFILE = load_profile(
    {
        "name": "p",
        "noise_categories": ["LogNoise"],
        "field_patterns": {"ms": r"took (\d+) ms"},
        "dedupe_patterns": {"time": r"\d+ ms", "map": r"map (\w+)"},
    }
)


def test_parsed_fields_and_normalized_texts(spark):
    lines = lines_frame(spark, {"s": ["LogA: took 12 ms user=x ms=7", "  map Alpha", "LogA: none"]})
    plain = commands.parse(lines, profile=PROFILE).orderBy("line_number").collect()
    assert [r["fields"] for r in plain] == [{"user": "x", "ms": "12"}, {}]
    assert plain[0]["message"] == "took 12 ms user=x ms=7"
    (first, _) = commands.parse(lines, normalize=True, profile=PROFILE).orderBy("line_number").collect()
    assert first["message"] == "took <time> user=<user_id> ms=7" and first["continuation_lines"] == ["<map>"]


def test_normalized_copies(spark):
    rows = [event(1, message="took 1 ms"), event(2, message="took 22 ms"), event(3, message="took x"),
            event(4, message="load map A"), event(5, message="load map B")]
    events = events_frame(spark, *rows)
    found = deduplicate(events, "normalized", rules=PROFILE.normalizing_rules)
    assert sorted((r["line_number"], r["count"]) for r in found.collect()) == [(1, 2), (3, 1), (4, 2)]
    assert deduplicate(events, "normalized").count() == 5
    texts = [r["value"] for r in commands.clean(events, "normalized", profile=PROFILE).orderBy("line_number").collect()]
    assert texts == ["[2x] LogGame: Display: took <time>", "LogGame: Display: took x", "[2x] LogGame: Display: load <map>"]


def test_matched_lines(spark):
    events = events_frame(spark, event(1, message="took 1 ms"), event(2, "LogNoise"))
    found = commands.filter_lines(events, LogQuery(), PROFILE, normalize=True).collect()
    assert [r["value"] for r in found] == ["1: [LogGame] Display: took <time>"]


def test_inherited_patterns(spark):
    child = load_profile({"name": "c", "dedupe_patterns": {"time": "later", "id": r"#\d+"}})
    both = PROFILE.extend(child)
    assert dict(both.dedupe_patterns) == {"time": "later", "map": r"map (\w+)", "id": r"#\d+"}


def test_events_from_memory(spark):
    rows = [tuple(event(n, message=f"m {n}").values()) for n in range(3)]
    assert events_from_rows(spark, rows).orderBy("line_number").collect() == [
        r for r in events_frame(spark, *[event(n, message=f"m {n}") for n in range(3)]).orderBy("line_number").collect()
    ]
    assert events_from_rows(spark, [event(9)]).first()["line_number"] == 9
    assert events_from_rows(spark, []).count() == 0
