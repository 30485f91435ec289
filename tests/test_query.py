"""Structured query, importance, profiles and plan-time options."""

from __future__ import annotations

import json
from datetime import timedelta

import pytest

from logloom.operators import filters
from logloom.plans.log_query import EMPTY_QUERY, LogQuery, format_duration, parse_duration, split_csv
from logloom.plans.profiles import LogProfile, ProfileError, load_profile
from tests.helpers import event, events_frame, lines_of


@pytest.fixture(scope="module")
def events(spark):
    return events_frame(
        spark,
        event(1, "LogNet", "Warning", "Connection lost", 0),
        event(2, "lognet", "error", "retry", 10),
        event(3, "LogSlate", "Display", "Paint CONNECTION", 20),
        event(4, "LogGame", "Verbose", "tick", None),
        event(5, "LogGame", "Strange", "tock", 40),
        event(6, "LogGame", "Fatal", "end", 60),
        event(1, "LogGame", "Log", "no time here", None, source="b"),
    ).cache()


def lines(events, **options):
    profile = options.pop("profile", None)
    found = filters.apply_query(events.filter("source_id = 'a'"), LogQuery.from_options(**options), profile)
    return lines_of(found)


def test_each_constraint(events):
    assert lines(events) == [1, 2, 3, 4, 5, 6]
    assert lines(events, category=" LOGNET , ,logslate") == [1, 2, 3]
    assert lines(events, exclude_category="LogNet") == [3, 4, 5, 6]
    assert lines(events, category="LogNet", exclude_category="lognet") == []
    assert lines(events, min_level="warning") == [1, 2, 6]
    assert lines(events, min_level="Display") == [1, 2, 3, 6]
    assert lines(events, min_level="whatever") == [1, 2, 3, 4, 5, 6]
    assert lines(events, contains="connection") == [1, 3]
    assert lines(events, contains="   ") == [1, 2, 3, 4, 5, 6]


def test_time_window_is_inclusive_and_drops_untimed(events):
    assert lines(events, since="00:00:10", until="00:00:40") == [2, 3, 5]
    assert lines(events, since="nonsense") == [1, 2, 3, 4, 5, 6]


def test_base_comes_before_filters(events):
    assert lines(events, category="LogGame", since="00:00:40", until="00:00:40") == [5]


def test_window_without_any_timestamp_keeps_all(events):
    found = filters.apply_query(events.filter("source_id = 'b'"), LogQuery.from_options(since="00:01:00"))
    assert lines_of(found) == [1]


def test_window_by_blocks_when_bases_are_not_small(events, monkeypatch):
    monkeypatch.setattr("logloom.sources.scratch.BROADCAST_MAX_ROWS", -1)
    found = filters.time_window(events, timedelta(seconds=10), timedelta(seconds=40), block_rows=2)
    assert sorted((r["source_id"], r["line_number"]) for r in found.collect()) == [("a", 2), ("a", 3), ("a", 5), ("b", 1)]


def test_noise_needs_switch_and_profile(events):
    profile = load_profile("UE-Default")
    assert lines(events, exclude_profile_noise=True) == [1, 2, 3, 4, 5, 6]
    assert lines(events, profile=profile) == [1, 2, 3, 4, 5, 6]
    assert lines(events, profile=profile, exclude_profile_noise=True) == [1, 2, 4, 5, 6]


def test_long_lists_are_joined(events):
    names = [f"LogX{i}" for i in range(1500)] + ["LOGNET"]
    some = events.filter("source_id = 'a'")
    assert lines_of(filters.include_categories(some, names)) == [1, 2]
    assert lines_of(filters.exclude_categories(some, names)) == [3, 4, 5, 6]


def test_importance(events):
    profile = LogProfile("p", important_categories=("LOGNET",), important_patterns=("tOcK",))
    assert lines_of(filters.important_events(events.filter("source_id = 'a'"), profile)) == [1, 2, 5]
    every = LogProfile("p", important_patterns=("",))
    assert filters.important_events(events, every).count() == 7
    assert filters.important_events(events, LogProfile("p")).count() == 0


def test_predicates_reach_the_lake(spark, events, tmp_path):
    path = str(tmp_path / "events")
    events.write.parquet(path)
    found = filters.min_level(spark.read.parquet(path), "Fatal").filter("line_number > 3").select("line_number")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(line_number,3)" in plan
    assert "message" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("00:01:30", timedelta(seconds=90)),
        ("1:2", timedelta(hours=1, minutes=2)),
        ("2.03:00:00", timedelta(days=2, hours=3)),
        ("2.03:30", timedelta(days=2, hours=3, minutes=30)),
        ("00:00:01.25", timedelta(seconds=1, milliseconds=250)),
        ("-00:00:05", timedelta(seconds=-5)),
        ("5", timedelta(days=5)),
        ("24:00:00", timedelta(days=24)),
        ("00:61:00", None),
        ("soon", None),
        ("", None),
        (None, None),
    ],
)
def test_durations(text, expected):
    assert parse_duration(text) == expected
    if expected is not None:
        assert parse_duration(format_duration(expected)) == expected


def test_saved_specification():
    query = LogQuery.from_options("LogA,LogB", "LogC", "Warning", "it's", "00:00:05", "1.00:00:00", True)
    saved = json.loads(json.dumps(query.to_dict()))
    assert saved["since"] == "00:00:05" and saved["until"] == "1.00:00:00"
    assert LogQuery.from_dict(saved) == query
    assert LogQuery.from_dict({}) == EMPTY_QUERY
    assert split_csv(" a,, b ,") == ("a", "b") and split_csv(None) == ()


def test_profiles(tmp_path):
    assert load_profile("ue-online").noise_categories == ("LogSlate", "LogRHI")
    with pytest.raises(ProfileError):
        load_profile("nobody")
    with pytest.raises(ProfileError):
        load_profile({"noise_categories": ["LogA"]})
    path = tmp_path / "mine.json"
    path.write_text(json.dumps({"name": "mine", "version": 2, "noise_categories": ["LogA"], "surprise": 1}))
    mine = load_profile(str(path))
    assert (mine.name, mine.version, mine.noise_categories) == ("mine", "2", ("LogA",))
    child = load_profile("ue-online").extend(LogProfile("kid", noise_categories=("logslate", "LogX")))
    assert child.name == "kid" and child.version == "1"
    assert child.noise_categories == ("LogSlate", "LogRHI", "LogX")


def test_yaml_profile(tmp_path, monkeypatch):
    pytest.importorskip("yaml")
    monkeypatch.chdir(tmp_path)
    (tmp_path / "ue-default").write_text("name: local\nimportant_patterns:\n  - boom\n")
    assert load_profile("ue-default").important_patterns == ("boom",)


def test_durations_out_of_range_are_no_constraint():
    assert parse_duration("9999999999") is None
    assert parse_duration("9999999999.01:00:00") is None
    assert parse_duration("١٢") is None


def test_short_and_long_exclusions_agree_on_null_categories(spark):
    from logloom.operators import filters
    from tests.helpers import event, events_frame, lines_of

    frame = events_frame(
        spark,
        event(1, category=None),
        event(2, category=""),
        event(3, category="LogNET"),
        event(4, category="LogGame"),
    )
    long = ["lognet", *(f"Log{i}" for i in range(filters.INLINE_NAMES + 1))]
    assert lines_of(filters.exclude_categories(frame, ["LogNet"])) == [1, 2, 4]
    assert lines_of(filters.exclude_categories(frame, long)) == [1, 2, 4]
    assert lines_of(filters.include_categories(frame, ["LogNet"])) == [3]
    assert lines_of(filters.include_categories(frame, long)) == [3]
