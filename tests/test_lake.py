"""The lake: folders, loads, and what the manifest lets a reader skip."""

from __future__ import annotations

from datetime import timedelta
from pathlib import Path

import pytest

from logloom.sources import lake
from logloom.sources.event_files import events_from_rows
from tests.helpers import START, event, events_frame

NAMES = [f"log-{i:03}" for i in range(300)]


def placed(rows):
    return [(r["source_id"], r["line_number"]) for r in rows]


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("lake"))
    for load, names in enumerate((NAMES[:200], NAMES[200:])):
        rows = [
            event(line, f"Log{line % 3}", "Error" if line == 5 and name == "log-007" else "Log", f"m {name}",
                  seconds=1000 * load + line, source=name, continuation_lines=["x"], fields={"k": name})
            for name in names
            for line in range(1, 6)
        ]
        lake.write_lake(events_from_rows(spark, [tuple(r.values()) for r in rows]), folder, buckets=4)
    return folder


def test_many_sources_few_folders(spark, path):
    assert len(list(Path(path).glob("events/load=*/bucket=*"))) == 8
    manifest = lake.read_manifest(spark, path).collect()
    assert sum(r["events"] for r in manifest) == 1500 and len({r["load"] for r in manifest}) == 2
    assert {r["bucket"] for r in manifest} == {0, 1, 2, 3}


def test_every_event_comes_back(spark, path):
    rows = lake.read_lake(spark, path).collect()
    assert sorted(placed(rows)) == [(name, line) for name in NAMES for line in range(1, 6)]
    one = next(r for r in rows if (r["source_id"], r["line_number"]) == ("log-007", 5))
    assert (one["category_key"], one["severity_rank"], one["continuation_lines"], one["fields"]) == (
        "log2", 4, ["x"], {"k": "log-007"},
    )


@pytest.mark.parametrize(
    "asked, expected",
    [
        ({"sources": ["log-250", "nothing"]}, [("log-250", n) for n in range(1, 6)]),
        ({"sources": []}, []),
        ({"sources": ["log-001"], "categories": ["LOG1"]}, [("log-001", 1), ("log-001", 4)]),
        ({"categories": ["other"]}, []),
        ({"min_verbosity": "error"}, [("log-007", 5)]),
        ({"since": START + timedelta(seconds=1005)}, [(n, 5) for n in NAMES[200:]]),
        ({"until": START + timedelta(seconds=1)}, [(n, 1) for n in NAMES[:200]]),
        ({"since": START + timedelta(days=9)}, []),
    ],
)
def test_what_is_asked_for(spark, path, asked, expected):
    assert sorted(placed(lake.read_lake(spark, path, **asked).collect())) == expected


def test_only_files_that_may_hold_it_are_opened(spark, path):
    whole = len(lake.read_lake(spark, path).inputFiles())
    for asked in ({"sources": ["log-250"]}, {"since": START + timedelta(seconds=500)}, {"min_verbosity": "Error"}):
        assert 0 < len(lake.read_lake(spark, path, **asked).inputFiles()) < whole


def test_a_load_without_manifest_does_not_count(spark, tmp_path, path):
    own = str(tmp_path / "lake")
    lake.write_lake(events_frame(spark, event(1)), own)
    spark.read.schema(lake.STORED).parquet(f"{path}/events").write.parquet(f"{own}/events/load=broken/bucket=0")
    assert placed(lake.read_lake(spark, own).collect()) == [("a", 1)]


def test_files_of_many_categories_are_read_for_any(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lake, "LISTED_CATEGORIES", 3)
    own = str(tmp_path / "lake")
    lake.write_lake(events_frame(spark, *[event(i, f"Log{i}") for i in range(9)], event(9, None)), own, buckets=1)
    assert lake.read_manifest(spark, own).where("categories is null").count() >= 1
    assert placed(lake.read_lake(spark, own, categories=["LOG7"]).collect()) == [("a", 7)]
    lake.write_lake(events_frame(spark), own, buckets=1)
    assert lake.read_lake(spark, own).count() == 10


def test_statistics_per_source(spark, tmp_path):
    own = str(tmp_path / "lake")
    rows = [event(1, seconds=5), event(2), event(3, seconds=2, source="b"), event(4, source="c")]
    lake.write_lake(events_frame(spark, *rows), own)
    lake.write_lake(events_frame(spark, event(9, seconds=1), event(1, seconds=4, source="b")), own)
    found = {r["source_id"]: tuple(r)[1:] for r in lake.read_sources(spark, own).collect()}
    at = lambda s: START + timedelta(seconds=s)
    assert found == {"a": (3, 1, 9, at(1), at(5)), "b": (2, 1, 3, at(2), at(4)), "c": (1, 4, 4, None, None)}
    assert {tuple(r) for r in lake.base_timestamps(spark, own).collect()} == {("a", at(1)), ("b", at(2)), ("c", None)}
