"""Several files as one log, ordered text, and the shared folder."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from logloom.operators.ingest import number_lines, parse_events
from logloom.sources import lines as text_lines
from logloom.plans.report import matched_lines
from logloom.sinks.event_files import write_text
from logloom.sources.lines import read_lines
from logloom.sources.scratch import release, scratch_path, settle
from tests.helpers import event, events_frame

ROTATED = {"Game-backup-1.log": 40, "Game-backup-2.log": 30, "Game.log": 50}


@pytest.fixture
def rotated(tmp_path):
    """Three files of one log; the second starts with a line that continues the first one's last event."""
    number, expected = 0, []
    for name, rows in ROTATED.items():
        lines = []
        for _ in range(rows):
            number += 1
            lines.append("    more" if number == 41 else f"LogGame: Display: line {number}")
        (tmp_path / name).write_text("".join(f"{line}\n" for line in lines))
        expected += lines
    return str(tmp_path / "*.log"), expected


def place():
    name = F.regexp_extract(F.col("_metadata.file_name"), r"backup-([0-9]+)", 1)
    return F.when(name == "", 1000).otherwise(name.try_cast("int"))


@pytest.mark.parametrize("split", ["128m", "200b"])
def test_files_of_one_log_in_stated_order(spark, rotated, split):
    path, expected = rotated
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        lines = read_lines(spark, path, F.lit("game"), file_place=place())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = number_lines(lines, contiguous=True).orderBy("line_number").select("line_number", "value").collect()
    assert [tuple(r) for r in got] == list(enumerate(expected, 1))
    events = parse_events(lines, contiguous=True)
    assert events.count() == len(expected) - 1
    assert events.where("line_number = 40").first()["continuation_lines"] == ["more"]


def test_files_of_one_log_without_order_fail(spark, rotated):
    lines = read_lines(spark, rotated[0], F.lit("game"))
    for job in (number_lines, parse_events):
        with pytest.raises(Exception, match="file_place"):
            job(lines, contiguous=True).collect()


def test_small_splits_share_tasks(spark, rotated, tmp_path, monkeypatch):
    path, expected = rotated
    monkeypatch.setattr(text_lines, "SCAN_TASKS", 3)
    monkeypatch.setattr(text_lines, "SCAN_TASKS_PER_CORE", 0)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100b")
    try:
        lines = read_lines(spark, path, F.lit("game"), str(tmp_path / "landed"), place())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert spark.conf.get(text_lines.MAX_TASKS, None) is None
    # The splits are the blocks, as before; what was written down is not a file for each.
    assert lines.select("block").distinct().count() > 25
    assert len(list((tmp_path / "landed").glob("*.parquet"))) <= 4
    got = number_lines(lines, contiguous=True).orderBy("line_number").select("line_number", "value").collect()
    assert [tuple(r) for r in got] == list(enumerate(expected, 1))


def test_files_without_order_fail_in_one_task_too(spark, rotated):
    spark.conf.set(text_lines.MAX_TASKS, "1")
    try:
        lines = read_lines(spark, rotated[0], F.lit("game"))
        assert spark.conf.get(text_lines.MAX_TASKS) == "1"
    finally:
        spark.conf.unset(text_lines.MAX_TASKS)
    for job in (number_lines, parse_events):
        with pytest.raises(Exception, match="file_place"):
            job(lines, contiguous=True).collect()


def test_text_is_written_in_log_order(spark, tmp_path):
    numbers = [(i * 37) % 101 + 1 for i in range(101)]
    frame = events_frame(spark, *[event(n, "LogA", "Display", f"m{n}") for n in numbers]).repartition(7)
    path = tmp_path / "text"
    write_text(matched_lines(frame), str(path))
    written = "".join(Path(p).read_text() for p in sorted(path.glob("*.txt")))
    assert written.splitlines() == [f"{n}: [LogA] Display: m{n}" for n in range(1, 102)]


def test_release_empties_the_folder_of_the_session(spark):
    settle(spark.range(3), "numbers")
    folder = Path(scratch_path(spark, "x")).parent
    assert any(folder.iterdir())
    release(spark)
    assert not folder.exists()
    assert settle(spark.range(3), "numbers").count() == 3
