"""Sessions on a stream beside a sequential version, for several numbers and orders of batches."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from logloom.operators.sessions import FRAGMENT, as_fragments, merge_sessions
from logloom.plans import bridge
from logloom.streaming.burst_state import BurstState
from logloom.streaming.event_stream import stream_parquet_events
from tests.helpers import START, event, events_frame

GAP = timedelta(seconds=10)


def sample(n=240, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        seconds = None if rng.random() < 0.1 else rng.choice([rng.uniform(0, 400), rng.randint(0, 20) * 10, 9000])
        more = {"continuation_lines": ["x", "y"]} if rng.random() < 0.2 else {}
        rows.append(event(i, message=rng.choice(["p", "q", None]), seconds=seconds, source=rng.choice("ab"), **more))
    # A key that occurs all the time, and sessions over several minutes.
    return rows + [event(n + i, message="poll", seconds=i * 9.5) for i in range(60)] + [event(n + 99, message="once")]


def label(row):
    return row["source_id"], row["category"], row["verbosity"], row["message"], "\x1f".join(row["continuation_lines"])


def sequential(rows, gap=GAP):
    by_key = {}
    for row in rows:
        if row["timestamp"] is not None:
            by_key.setdefault(label(row), []).append(row["timestamp"])
    out = []
    for key, times in by_key.items():
        first = last = None
        for time in sorted(times):
            if last is None or time - last > gap:
                if last is not None:
                    out.append((*key, first, last, n))
                first, n = time, 0
            last, n = time, n + 1
        out.append((*key, first, last, n))
    return sorted(out, key=str)


def found(state, spark):
    return sorted((tuple(r)[:-1] for r in state.sessions(spark).collect()), key=str)


def write_files(spark, rows, path, files, order):
    """One Parquet file a group of rows, appended one after the other."""
    rng = random.Random(order)
    rows = rows[:]
    if order:
        rng.shuffle(rows)
    for i in range(files):
        events_frame(spark, *rows[i::files]).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("files, per_batch, order", [(1, 1, 0), (3, 1, 1), (6, 1, 2), (6, 2, 3)])
def test_the_same_sessions_for_any_batches(spark, tmp_path, files, per_batch, order):
    rows = sample()
    write_files(spark, rows, f"{tmp_path}/in", files, order)
    state = BurstState(f"{tmp_path}/state")
    state.start(stream_parquet_events(spark, f"{tmp_path}/in", per_batch), f"{tmp_path}/checkpoint").awaitTermination()
    assert found(state, spark) == sequential(rows)
    progress = state.progress(spark).orderBy("batch").collect()
    assert len(progress) == files // per_batch
    timed = sum(r["timestamp"] is not None for r in rows)
    assert sum(r["events"] for r in progress) == len(rows)
    assert sum(r["events"] - r["untimed"] for r in progress) == timed == sum(n for *_, n in found(state, spark))


def test_open_and_closed(spark, tmp_path):
    state = BurstState(f"{tmp_path}/state", delay=timedelta(minutes=1))
    assert state.sessions(spark).collect() == [] and state.watermark(spark) is None
    state.take_in(events_frame(spark, event(1, seconds=0), event(2, seconds=30), event(3, seconds=100)), 0)
    assert state.watermark(spark) == START + timedelta(seconds=40)
    closed = {r["first_timestamp"]: r["closed"] for r in state.sessions(spark).collect()}
    # 30 s + 10 s is not yet before the watermark.
    assert closed == {START: True, START + timedelta(seconds=30): False, START + timedelta(seconds=100): False}


def test_late_events_are_counted_and_join_their_session(spark, tmp_path):
    state = BurstState(f"{tmp_path}/state", delay=timedelta(minutes=1))
    state.take_in(events_frame(spark, event(1, seconds=0), event(2, seconds=20), event(3, seconds=500)), 0)
    state.take_in(events_frame(spark, event(4, seconds=10), event(5, seconds=439), event(6, seconds=440), event(7)), 1)
    assert [tuple(r)[1:4] for r in state.progress(spark).orderBy("batch").collect()] == [(3, 0, 0), (4, 1, 2)]
    assert [(r["first_timestamp"], r["count"]) for r in state.sessions(spark).orderBy("first_timestamp").collect()] == [
        (START, 3),
        (START + timedelta(seconds=439), 2),
        (START + timedelta(seconds=500), 1),
    ]


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    rows = sample(60)
    state = BurstState(f"{tmp_path}/state")
    for number, part in ((0, rows[::2]), (1, rows[1::2]), (1, rows[1::2])):
        state.take_in(events_frame(spark, *part), number)
    assert found(state, spark) == sequential(rows)


def test_a_batch_that_stopped_half_way_does_not_count(spark, tmp_path):
    rows = sample(60)
    state = BurstState(f"{tmp_path}/state")
    state.take_in(events_frame(spark, *rows[::2]), 0)
    # Fragments are there, progress is not.
    events = events_frame(spark, *rows[1::2])
    events.select(F.lit(b"k").alias("key"), F.col("timestamp").alias("first_timestamp"),
                  F.col("timestamp").alias("last_timestamp"), F.lit(1).cast("bigint").alias("count")).write.parquet(
        f"{tmp_path}/state/fragments/batch=1")
    assert found(state, spark) == sequential(rows[::2])


def test_folding_keeps_the_sessions(spark, tmp_path):
    rows = sample(90)
    state = BurstState(f"{tmp_path}/state")
    for number in range(3):
        state.take_in(events_frame(spark, *rows[number::4]), number)
    state.compact(spark)
    kept = sequential([r for i in range(3) for r in rows[i::4]])
    assert found(state, spark) == kept
    assert not list((tmp_path / "state/fragments").glob("batch=*"))
    state.compact(spark)
    state.take_in(events_frame(spark, *rows[3::4]), 3)
    assert found(state, spark) == sequential(rows)
    state.compact(spark)
    assert found(state, spark) == sequential(rows)
    assert len(list((tmp_path / "state/folded/fragments").glob("upto=*"))) == 1


def test_merging_in_steps_is_merging_at_once(spark):
    frame = events_frame(spark, *sample(300, 9)).withColumn("n", F.col("line_number") % 5)
    parts = [
        merge_sessions(as_fragments(frame.where(F.col("n") == i), F.col("message"), F.col("timestamp")), GAP)
        for i in range(5)
    ]
    whole = merge_sessions(as_fragments(frame, F.col("message"), F.col("timestamp")), GAP)
    steps = merge_sessions(parts[0].union(parts[1]), GAP)
    for part in parts[2:]:
        steps = steps.union(part)
    assert merge_sessions(steps, GAP).columns == FRAGMENT
    assert sorted(map(str, merge_sessions(steps, GAP).collect())) == sorted(map(str, whole.collect()))


def test_merging_shuffles_twice_and_joins_nothing(spark, capsys):
    rows = [(k, START + timedelta(seconds=i * step), None, 1) for k, step in (("x", 7), ("y", 11), (None, 30)) for i in range(40)]
    schema = "key string, first_timestamp timestamp_ntz, last_timestamp timestamp_ntz, count bigint"
    frame = spark.createDataFrame(rows, schema).withColumn("last_timestamp", F.col("first_timestamp"))
    # Spans minutes in which others begin; the same interval twice.
    long = spark.createDataFrame([("y", START, START + timedelta(seconds=400), 5)] * 2, schema)
    merged = merge_sessions(frame.union(long), GAP)
    merged.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
    got = {(r["key"], r["first_timestamp"]): (r["last_timestamp"], r["count"]) for r in merged.collect()}
    assert got[("x", START)] == (START + timedelta(seconds=273), 40)
    # 396 is the last inside the long interval, 407 within 10 seconds of its end.
    assert got[("y", START)] == (START + timedelta(seconds=407), 48)
    assert len(got) == 1 + 1 + 2 + 40


def test_files_of_the_stream_grow_in_number(spark, tmp_path):
    spark.range(100).write.parquet(f"{tmp_path}/events.parquet")
    assert bridge.event_files(spark, str(tmp_path)) == 1
    assert bridge.event_files(spark, str(tmp_path), rows=5) == 4
