"""Block-wise operators against sequential ones, on random logs and several block sizes."""

from __future__ import annotations

import gzip
import random
import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from logloom.operators import dedupe, ingest, ordered, paging, timing
from logloom.sources.lines import land_lines, read_lines
from tests import sequential
from tests.helpers import event, events_frame, lines_frame

SHAPES = ["LogA: text", "LogB: Warning: x", "  more", "\tindented", "", "   ", "free text", "   LogC: own", "  {"]


def random_logs(seed: int, count: int = 12) -> dict[str, list[str]]:
    rng = random.Random(seed)
    logs = {}
    for i in range(count):
        weights = [rng.choice([0, 1, 5]) for _ in SHAPES]
        weights[0] += 0.1
        logs[f"s{i}"] = [f"{text} {n}" if text.strip() else text for n, text in enumerate(rng.choices(SHAPES, weights, k=rng.randint(1, 60)))]
    # A log that is one long continuation, over many blocks.
    logs["long"] = ["", "LogA: head"] + [f"  part {n}" for n in range(50)] + ["LogA: end"]
    return logs


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_stitching_and_numbering(spark, block):
    logs = random_logs(block)
    lines = lines_frame(spark, logs, block)
    numbered = {(r["source_id"], r["line_number"]): r["value"] for r in ingest.number_lines(lines).collect()}
    assert numbered == {(s, i): text for s, texts in logs.items() for i, text in enumerate(texts, 1)}

    expected = {s: sequential.stitch(texts) for s, texts in logs.items()}
    stitched = {}
    for row in ingest.stitch_continuations(lines).orderBy("line_number").collect():
        stitched.setdefault(row["source_id"], []).append((row["line_number"], row["raw"], row["continuation_lines"]))
    assert stitched == {s: events for s, events in expected.items() if events}

    heads = {(r["source_id"], r["line_number"]) for r in ingest.mark_heads(lines).filter("is_head").collect()}
    assert heads == {(s, number) for s, events in expected.items() for number, _, _ in events}

    sizes = ingest.assign_event_lines(lines).groupBy("source_id", "event_line").count().collect()
    assert {(r[0], r[1]): r[2] for r in sizes} == {
        (s, number): 1 + len(rest) for s, events in expected.items() for number, _, rest in events
    }


def landed(spark, logs, block, tmp_path):
    return land_lines(lines_frame(spark, logs, block), f"{tmp_path}/{block}")


@pytest.mark.parametrize("block", [1, 4, 1000])
@pytest.mark.parametrize("small", [True, False])
def test_landed_lines(spark, tmp_path, monkeypatch, block, small):
    if not small:
        monkeypatch.setattr("logloom.sources.scratch.BROADCAST_MAX_ROWS", -1)
    logs = random_logs(block + 7)
    lines = landed(spark, logs, block, tmp_path)
    expected = {(s, n): (raw, rest) for s, texts in logs.items() for n, raw, rest in sequential.stitch(texts)}

    marked = ingest.mark_heads(lines, contiguous=True).collect()
    assert {(r["source_id"], r["line_number"]) for r in marked if r["is_head"]} == set(expected)
    assert {(r["source_id"], r["line_number"]): r["value"] for r in marked} == {
        (s, i): text for s, texts in logs.items() for i, text in enumerate(texts, 1) if text.strip()
    }
    heads = ingest.stitch_continuations(lines, include=False, contiguous=True).collect()
    assert {(r["source_id"], r["line_number"]): r["raw"] for r in heads} == {k: raw for k, (raw, _) in expected.items()}
    whole = ingest.stitch_continuations(lines, contiguous=True).collect()
    assert {(r["source_id"], r["line_number"]): (r["raw"], r["continuation_lines"]) for r in whole} == expected
    owned = ingest.assign_event_lines(lines, contiguous=True).where("not is_head").collect()
    assert sorted((r["source_id"], r["event_line"], r["value"].strip()) for r in owned) == sorted(
        (s, n, text) for (s, n), (_, rest) in expected.items() for text in rest
    )


@pytest.mark.parametrize("block", [1, 5, 1000])
def test_chunks_of_events(spark, tmp_path, block):
    logs = random_logs(block + 3)
    expected = {(s, n): (raw, rest) for s, texts in logs.items() for n, raw, rest in sequential.stitch(texts)}
    chunks = ingest.stitch_in_chunks(landed(spark, logs, block, tmp_path), contiguous=True).collect()
    found = {}
    for row in sorted(chunks, key=lambda r: r["block"]):
        raw, rest = found.get((row["source_id"], row["line_number"]), (None, []))
        found[row["source_id"], row["line_number"]] = (raw or row["raw"], rest + row["continuation_lines"])
        assert len(row["continuation_lines"]) <= block
    assert found == expected


def test_heads_are_found_without_moving_text(spark, tmp_path):
    lines = landed(spark, random_logs(5), 4, tmp_path)
    for df in (ingest.mark_heads(lines, True), ingest.stitch_continuations(lines, False, True)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # The other scan is that of the small table of blocks.
        assert plan.count("Exchange hashpartitioning") == 0 and plan.count("FileScan parquet") == 2
        assert len(re.findall(r"FileScan parquet \[[^\]]*value#", plan)) == 1


def test_base_times_parse_prefixes_only(spark, tmp_path):
    logs = {"a": ["[2031.07.09-08.15.30:250][77]LogA: late", "  LogB: Error: inside", "[2031.07.09-08.15.29:000][7]x"], "b": ["LogA: x"]}
    found = ingest.base_timestamps(landed(spark, logs, 2, tmp_path), contiguous=True)
    assert {(r[0], str(r[1])) for r in found.collect()} == {("a", "2031-07-09 08:15:29"), ("b", "None")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Log[A-Za-z0-9_]*" not in plan and "[^ =]" not in plan


def test_an_event_over_many_blocks_is_many_partitions(spark, tmp_path):
    logs = {"a": ["LogA: head"] + [f"  part {n}" for n in range(2000)] + ["LogA: end"]}
    lines = landed(spark, logs, 10, tmp_path)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        owned = ingest.assign_event_lines(lines, contiguous=True)
        counted = F.count(F.lit(1)).alias("count"), F.max("event_line")
        sizes = owned.groupBy(F.spark_partition_id().alias("p")).agg(*counted).collect()
        assert {r["event_line"] for r in owned.select("event_line").distinct().collect()} == {1, 2002}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(r["count"] for r in sizes) < 1000


def test_a_compressed_log_is_worked_on_in_blocks(spark, tmp_path):
    texts = [f"LogA: line {n}" if n % 50 else "  more" for n in range(1, 200_001)]
    with gzip.open(tmp_path / "big.log.gz", "wt") as file:
        file.write("".join(f"{text}\n" for text in texts))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = read_lines(spark, str(tmp_path / "big.log.gz"), F.lit("big"))
        events = ingest.parse_events(lines, contiguous=True)
        parts = events.groupBy(F.spark_partition_id().alias("p")).agg(
            F.count(F.lit(1)).alias("n"), F.max("line_number").alias("last")
        )
        found = parts.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert lines.select("block").distinct().count() == 4
    assert sum(r["n"] for r in found) == 196_000 and max(r["last"] for r in found) == 199_999
    assert len(found) > 1


def test_shuffled_form_gives_the_same(spark, monkeypatch):
    """The way without broadcast, for block tables that are not proven small."""
    monkeypatch.setattr("logloom.sources.scratch.BROADCAST_MAX_ROWS", -1)
    logs = random_logs(99, 5)
    rows = ingest.stitch_continuations(lines_frame(spark, logs, 3)).collect()
    assert {(r["source_id"], r["line_number"]): r["continuation_lines"] for r in rows} == {
        (s, number): rest for s, texts in logs.items() for number, _, rest in sequential.stitch(texts)
    }


def burst_rows(seed: int, count: int = 300):
    rng = random.Random(seed)
    rows, at = [], 0
    for line in range(1, 3 * count, 3):
        at += rng.choice([0, 1000, 4000, 9999, 10000, 10001, 30000, -5000])
        stamp = None if rng.random() < 0.05 else at / 1000
        rows.append(event(line, message=rng.choice(["poll", "poll", "poll", "poll", "other"]), seconds=stamp))
    return rows


@pytest.mark.parametrize("block_rows", [1, 2, 7, 100, 5000])
def test_bursts(spark, block_rows):
    rows = burst_rows(block_rows)
    start = min(r["timestamp"] for r in rows if r["timestamp"])
    keyed = [
        (r["line_number"], r["message"], (r["timestamp"] - start) // timedelta(milliseconds=1) if r["timestamp"] else None)
        for r in rows
    ]
    found = dedupe.deduplicate(events_frame(spark, *rows).repartition(5), "burst", block_rows)
    assert sorted((r["line_number"], r["count"]) for r in found.collect()) == sequential.bursts(keyed)


def test_burst_span_over_blocks(spark):
    rows = [event(i, message="poll", seconds=2 * i) for i in range(1, 21)]
    (row,) = dedupe.deduplicate(events_frame(spark, *rows), "burst", 3).collect()
    assert (row["line_number"], row["count"], row["span"]) == (1, 20, timedelta(seconds=38))


def test_event_index_and_deep_pages(spark):
    rows = [event(3 * i, source=s) for s in "ab" for i in range(1, 30)]
    frame = events_frame(spark, *rows)
    indexed = ordered.with_event_index(frame, block_rows=4).collect()
    assert {(r["source_id"], r["line_number"]): r["event_index"] for r in indexed} == {
        (s, 3 * i): i - 1 for s in "ab" for i in range(1, 30)
    }
    deep = paging._index_slice(frame, 27, 5, 4).collect()
    assert [(r["source_id"], r["line_number"]) for r in deep] == [("a", 84), ("a", 87), ("b", 3), ("b", 6), ("b", 9)]


def test_context_many(spark):
    lines = [5, 9, 10, 30, 31, 50, 70, 71]
    frame = events_frame(spark, *[event(n) for n in lines])
    anchors = spark.createDataFrame([("a", 9), ("a", 10), ("a", 71), ("a", 6), ("b", 5)], "source_id string, line_number long")
    found = paging.context_many(frame, anchors, 1, 2, block_rows=10)
    assert {(r["anchor_line"], r["line_number"]) for r in found.collect()} == sequential.indexed_context(
        lines, [9, 10, 71], 1, 2
    )


@pytest.mark.parametrize("block_rows", [1, 5, 1000])
def test_time_gaps(spark, block_rows):
    seconds = [0, 5, None, 100, 101, None, None, 300, 290]
    frame = events_frame(spark, *[event(i + 1, seconds=s) for i, s in enumerate(seconds)])
    found = timing.time_gaps(frame, timedelta(seconds=60), block_rows).collect()
    assert sorted((r["previous_line"], r["line_number"], r["gap"].total_seconds()) for r in found) == [
        (2, 4, 95.0),
        (5, 8, 199.0),
    ]


def test_text_files_in_splits(spark, tmp_path):
    """Files cut into many splits, with all three line ends, are numbered and stitched as a whole."""
    rng = random.Random(5)
    logs = {}
    for name, end in (("unix", "\n"), ("dos", "\r\n"), ("old", "\r")):
        texts = [f"{rng.choice(SHAPES)} {n}" for n in range(400)]
        texts[10:13] = ["", "   ", "  tail"]
        logs[name] = texts
        (tmp_path / f"{name}.log").write_bytes((end.join(texts) + end).encode())
    (tmp_path / "bom.log").write_bytes("﻿LogA: first\nLogA: no newline at end".encode())
    logs["bom"] = ["LogA: first", "LogA: no newline at end"]
    (tmp_path / "empty.log").write_bytes(b"")
    from logloom.sources.lines import read_lines

    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        name = F.regexp_extract(F.col("_metadata.file_path"), r"([a-z]+)\.log$", 1)
        lines = read_lines(spark, str(tmp_path / "*.log"), name)
        assert lines.select("block").distinct().count() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    numbered = ingest.number_lines(lines, contiguous=True)
    assert {(r["source_id"], r["line_number"]): r["value"] for r in numbered.collect()} == {
        (s, i): text for s, texts in logs.items() for i, text in enumerate(texts, 1)
    }
    rows = ingest.stitch_continuations(lines, contiguous=True).collect()
    assert {(r["source_id"], r["line_number"]): (r["raw"], r["continuation_lines"]) for r in rows} == {
        (s, number): (raw, rest) for s, texts in logs.items() for number, raw, rest in sequential.stitch(texts)
    }
