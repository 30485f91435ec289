from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from logloom.operators.redact import redact
from logloom.schema import SchemaMismatch, assert_event_schema
from logloom.sinks import event_files as sinks
from logloom.sources import event_files as sources
from logloom.streaming import event_stream
from tests.helpers import START, event, events_frame, lines_of

FULL = event(
    3, "LogÄ", "Warning", 'say "hi" <b> user=x', 1.25, frame=9, relative_time=timedelta(days=1, seconds=3, milliseconds=40),
    continuation_lines=["one", 'two "2"'], fields={"k": "v", "user": "x"}, raw_text_hash="sha256:ab",
)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[3])


def test_json_round_trip(spark, tmp_path):
    frame = events_frame(spark, FULL, event(4))
    path = str(tmp_path / "json")
    sinks.write_json(frame, path)
    assert rows(sources.read_json_events(spark, path)) == rows(frame)
    text = sinks.to_ndjson(events_frame(spark, FULL)).first()["value"]
    assert text.startswith('{"SchemaVersion":"logevent.v1","SourceId":"a"')
    assert '"Timestamp":"2030-05-01T10:00:01.25+00:00"' in text
    assert '"RelativeTime":"1.00:00:03.0400000"' in text and "<b>" in text and "Ä" in text
    assert '"Frame":null' in sinks.to_ndjson(events_frame(spark, event(4))).first()["value"]


def test_other_spellings_and_offsets(spark, tmp_path):
    (tmp_path / "in.json").write_text(
        '{"sourceId":"g","lineNumber":42,"timestamp":"2030-05-14T19:30:00.123Z","frame":7,"category":"LogA",'
        '"verbosity":"Log","message":"m","continuationLines":["c"],"fields":{"K":"v"},"rawTextHash":""}\n'
        '{"SOURCEID":"g","LineNumber":43,"timestamp":"2030-05-14T21:30:00+02:00","message":"n"}\n'
    )
    first, second = sources.read_json_events(spark, str(tmp_path)).orderBy("line_number").collect()
    assert str(first["timestamp"]) == "2030-05-14 19:30:00.123000" and str(second["timestamp"]) == "2030-05-14 19:30:00"
    assert (first["frame"], first["continuation_lines"], first["fields"]) == (7, ["c"], {"K": "v"})
    assert (second["source_id"], second["category"]) == ("g", None)


def test_broken_records(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"lineNumber":1}\nnot json\n')
    with pytest.raises(Exception):
        sources.read_json_events(spark, str(tmp_path)).collect()
    good, bad = sources.read_json_events_with_errors(spark, str(tmp_path))
    assert lines_of(good) == [1] and [r["record"] for r in bad.collect()] == ["not json"]


def test_a_record_is_parsed_once(spark, tmp_path, capsys):
    frame = events_frame(spark, FULL, event(4))
    path = str(tmp_path / "json")
    sinks.write_json(frame, path)
    read = sources.read_json_events(spark, path)
    for asked in (read, read.where("line_number > 3 and category = 'LogA'").select("message")):
        asked.explain()
        # The parse of the record, and that of its fields, which are a map too.
        assert capsys.readouterr().out.count("from_json(MapType(StringType") == 2


def test_a_broken_column_fails_the_job_even_if_it_is_not_asked_for(spark, tmp_path):
    (tmp_path / "events.json").write_text('{"sourceId":"a","lineNumber":1}\n{"lineNumber":2,"frame":"x"}\n')
    with pytest.raises(Exception, match="broken event record"):
        sources.read_json_events(spark, str(tmp_path)).select("line_number").where("line_number = 2").collect()


def test_contract(spark):
    frame = events_frame(spark, FULL)
    assert assert_event_schema(frame.withColumn("more", F.lit(1))).columns == frame.columns
    with pytest.raises(SchemaMismatch, match="missing frame"):
        assert_event_schema(frame.drop("frame"))
    with pytest.raises(SchemaMismatch, match="line_number is int"):
        assert_event_schema(frame.withColumn("line_number", F.lit(1)))


def test_stream(spark, tmp_path):
    source, target, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    frame = events_frame(spark, FULL, event(5, message="ticket=1"))
    sinks.write_json(frame, source)
    stream = redact(event_stream.stream_json_events(spark, source, 1))
    event_stream.write_json_stream(stream, target, state).awaitTermination()
    assert rows(sources.read_json_events(spark, target)) == rows(redact(frame))
    # A restart goes on from the checkpoint and writes nothing twice.
    event_stream.write_json_stream(stream, target, state).awaitTermination()
    assert sources.read_json_events(spark, target).count() == 2


@pytest.mark.parametrize(
    "bad",
    [
        '{"lineNumber":"abc"}',
        '{"frame":"x"}',
        '{"timestamp":"yesterday"}',
        '{"relativeTime":"soon"}',
        '{"continuationLines":"no list"}',
        '{"fields":"no object"}',
        "no json",
    ],
)
def test_bad_records_are_told_apart(spark, tmp_path, bad):
    (tmp_path / "events.json").write_text(f'\n{{"sourceId":"a","lineNumber":1}}\n  \n{bad}\n')
    good, broken = sources.read_json_events_with_errors(spark, str(tmp_path))
    assert [r["line_number"] for r in good.collect()] == [1]
    assert [r["record"] for r in broken.collect()] == [bad]
    with pytest.raises(Exception, match="broken event record"):
        sources.read_json_events(spark, str(tmp_path)).collect()
