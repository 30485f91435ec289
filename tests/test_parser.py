"""Parsing of single lines and stitching, one source per case so that one job serves all."""

from __future__ import annotations

import hashlib
from datetime import datetime

import pytest

from logloom.operators.ingest import ParserOptions, parse_events
from tests.helpers import by_line, lines_frame

STAMP = "[2031.07.09-08.15.30:250]"
CASES = {
    "full": [f"{STAMP}[77]LogPhysics: Warning: body fell"],
    "no_prefix": ["LogAudio: Error: no device"],
    "no_verbosity": ["LogAudio:   just text  "],
    "padded_frame": [f"{STAMP}[  5]LogAudio: x"],
    "signed_frame": [f"{STAMP}[-3]LogAudio: x"],
    "later_frame": [f"{STAMP} note [9] LogAudio: Log: x"],
    "plain": ["   nothing to see  "],
    "stamp_without_frame": [f"{STAMP}LogAudio: Warning: x"],
    "bad_frame": [f"{STAMP}[1x]LogAudio: Warning: x"],
    "nested_frame": [f"{STAMP}[[5]LogAudio: Warning: x"],
    "huge_frame": [f"{STAMP}[99999999999]LogAudio: Warning: x"],
    "prefix_no_category": [f"{STAMP}[4]something else"],
    "bad_date": ["[2031.02.30-08.15.30:250][1]LogAudio: Warning: x"],
    "second_sixty": ["[2031.02.20-08.15.60:250][1]LogAudio: Warning: x"],
    "year_zero": ["[0000.02.20-08.15.10:250][1]LogAudio: Warning: x"],
    "short_fraction": ["[2031.02.20-08.15.10:25][1]LogAudio: Warning: x"],
    "unknown_word": ["LogAudio: DeviceLost: gone"],
    "category_alone": ["LogAudio:"],
    "verbosity_alone": ["LogAudio: Warning:"],
    "double_colon": ["LogAudio::text"],
    "spaced_category": ["LogAudio : warning : quiet"],
    "lower_log": ["logAudio: Warning: x"],
    "dashed_category": ["Log-Audio: Warning: x"],
    "letters": ["LogÄther2_x: Verbose: ok"],
    "astral_category": ["Log\U00010400: Warning: x"],
    "bare_log": ["Log: Display: x"],
    "leading_colon": [": Warning: x"],
    "nbsp": ["\u00a0LogAudio\u2003:\u00a0Warning : x\u3000"],
    "continued": ["LogA: one", "  {", '   "k": 1', "  }", "LogA: two"],
    "blank_inside": ["LogA: one", "  more", "   ", "", "\tstill more", "LogA: two"],
    "indented_event": ["LogA: one", "  LogB: Warning: own event", "   rest"],
    "indented_prefix_only": ["LogA: one", f"  {STAMP}[1]no category here"],
    "indented_first": ["   lead in", "   and on", "LogA: x"],
    "indented_first_after_blank": ["", "   ", "  lead in", "  tail"],
    "blank_only": ["", "   ", "\t"],
    "unindented_text": ["LogA: one", "free text", "  tail"],
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = by_line(parse_events(lines_frame(spark, CASES, block=2)))
    found = {}
    for (source, _), row in sorted(rows.items()):
        found.setdefault(source, []).append(row)
    return found


def shape(row):
    return (row["category"], row["verbosity"], row["message"])


AT = datetime(2031, 7, 9, 8, 15, 30, 250000)


@pytest.mark.parametrize(
    "case, timestamp, frame, expected",
    [
        ("full", AT, 77, ("LogPhysics", "Warning", "body fell")),
        ("no_prefix", None, None, ("LogAudio", "Error", "no device")),
        ("no_verbosity", None, None, ("LogAudio", "Display", "just text")),
        ("padded_frame", AT, 5, ("LogAudio", "Display", "x")),
        ("signed_frame", AT, -3, ("LogAudio", "Display", "x")),
        ("later_frame", AT, 9, ("LogAudio", "Log", "x")),
        ("plain", None, None, ("Unknown", "Display", "nothing to see")),
        ("stamp_without_frame", None, None, ("Unknown", "Display", f"{STAMP}LogAudio: Warning: x")),
        ("bad_frame", None, None, ("Unknown", "Display", f"{STAMP}[1x]LogAudio: Warning: x")),
        ("nested_frame", None, None, ("Unknown", "Display", f"{STAMP}[[5]LogAudio: Warning: x")),
        ("huge_frame", None, None, ("Unknown", "Display", f"{STAMP}[99999999999]LogAudio: Warning: x")),
        ("prefix_no_category", AT, 4, ("Unknown", "Display", f"{STAMP}[4]something else")),
        ("bad_date", None, None, ("Unknown", "Display", CASES["bad_date"][0])),
        ("second_sixty", None, None, ("Unknown", "Display", CASES["second_sixty"][0])),
        ("year_zero", None, None, ("Unknown", "Display", CASES["year_zero"][0])),
        ("short_fraction", None, None, ("Unknown", "Display", CASES["short_fraction"][0])),
        ("unknown_word", None, None, ("LogAudio", "Display", "DeviceLost: gone")),
        ("category_alone", None, None, ("Unknown", "Display", "LogAudio:")),
        ("verbosity_alone", None, None, ("LogAudio", "Warning", "")),
        ("double_colon", None, None, ("LogAudio", "Display", ":text")),
        ("spaced_category", None, None, ("LogAudio", "warning", "quiet")),
        ("lower_log", None, None, ("Unknown", "Display", "logAudio: Warning: x")),
        ("dashed_category", None, None, ("Unknown", "Display", "Log-Audio: Warning: x")),
        ("letters", None, None, ("LogÄther2_x", "Verbose", "ok")),
        ("astral_category", None, None, ("Unknown", "Display", "Log\U00010400: Warning: x")),
        ("bare_log", None, None, ("Log", "Display", "x")),
        ("leading_colon", None, None, ("Unknown", "Display", ": Warning: x")),
        ("nbsp", None, None, ("LogAudio", "Warning", "x")),
    ],
)
def test_head(parsed, case, timestamp, frame, expected):
    (row,) = parsed[case]
    assert (row["timestamp"], row["frame"]) == (timestamp, frame)
    assert shape(row) == expected


@pytest.mark.parametrize(
    "case, expected",
    [
        ("continued", [(1, ["{", '"k": 1', "}"]), (5, [])]),
        ("blank_inside", [(1, ["more", "still more"]), (6, [])]),
        ("indented_event", [(1, []), (2, ["rest"])]),
        ("indented_prefix_only", [(1, [f"{STAMP}[1]no category here"])]),
        ("indented_first", [(1, ["and on"]), (3, [])]),
        ("indented_first_after_blank", [(3, ["tail"])]),
        ("unindented_text", [(1, []), (2, ["tail"])]),
    ],
)
def test_continuation(parsed, case, expected):
    assert [(row["line_number"], row["continuation_lines"]) for row in parsed[case]] == expected


def test_blank_only_log_has_no_events(parsed):
    assert "blank_only" not in parsed


def test_constant_columns(parsed):
    (row,) = parsed["full"]
    assert row["source_path"] == "full.log" and row["relative_time"] is None
    assert row["schema_version"] == "logevent.v1"


def test_hash_covers_untrimmed_head_only(parsed):
    head = parsed["continued"][0]
    assert head["raw_text_hash"] == "sha256:" + hashlib.sha256(b"LogA: one").hexdigest()
    (indented,) = parsed["plain"]
    assert indented["raw_text_hash"] == "sha256:" + hashlib.sha256(b"   nothing to see  ").hexdigest()


def test_options(spark):
    lines = lines_frame(spark, {"s": ["LogA: one", "  more", "LogA: two"]})
    options = ParserOptions(
        include_continuation_lines=False, capture_raw_text_hash=False, expected_schema_version="other.v9"
    )
    rows = by_line(parse_events(lines, options))
    assert sorted(line for _, line in rows) == [1, 3]
    first = rows[("s", 1)]
    assert (first["continuation_lines"], first["raw_text_hash"], first["schema_version"]) == ([], "", "other.v9")
    loose = ParserOptions(strict_schema_version=False, expected_schema_version="other.v9")
    assert by_line(parse_events(lines, loose))[("s", 1)]["schema_version"] == "logevent.v1"
