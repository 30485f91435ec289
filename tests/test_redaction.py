from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from logloom.functions.redaction import EXTENDED_RULES, redact_text
from logloom.operators.redact import extract_profile_fields, redact
from tests.helpers import event, events_frame

TEXTS = [
    ("Session=abc-1 ok", "Session=<session_id> ok"),
    ("sessionId: xyz", "sessionId: <session_id>"),
    ('Session="q w"', 'Session="<session_id> w"'),
    ('"ticket": "t_9", "user" : "u1"', '"ticket": "<ticket_id>", "user" : "<user_id>"'),
    ("TicketId=1 UserId=2 SessionId=3", "TicketId=<ticket_id> UserId=<user_id> SessionId=<session_id>"),
    ("Session=ab.cd", "Session=<session_id>.cd"),
    ("SESSION=1 sessionid=2", "SESSION=1 sessionid=2"),
    ("MySession=1", "MySession=1"),
    ("Session=<session_id>", "Session=<session_id>"),
    ("server busy, observed", "server busy, observed"),
    ("", ""),
]


def test_text(spark):
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "i int, t string")
    once = redact_text(F.col("t"))
    rows = {r["i"]: r for r in frame.select("i", once.alias("once"), redact_text(once).alias("twice")).collect()}
    for i, (_, expected) in enumerate(TEXTS):
        assert rows[i]["once"] == expected
        assert rows[i]["twice"] == expected


def test_whole_event(spark):
    row = event(
        1,
        message="user=me",
        seconds=1,
        continuation_lines=['"session": "s1",', "plain"],
        fields={"SESSIONID": "raw value", "Ticket": "", "user": "u", "note": "ticket=5"},
        raw_text_hash="sha256:x",
    )
    (found,) = redact(events_frame(spark, row)).collect()
    assert found["message"] == "user=<user_id>"
    assert found["continuation_lines"] == ['"session": "<session_id>",', "plain"]
    assert found["fields"] == {
        "SESSIONID": "<session_id>",
        "Ticket": "<ticket_id>",
        "user": "<user_id>",
        "note": "ticket=<ticket_id>",
    }
    kept = ["line_number", "timestamp", "category", "verbosity", "raw_text_hash", "source_id"]
    assert [found[name] for name in kept] == [row[name] for name in kept]


def test_extended(spark):
    text = "LobbyId=l1 EntityId:e2 Queue=q machine=pc-1.lan Project=p from 10.0.0.17 to host Session=s"
    frame = events_frame(spark, event(1, message=text))
    (found,) = redact(frame, EXTENDED_RULES).collect()
    assert found["message"] == (
        "LobbyId=<lobby_id> EntityId:<entity_id> Queue=<queue_name> machine=<machine_name> "
        "Project=<project_name> from <ip_address> to host Session=<session_id>"
    )


def test_profile_fields(spark):
    frame = events_frame(
        spark,
        event(1, message="took 15 ms on map Desert", fields={"map": "old", "x": "1"}),
        event(2, message="nothing", fields={"x": "1"}),
    )
    found = extract_profile_fields(frame, {"ms": r"took (\d+) ms", "map": r"map (\w+)"}).orderBy("line_number").collect()
    assert [r["fields"] for r in found] == [{"x": "1", "ms": "15", "map": "Desert"}, {"x": "1"}]
    with pytest.raises(ValueError):
        extract_profile_fields(frame, {"bad": "no group"})
