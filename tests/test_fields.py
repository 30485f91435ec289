from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from logloom.functions.parsing import with_fields

CASES = [
    ("no fields here", {}),
    ("a=1 b=two", {"a": "1", "b": "two"}),
    ("a=1, b=2; c=3,;", {"a": "1", "b": "2", "c": "3"}),
    ('k="two words" z=1', {"k": "two words", "z": "1"}),
    ('k="open to the end', {"k": "open to the end"}),
    ('k="', {"k": ""}),
    ('k="a"next=2', {"k": "a", "next": "2"}),
    ('k="" m=1', {"k": "", "m": "1"}),
    ("k= m=1", {"k": "", "m": "1"}),
    ("tail=", {}),
    ("=skip k=1 =x", {"k": "1"}),
    ("a=1 a=2 a=3", {"a": "3"}),
    ("A=1 a=2", {"A": "1", "a": "2"}),
    ('v=b"c d', {"v": 'b"c'}),
    ("k=a=b", {"k": "a=b"}),
    ('"q=5"', {'"q': '5"'}),
    ("word k=1\tm=2\u00a0n=3", {"k": "1", "m": "2", "n": "3"}),
    ("ä=ö k=\u2003x=1", {"ä": "ö", "k": "", "x": "1"}),
    ("k=,;", {"k": ""}),
    ("", {}),
]


@pytest.fixture(scope="module")
def found(spark):
    frame = spark.createDataFrame(list(enumerate(text for text, _ in CASES)), "i int, message string")
    return {row["i"]: row["fields"] for row in with_fields(frame).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_fields(found, i):
    assert found[i] == CASES[i][1]


def test_many_fields_last_wins(spark):
    frame = spark.range(1).select(
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5000)), lambda i: F.concat(F.lit("k"), (i % 7).cast("string"), F.lit("="), i.cast("string"))), " ").alias("message")
    )
    (row,) = with_fields(frame).collect()
    assert row["fields"] == {f"k{i % 7}": str(i) for i in range(4994, 5001)}
