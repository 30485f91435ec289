"""The table of findings beside the operators that look at events, and how often a log is parsed."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import compare, dedupe, findings, ordered, paging, semantics
from logloom.operators.findings import land_findings
from logloom.plans.profiles import load_profile
from logloom.plans.report import markdown_report
from logloom.plans.rules import DEFAULT_RULES, SemanticRule
from tests import sequential
from tests.helpers import event, events_frame

PROFILE = load_profile("ue-default")
MANY = tuple(SemanticRule(f"r{i:03}", f"k{i % 7}.x", ("low", "medium", "high")[i % 3], "why", message_contains_any=(f"<{i}>",)) for i in range(130))


def sample(n=400, seed=1, rules=False):
    rng = random.Random(seed)
    texts = ["JoinSession has failed", "NetworkFailure: x", "Login failed", "a fatal error", "plain", None]
    rows = []
    for i in range(n):
        text = "".join(f"<{rng.randrange(140)}>" for _ in range(3)) if rules else rng.choice(texts)
        category = rng.choice(["LogNet", "logonline", "LogTravel", "LogSlate", None])
        level = rng.choice(["Error", "Warning", "Display", "Fatal", "Log", None])
        rows.append(event(i, category, level, text, rng.randrange(900), source=rng.choice("abc")))
    return rows


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


@pytest.mark.parametrize("rules", [DEFAULT_RULES, MANY, ()])
def test_like_the_operators_on_events(spark, rules):
    events = events_frame(spark, *sample(rules=rules is MANY)).repartition(5).cache()
    found, classified = land_findings(events, rules, PROFILE), semantics.classify(events, rules)
    assert rows_of(found.kinds()) == rows_of(semantics.finding_counts(classified))
    columns = ["source_id", *findings.FAILURE_COLUMNS]
    assert rows_of(found.first_failure(), *columns) == rows_of(semantics.first_failure(classified), *columns)
    for systems in ((), ("network", "runtime", "k3")):
        expected = semantics.first_failure_by_system(classified, systems)
        assert rows_of(found.first_failure_by_system(systems), "system", *columns) == rows_of(expected, "system", *columns)
    steps = semantics.timeline(events, rules, PROFILE, 9, 16)
    steps = steps.withColumn("is_important", F.coalesce("is_important", F.lit(False)))
    assert rows_of(found.timeline(9, 16)) == rows_of(steps)
    by_source = classified.groupBy("source_id", "kind").agg(F.count(F.lit(1)))
    assert rows_of(found.kinds("source_id"), "source_id", "kind", "count") == rows_of(by_source)


def counted(spark, rows):
    """Events, and a counter of how many of them a job has made."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def see(text):
        seen.add(1)
        return text

    made = events_frame(spark, *rows).repartition(3)
    return made.withColumn("source_id", see.asNondeterministic()("source_id")), seen


def once(spark, rows, job):
    events, seen = counted(spark, rows)
    job(events).collect()
    assert seen.value == len(rows)


@pytest.mark.parametrize(
    "job",
    [
        lambda e: markdown_report(e, PROFILE, entries=4, block_rows=32),
        lambda e: land_findings(e, profile=PROFILE).first_failure(),
        lambda e: dedupe.deduplicate(e, "burst", 16),
        lambda e: compare.divergence(e, "a", "b", block_rows=32),
        lambda e: compare.align_by_order(e, "a", "b", 32),
        lambda e: compare.align_by_time(e, "a", "b", 32),
        lambda e: paging._index_slice(e, 30, 20, 16),
        lambda e: paging.context_many(e, e.sparkSession.createDataFrame([("a", 1), ("b", 9)], "source_id string, line_number bigint"), 2, 3, 16),
    ],
)
def test_a_log_is_made_once(spark, job):
    rows = sample(300)
    if job.__code__.co_names[0] == "compare":
        rows = [r for r in rows if r["source_id"] in "ab"]
    once(spark, rows, job)


# --- levels of groups, digests, intervals ---------------------------------------


@pytest.mark.parametrize("total", [False, True])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_what_rows_hand_on(spark, total, keys):
    rng = random.Random(7)
    rows = [(k, o, None if rng.random() < 0.5 else rng.randrange(99)) for k in "ab" for o in rng.sample(range(-300, 4000), 250)]
    if not keys:
        rows = [r for r in rows if r[0] == "a"]
    table = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    found = ordered.carried(table, "o", "v", "out", keys, total, bits=2, levels=5)
    expected = []
    for k in {r[0] for r in rows}:
        last = 0 if total else None
        for _, o, v in sorted(r for r in rows if r[0] == k):
            expected.append((*([k] if keys else []), o, last))
            last = (last + (v or 0)) if total else (last if v is None else v)
    assert rows_of(found) == sorted(expected, key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("job", ["time", "page"])
def test_no_window_without_a_key(spark, job):
    events = events_frame(spark, *sample(100)).repartition(3)
    df = compare.align_by_time(events, "a", "b", 16) if job == "time" else paging._index_slice(events, 30, 20, 16)
    df.collect()
    assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("change, expected", [(None, None), (0, 0), (17, 17), (63, 63), ("short", 60), ("long", 64)])
@pytest.mark.parametrize("fan", [2, 4, 1000])
def test_first_difference(spark, change, expected, fan):
    left = [(n, b"k%d" % (n % 5)) for n in range(64)]
    right = list(left)
    if change == "short":
        right = right[:60]
    elif change == "long":
        right.append((64, b"x"))
    elif change is not None:
        right[change] = (change, b"other")
        right[min(63, change + 9)] = (min(63, change + 9), b"other")
    rows = [("l", i, n + 100, k) for i, (n, k) in enumerate(left)] + [("r", i, n + 200, k) for i, (n, k) in enumerate(right)]
    indexed = spark.createDataFrame(rows, "source_id string, event_index bigint, line_number bigint, _key binary")
    found = compare.first_difference(indexed, "l", fan)
    if expected is None:
        assert found is None
    else:
        assert tuple(found.first()) == (
            expected, expected + 100 if expected < 64 else None, expected + 200 if change != "short" else None,
        )


@pytest.mark.parametrize("block", [3, 1000])
def test_contexts_that_overlap(spark, block):
    lines = {"a": list(range(1, 90, 2)), "b": [4, 5, 6, 40]}
    rows = [event(n, source=s) for s, numbers in lines.items() for n in numbers]
    anchors = [("a", 1), ("a", 5), ("a", 7), ("a", 7), ("a", 51), ("a", 89), ("b", 6), ("b", 7), ("c", 1)]
    frame = spark.createDataFrame(anchors, "source_id string, line_number bigint")
    found = paging.context_many(events_frame(spark, *rows).repartition(3), frame, 3, 4, block)
    pairs = sorted((r["source_id"], r["anchor_line"], r["line_number"]) for r in found.collect())
    expected = [
        (s, anchor, line)
        for s, numbers in lines.items()
        for anchor, line in sequential.indexed_context(numbers, sorted({n for t, n in anchors if t == s and n in numbers}), 3, 4)
    ]
    assert pairs == sorted(expected)
