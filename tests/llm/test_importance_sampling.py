"""The sample beside a sequential version, with many runs and segments."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logloom.llm.importance_sampling import Sampling, resample, sorted_runs, splitters
from logloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, rank string, score string, segment string, run string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, width):
    lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lowered)
    runs = [" ".join(words[i : i + k]) for k in range(1, width + 1) for i in range(len(words) - k + 1)]
    return words, [zlib.crc32(f.encode()) for f in runs]


def plain(rows, target, sampling):
    n = sampling.buckets
    cut = [(i, *features(t, sampling.width)) for i, t in rows]
    s = Counter(f % n for _, _, found in cut for f in found)
    t = Counter(f % n for text in target for f in features(text, sampling.width)[1])
    corpus, wanted = sum(s.values()) + n, sum(t.values()) + n
    gain = [math.floor(1000 * math.log((t[b] + 1) * corpus / ((s[b] + 1) * wanted))) for b in range(n)]
    out, order = [], []
    for at, (i, words, found) in enumerate(cut):
        weight = sum(gain[f % n] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{sampling.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None])
        if len(words) >= sampling.least_words:
            order.append((-score, i is None, i or 0, at))
    for rank, (*_, at) in enumerate(sorted(order)[: sampling.per_cent * len(order) // 100], 1):
        out[at][4] = rank
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


def frame(spark, rows, partitions=5):
    return spark.createDataFrame([(i, t, "r", "s", "g", "u") for i, t in rows], SCHEMA).repartition(partitions)


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "él", "漢字", "a1", "queue", "b", "c-d", "x.y", "straße"]
    rows = [(7 * i - 300, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return rows + [(5001, None), (5002, ""), (5003, "the " * 50_000), (None, "no id " * 30)]


TARGET = ["the queue of queues", "él", None, ""]


@pytest.mark.parametrize("width, segment_rows, marks", [(1, 30, 200_000), (2, 7, 200_000), (1, 11, 40), (1, 10_000, 5)])
def test_like_a_sequential_version(spark, width, segment_rows, marks):
    sampling = Sampling(width=width, buckets=97, segment_rows=segment_rows, marks=marks, per_cent=30)
    rows = corpus()
    rows += [(11, "same text again " * 9)] * 90 + [(None, "b " * 25)] * 3
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    found = resample(frame(spark, rows), target, sampling)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert in_order(found.collect()) == in_order(plain(rows, TARGET, sampling))


def test_equal_scores_go_to_the_smaller_id(spark):
    # One bucket and texts without a difference in weight; many ids, few scores.
    sampling = Sampling(buckets=1, scale=1, segment_rows=10, per_cent=50)
    rows = [(i, "a " * 20) for i in range(300)]
    target = spark.createDataFrame([("a",)], "text string")
    found = {r["doc_id"]: r for r in resample(frame(spark, rows), target, sampling).collect()}
    drawn = sorted((r["rank"], -r["score"], i) for i, r in found.items() if r["rank"])
    assert [r for r, _, _ in drawn] == list(range(1, 151))
    assert [x[1:] for x in drawn] == sorted(x[1:] for x in drawn)
    assert max(x[1:] for x in drawn) < min((-r["score"], i) for i, r in found.items() if not r["rank"])


def test_segments_are_bounded(spark):
    rows = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight")
    )
    rows = rows.withColumn("score", F.col("doc_id") % 3).withColumn("taking", F.lit(True)).repartition(8)
    for marks in (100_000, 64, 8):
        sampling = Sampling(marks=marks)
        runs = sorted_runs(rows, sampling).cache()
        cuts = splitters(runs, 5, sampling)
        assert len(cuts) == 4 and (cuts[1:] >= cuts[:-1]).all()
        runs.unpersist()


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    target = spark.createDataFrame([], "text string")
    assert resample(none, target).collect() == []
    rows = [(1, "one two " * 20), (2, "")]
    found = resample(frame(spark, rows), target, Sampling(per_cent=100))
    assert in_order(found.collect()) == in_order(plain(rows, [], Sampling(per_cent=100)))


def test_query_draws_from_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    found = QUERIES["op13_regular_sampling"](spark, sf).collect()
    assert in_order(found) == in_order(plain(docs, target, Sampling()))
