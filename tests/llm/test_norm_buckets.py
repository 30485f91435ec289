"""Norm buckets: what reaches the driver, exact products of every number type, groups of blocks in several tasks."""

from __future__ import annotations

import math
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import norm_buckets

REPO = Path(norm_buckets.__file__).parents[2]

SMALL_DRIVER = """
import sys
import numpy as np
from pyspark.sql import SparkSession, functions as F
from logloom.llm import norm_buckets

spark = (
    SparkSession.builder.master("local[2]")
    .config("spark.ui.enabled", "false")
    .config("spark.driver.maxResultSize", "2m")
    .config("spark.sql.shuffle.partitions", "32")
    .config("spark.sql.files.maxPartitionBytes", "64k")
    .config("spark.sql.autoBroadcastJoinThreshold", "100m")
    .config("spark.checkpoint.dir", sys.argv[1])
    .getOrCreate()
)
rows = [(i, x.tolist()) for i, x in enumerate(np.random.default_rng(1).normal(size=(6400, 64)))]
spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(sys.argv[1] + "/in")
vectors = spark.read.parquet(sys.argv[1] + "/in")
print("rows", len(norm_buckets.top_k(vectors, F.col("vec_id") % 50 == 0).collect()))
"""


def test_blocks_stay_off_the_driver(tmp_path):
    # 32 blocks of 100 KB as 64-bit numbers, or copies of the queries for every salt, do not go through 2 MB.
    env = os.environ | {"PYTHONPATH": f"{REPO}:{os.environ.get('PYTHONPATH', '')}"}
    run = subprocess.run([sys.executable, "-c", SMALL_DRIVER, str(tmp_path)], env=env, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr[-3000:]
    assert "rows 640" in run.stdout


def by_brute_force(rows, k=5):
    out = []
    for q, a in rows:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), c) for c, b in rows if c != q)
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def test_plan_copies_no_blocks(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(60)], "vec_id long, embedding array<double>")
    plan = norm_buckets.top_k(df, F.col("vec_id") % 50 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate" not in plan


@pytest.mark.parametrize("size", [1, 3e4, 1e6], ids=["float32", "float64", "int64"])
def test_scores_are_exact(spark, size):
    rng = np.random.default_rng(4)
    vectors = [(i, (rng.normal(size=6) * size).tolist()) for i in range(260)]
    vectors += [(260 + i, [x + 0.01 * size * rng.normal() for x in vectors[i % 5 * 50][1]]) for i in range(60)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = norm_buckets.top_k(df, F.col("vec_id") % 50 == 0, norm_buckets.Search(bucket_rows=64, query_rows=3))
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors]
    assert sorted(map(tuple, got.collect())) == by_brute_force(rows)


def test_negative_scores_and_uneven_widths(spark):
    # All products are negative or zero; short vectors are best, and must not be pruned by a cosine.
    vectors = [(i, [float(1 + i % 7)] * (1 + i % 4)) for i in range(1, 150) if i % 50]
    vectors += [(i, [-1.0, -2.0, -0.5, -3.0]) for i in (0, 50, 100)] + [(200, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors]
    for how in (norm_buckets.Search(bucket_rows=16), norm_buckets.Search(bucket_rows=16, coordinate_from=-2.0)):
        got = norm_buckets.top_k(df, F.col("vec_id") % 50 == 0, how)
        assert sorted(map(tuple, got.collect())) == by_brute_force(rows)


def test_groups_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(norm_buckets, "BUCKET_GROUP", 2)
    monkeypatch.setattr(norm_buckets, "QUERY_GROUP", 1)
    rng = np.random.default_rng(6)
    vectors = [(50 * i if i < 40 else 50 * i + 7, rng.normal(size=5).tolist()) for i in range(400)]
    vectors += [(i, v) for i, v in vectors[:30]] + [(100, [9.0] * 5), (2007, [9.0] * 5)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = norm_buckets.top_k(df, F.col("vec_id") % 50 == 0, norm_buckets.Search(k=3, bucket_rows=8, query_rows=4))
    rows = sorted({(i, tuple(math.floor(256 * x) for x in v)) for i, v in vectors})
    best = {}
    for q, a in rows:
        if q % 50 == 0:
            scored = [(-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in rows if c != q]
            best.setdefault(q, []).extend(sorted(scored)[:3])
    expected = [(q, n + 1, c, -s) for q, found in best.items() for n, (s, c) in enumerate(sorted(found)[:3])]
    assert sorted(map(tuple, got.collect())) == sorted(expected)
