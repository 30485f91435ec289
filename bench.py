"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each query
runs once to warm up and then ``BENCH_RUNS`` times; the median counts. The time
includes building the plan and every small job a query starts on the way. The
check of splits is listed, but not part of the total. ``sql`` has the time of
the same queries' SQL on the same files.
"""

from __future__ import annotations

import json
import os
import random
import statistics
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

from checks.compare import connect
from checks.oracle_queries import ORACLES
from checks.spark_queries import QUERIES

HEADLINE = ["facet_category", "filter_compound", "dedupe_normalized", "dedupe_burst", "stitch_continuations"]


def line_numbering_splits(spark: SparkSession) -> dict[str, float]:
    """Time to land and number one file cut into 1, 4 and 16 splits."""
    from logloom.operators.ingest import number_lines
    from logloom.sources.lines import read_lines

    path = Path(tempfile.mkdtemp(prefix="bench-")) / "one.log"
    line = "[2030.01.01-10.00.00:000][1]LogGame: Warning: a line of ordinary length for the split check\n"
    path.write_text(line * 400_000)
    size = path.stat().st_size
    times = {}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    # A first run that does not count, then all sizes in random order.
    order = [4, *random.Random(0).sample([1, 4, 16], 3)]
    for turn, splits in enumerate(order):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // splits + 1))
        start = time.time()
        number_lines(read_lines(spark, str(path)), contiguous=True).write.format("noop").mode("overwrite").save()
        if turn:
            times[f"line_numbering_{splits}_splits"] = round(time.time() - start, 3)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return dict(sorted(times.items()))


def sql_times(sf_dir: str, cpus: str) -> dict[str, float]:
    """The SQL of the same queries on the same files, in one process with as many threads: a point of reference."""
    connection = connect(sf_dir)
    connection.execute(f"SET threads TO {int(cpus)}")
    times = {}
    for name in HEADLINE:
        connection.execute(ORACLES[name]).fetchall()
        start = time.time()
        connection.execute(ORACLES[name]).fetchall()
        times[name] = round(time.time() - start, 3)
    return times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        taken = []
        for _ in range(1 + runs):
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.time() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    total = sum(times.values())
    times.update(line_numbering_splits(spark))
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(total, 3),
                "unit": "sec",
                "queries": times,
                "sql": sql_times(sf_dir, cpus),
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
