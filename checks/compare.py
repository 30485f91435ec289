"""Run queries beside their SQL and compare: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracle_queries import ORACLES
from checks.spark_queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def canonical(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    normal = pd.DataFrame()
    for name in columns:
        column = frame[name]
        if pd.api.types.is_float_dtype(column) and (column.dropna() % 1 == 0).all():
            column = column.astype("Int64")
        elif pd.api.types.is_integer_dtype(column):
            column = column.astype("Int64")
        if pd.api.types.is_datetime64_any_dtype(column):
            column = column.astype("datetime64[us]")
        normal[name] = column.astype(object).where(column.notna(), None).map(lambda v: None if v is None else str(v))
    return sorted(map(tuple, normal.itertuples(index=False)), key=lambda row: tuple("" if v is None else v for v in row))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        if Path(f"{sf_dir}/{table}.parquet").exists():
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def compare(spark: SparkSession, connection, sf_dir: str, name: str) -> tuple[bool, str]:
    start = time.time()
    ours = QUERIES[name](spark, sf_dir).toPandas()
    took = time.time() - start
    if name not in ORACLES:
        return True, f"{len(ours)} rows, {took:.1f}s, no SQL"
    theirs = connection.execute(ORACLES[name]).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return False, f"columns {sorted(ours.columns)} against {sorted(theirs.columns)}"
    mine, other = canonical(ours), canonical(theirs)
    if mine == other:
        return True, f"{len(mine)} rows, {took:.1f}s"
    difference = [(a, b) for a, b in zip(mine, other) if a != b][:3]
    return False, f"{len(mine)} rows against {len(other)}: {difference}"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failed = 0
    for name in names:
        try:
            good, text = compare(spark, connection, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            good, text = False, f"{type(error).__name__}: {str(error)[:600]}"
        failed += not good
        print("ok  " if good else "FAIL", name, text, flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
