"""Bursts on a stream, complete whatever the order and the batches in which events arrive.

Repeats of one key (category, verbosity, message, continuation, per source)
within ``gap`` of each other are a session. Unlike the bursts of a batch, other
events in between do not end it.

Every micro-batch is reduced to its own sessions, and these fragments are
written down under its number: that folder is the state. Fragments of different
batches merge into sessions when they are read, so an event that arrives late
extends, or joins, the sessions it belongs to instead of getting lost, and a
batch costs what it holds, not what the state holds. A batch that runs again
writes its own folder again. ``compact`` folds fragments into fewer.

The watermark is the latest time seen by earlier batches minus ``delay``. It
decides nothing but two things: events behind it are counted as late, and a
session is closed once it lies more than ``gap`` behind it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.operators.dedupe import BURST_WINDOW, CONTINUATION_JOINT
from logloom.operators.sessions import FIRST, FRAGMENT, KEY, LAST, SIZE, merge_sessions
from logloom.sources.scratch import settle

LABELS = ["source_id", "category", "verbosity", "message", "continuation"]
SCHEMAS = {
    "fragments": f"{KEY} binary, {FIRST} timestamp_ntz, {LAST} timestamp_ntz, {SIZE} bigint",
    "labels": f"{KEY} binary, " + ", ".join(f"{name} string" for name in LABELS),
    "progress": "events bigint, untimed bigint, late bigint, latest timestamp_ntz",
}


def _key() -> Column:
    """Digest of the labels; a length in front of each, so that no two keys share a text."""
    parts = []
    for name in LABELS:
        parts += [F.coalesce(F.length(name).cast("string"), F.lit("-")), F.coalesce(F.col(name), F.lit(""))]
    return F.unhex(F.sha2(F.concat_ws(CONTINUATION_JOINT, *parts).cast("binary"), 256))


@dataclass(frozen=True)
class BurstState:
    """The state of one stream, a folder every executor can reach."""

    path: str
    gap: timedelta = BURST_WINDOW
    delay: timedelta = timedelta(hours=1)

    def start(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take in what is available and stop; restarts go on from the checkpoint."""
        return (
            events.writeStream.foreachBatch(self.take_in)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def take_in(self, batch: DataFrame, number: int) -> None:
        """Write the fragments, the labels and the counts of one micro-batch; running it again changes nothing."""
        labelled = batch.withColumn("continuation", F.concat_ws(CONTINUATION_JOINT, "continuation_lines"))
        # One look at the batch: a row per key and instant. All else follows from these. The digest is the key's
        # name in the state; labels are grouped by themselves, as texts under min() would have to be sorted.
        counted = labelled.groupBy(*LABELS, F.col("timestamp").alias(FIRST)).agg(F.count(F.lit(1)).alias(SIZE))
        instants = counted.select(_key().alias(KEY), FIRST, F.col(FIRST).alias(LAST), SIZE, *LABELS)
        instants = settle(instants, "instants")
        timed = instants.where(F.col(FIRST).isNotNull())
        fragments = merge_sessions(timed.select(*FRAGMENT), self.gap)
        labels = timed.select(KEY, *LABELS).distinct()
        late = _before(F.col(FIRST), self.watermark(batch.sparkSession, number))
        progress = instants.agg(
            F.coalesce(F.sum(SIZE), F.lit(0)).alias("events"),
            F.coalesce(F.sum(F.when(F.col(FIRST).isNull(), F.col(SIZE))), F.lit(0)).alias("untimed"),
            F.coalesce(F.sum(F.when(late, F.col(SIZE))), F.lit(0)).alias("late"),
            F.max(FIRST).alias("latest"),
        )
        # Progress comes last: a batch counts once it is whole.
        for name, table in (("fragments", fragments), ("labels", labels), ("progress", progress)):
            table.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")

    def progress(self, spark: SparkSession) -> DataFrame:
        """Per batch: events, those without a time (in no session), late ones (in sessions all the same), latest time."""
        schema = f"{SCHEMAS['progress']}, batch bigint"
        if not _Folder(spark, f"{self.path}/progress").there:
            return spark.createDataFrame([], schema).select("batch", "events", "untimed", "late", "latest")
        seen = spark.read.schema(schema).parquet(f"{self.path}/progress")
        return seen.select("batch", "events", "untimed", "late", "latest")

    def watermark(self, spark: SparkSession, before: int | None = None) -> datetime | None:
        """The latest time that all batches, or those before a number, have seen, minus ``delay``."""
        if before == 0:
            return None
        seen = self.progress(spark)
        seen = seen if before is None else seen.where(F.col("batch") < before)
        latest = seen.agg(F.max("latest")).first()[0]
        return None if latest is None else latest - self.delay

    def sessions(self, spark: SparkSession) -> DataFrame:
        """Every session of the batches taken in so far, with its labels and ``closed``."""
        merged = merge_sessions(self._state(spark, "fragments"), self.gap)
        labels = self._labels(spark)
        closed = _before(F.col(LAST) + F.lit(self.gap), self.watermark(spark))
        return merged.join(labels, KEY).select(*LABELS, FIRST, LAST, SIZE, closed.alias("closed"))

    def compact(self, spark: SparkSession) -> None:
        """Fold what all batches so far have written into one table, and delete what it replaces.

        The table counts from the moment its last file stands; the stream may go
        on meanwhile. What was read before must not be used afterwards.
        """
        last = self.progress(spark).agg(F.max("batch")).first()[0]
        if last is None or last == self._folded(spark):
            return
        self._labels(spark).write.mode("overwrite").parquet(f"{self.path}/folded/labels/upto={last}")
        fragments = merge_sessions(self._state(spark, "fragments"), self.gap)
        fragments.write.mode("overwrite").parquet(f"{self.path}/folded/fragments/upto={last}")
        for name in ("fragments", "labels"):
            for folder, mark in ((f"{self.path}/{name}", "batch="), (f"{self.path}/folded/{name}", "upto=")):
                below = last if mark == "upto=" else last + 1
                _Folder(spark, folder).delete(lambda child: child.startswith(mark) and int(child[len(mark) :]) < below)

    def _labels(self, spark: SparkSession) -> DataFrame:
        """The labels of every key once. Dealt out by key, as the join with them needs it anyway."""
        return self._state(spark, "labels").repartition(KEY).distinct()

    def _folded(self, spark: SparkSession) -> int | None:
        """The last batch that a finished folding holds."""
        root = f"{self.path}/folded/fragments"
        marks = [int(child[len("upto=") :]) for child in _Folder(spark, root).children()]
        return max((m for m in marks if _Folder(spark, f"{root}/upto={m}/_SUCCESS").there), default=None)

    def _state(self, spark: SparkSession, name: str) -> DataFrame:
        """The folded table and the batches after it that are whole."""
        schema, folded = SCHEMAS[name], self._folded(spark)
        last = self.progress(spark).agg(F.max("batch")).first()[0]
        if last is None:
            return spark.createDataFrame([], schema)
        tables = []
        if folded is not None:
            tables.append(spark.read.schema(schema).parquet(f"{self.path}/folded/{name}/upto={folded}"))
        if _Folder(spark, f"{self.path}/{name}").there:
            newer = spark.read.schema(f"{schema}, batch bigint").parquet(f"{self.path}/{name}")
            newer = newer.where((F.col("batch") <= last) & (F.col("batch") > (-1 if folded is None else folded)))
            tables.append(newer.drop("batch"))
        return reduce(DataFrame.union, tables) if tables else spark.createDataFrame([], schema)


def _before(time: Column, watermark: datetime | None) -> Column:
    if watermark is None:
        return F.lit(False)
    return F.coalesce(time < F.lit(watermark.isoformat(" ")).cast("timestamp_ntz"), F.lit(False))


class _Folder:
    """A folder of the store that holds the state."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._store = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    @property
    def there(self) -> bool:
        return self._store.exists(self._path)

    def children(self) -> list[str]:
        return [f.getPath().getName() for f in self._store.listStatus(self._path)] if self.there else []

    def delete(self, which: Callable[[str], bool]) -> None:
        if self.there:
            for found in self._store.listStatus(self._path):
                if which(found.getPath().getName()):
                    self._store.delete(found.getPath(), True)
