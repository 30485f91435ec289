"""Target-distribution importance resampling, drawn by a parallel sort with regular sampling.

Features are runs of words, hashed into buckets. A bucket's gain compares how
often it occurs in the target (``benchmark``) and in the corpus; a document's
weight is the mean gain of its features. The gains are one array, read by every
task; a document adds a Gumbel draw of its id to its weight, and the documents
with the largest sums are the sample (without replacement, in proportion to
the weights).

The ranks come from a parallel sort by regular sampling:

1. Every partition sorts its scored documents, a run, and marks documents at
   regular places of it. Runs are written down.
2. The marks of all runs, sorted, give splitters at regular places, so every
   segment between two splitters holds a bounded number of documents.
3. Counts per segment, added up from the front, say how many documents stand
   before each segment, and which segments the sample ends in or goes beyond.
4. Segments that hold part of the sample are exchanged and merged; a document's
   rank is its place in its segment plus the documents before the segment.

The order is score (descending), id, run, place in the run. The last two make
it total, so rows that repeat an id are spread over segments like any others.

Defined results: null and empty texts have no features and weight 0. A null id
is drawn for as empty text and stands behind all ids of its score. Repeated
rows each take a rank of their own. Texts without enough words have no rank. An
empty target gives gains by the corpus alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import LOWER, annotate, field, slices
from logloom.sources.scratch import settle

# Bytes that stand between words: ASCII but for digits and letters.
GAPS = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in LOWER)
HASHED = 1 << 18  # features whose buckets a task remembers
RUN_ROW = "doc_id long, n_features long, weight long, score long, taking boolean, run int, place long, mark int"


@dataclass(frozen=True)
class Sampling:
    width: int = 1  # features are runs of 1 to this many words
    buckets: int = 10_000
    least_words: int = 20
    per_cent: int = 10
    seed: int = 2024
    scale: int = 1000
    segment_rows: int = 500_000
    marks_per_run: int = 64  # a power of two
    # Marks that the driver chooses splitters from, 40 bytes each; at least one of every run.
    marks: int = 200_000


class Buckets(dict):
    """Bucket of each feature, computed once while it is remembered."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= HASHED:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def features(text: str | None, width: int, known: Buckets) -> tuple[np.ndarray, int]:
    """The bucket of each feature of a text, and its number of words."""
    words = (text or "").encode("utf-8", "replace").translate(GAPS).split()
    found = list(map(known.__getitem__, words))
    for size in range(2, width + 1):
        found += [known[b" ".join(words[i : i + size])] for i in range(len(words) - size + 1)]
    return np.array(found, np.int64), len(words)


def bucket_counts(texts: DataFrame, sampling: Sampling, text: str) -> np.ndarray:
    """Features in each bucket over all texts, as an array of ``sampling.buckets`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(sampling.buckets), np.zeros(sampling.buckets, np.int64)
        for batch in batches:
            for piece in slices(batch, 0):
                for value in piece.column(0):
                    found, _ = features(value.as_py(), sampling.width, known)
                    total += np.bincount(found, minlength=sampling.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = texts.select(F.col(text)).mapInArrow(run, "bucket long, n long")
    out = np.zeros(sampling.buckets, np.int64)
    for bucket, n in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray, sampling: Sampling) -> np.ndarray:
    s, t, n = corpus.astype(float), target.astype(float), sampling.buckets
    return np.floor(sampling.scale * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def draw(doc_id: Column, sampling: Sampling) -> Column:
    """A Gumbel-distributed number of the id, scaled and floored."""
    text = F.concat(F.lit(f"{sampling.seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(sampling.scale)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scored(docs: DataFrame, gain: np.ndarray, sampling: Sampling, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_features, weight, score, and whether the document takes part."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def start():
        known, table = Buckets(sampling.buckets), shared.value

        def work(texts: list[str | None]) -> tuple[list, list, list]:
            sizes, words, weights = [], [], []
            for value in texts:
                found, n = features(value, sampling.width, known)
                sizes.append(len(found))
                words.append(n)
                weights.append(int(table[found].sum()) // len(found) if len(found) else 0)
            return sizes, words, weights

        return work

    fields = [field("n_features", "long"), field("n_words", "long"), field("weight", "long")]
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = annotate(source, start, fields, "text")
    return found.select(
        "doc_id",
        "n_features",
        "weight",
        (F.col("weight") + draw(F.col("doc_id"), sampling)).alias("score"),
        (F.col("n_words") >= sampling.least_words).alias("taking"),
    )


def sorted_runs(rows: DataFrame, sampling: Sampling) -> DataFrame:
    """Each partition in order, with ``run``, ``place``, and at regular places the number of a mark, else -1.

    What takes no part comes last and has no mark.
    """
    order = [F.desc("taking"), F.desc("score"), F.asc_nulls_last("doc_id")]
    ready = rows.sortWithinPartitions(*order).withColumn("run", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A run is narrow: the documents of one partition in some 40 bytes each.
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        n, mark = int(np.count_nonzero(table.column("taking"))), np.full(table.num_rows, -1, np.int32)
        if n:
            numbers = np.arange(sampling.marks_per_run)
            mark[(2 * numbers + 1) * n // (2 * sampling.marks_per_run)] = numbers
        table = table.append_column("place", pa.array(np.arange(table.num_rows)))
        yield from table.append_column("mark", pa.array(mark)).to_batches(max_chunksize=1 << 16)

    return ready.mapInArrow(run, RUN_ROW)


KEY = np.dtype([("score", ">u8"), ("id", ">u8"), ("run", ">u4"), ("place", ">u8")])
SIGN = np.uint64(1 << 63)


def sort_keys(score: pa.Array, doc_id: pa.Array, run: pa.Array, place: pa.Array) -> np.ndarray:
    """Keys whose order as bytes is the order of the ranks."""
    keys = np.empty(len(score), KEY)
    keys["score"] = ~(score.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ SIGN)
    ids = doc_id.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).astype(np.int64)
    keys["id"] = ids.view(np.uint64) ^ SIGN
    keys["run"] = run.to_numpy(zero_copy_only=False)
    keys["place"] = place.to_numpy(zero_copy_only=False)
    return keys.view(f"S{KEY.itemsize}").ravel()


def splitters(runs: DataFrame, segments: int, sampling: Sampling) -> np.ndarray:
    """Keys at regular places among the marks of all runs.

    Of too many marks every second, fourth, ... of a run is taken, beginning at
    a place that differs from run to run, so that together they stay regular.
    """
    marks, apart = runs.where("mark >= 0"), 1
    found = marks.count()
    while apart < sampling.marks_per_run and found > apart * sampling.marks:
        apart *= 2
    taken = marks.where(F.pmod(F.col("mark") + 39 * F.col("run").cast("long"), F.lit(apart)) == 0)
    rows = taken.select("score", "doc_id", "run", "place").toArrow()
    keys = np.sort(sort_keys(*(c.combine_chunks() for c in rows.columns)))
    return keys[np.arange(1, segments) * len(keys) // segments] if len(keys) else keys


def in_segments(runs: DataFrame, cuts: np.ndarray) -> DataFrame:
    """``runs`` with ``segment``; 0 holds the highest scores, and null stands for what takes no part."""
    shared = runs.sparkSession.sparkContext.broadcast(cuts)
    names = [*(x.split()[0] for x in RUN_ROW.split(", ")), "segment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = sort_keys(*(batch.column(c) for c in ("score", "doc_id", "run", "place")))
            segment = np.searchsorted(shared.value, keys, "right").astype(np.int32)
            out = pa.array(segment, mask=~batch.column("taking").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=names)

    return runs.mapInArrow(run, f"{RUN_ROW}, segment int")


def resample(
    docs: DataFrame,
    target: DataFrame,
    sampling: Sampling = Sampling(),
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank (null if not drawn)."""
    gain = gains(bucket_counts(docs, sampling, text), bucket_counts(target, sampling, target_text), sampling)
    runs = settle(sorted_runs(scored(docs, gain, sampling, doc_id, text), sampling), "runs")
    total = runs.where("taking").count()
    segments = max(1, -(-total // sampling.segment_rows))
    dealt = in_segments(runs, splitters(runs, segments, sampling))

    sizes = dict(dealt.where("segment is not null").groupBy("segment").count().collect())
    before = np.concatenate(([0], np.cumsum([sizes.get(k, 0) for k in range(segments)]))).tolist()
    wanted = total * sampling.per_cent // 100
    # The last segment that holds a rank; a row for each of the others, 500,000 documents apart.
    last = max(0, int(np.searchsorted(before, wanted)) - 1)
    starts = docs.sparkSession.createDataFrame(list(enumerate(before[: last + 1])), "segment int, before long")

    result = ["doc_id", "n_features", "weight", "score"]
    order = Window.partitionBy("segment").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "run", "place")
    merged = dealt.where(F.col("segment") <= last).withColumn("rank", F.row_number().over(order))
    rank = (F.col("before") + F.col("rank")).cast("long")
    drawn = merged.join(F.broadcast(starts), "segment").select(*result, F.when(rank <= wanted, rank).alias("rank"))
    others = dealt.where(F.col("segment").isNull() | (F.col("segment") > last))
    return drawn.union(others.select(*result, F.lit(None).cast("long").alias("rank")))
