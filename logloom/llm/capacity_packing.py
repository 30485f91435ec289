"""Best-fit packing into bins of several permitted capacities.

Texts longer than the largest capacity are cut into pieces; every piece is
packed, nothing is dropped. Pieces are dealt at random (by hash) over shards of
about ``shard_pieces`` each, and each shard packs its pieces on its own:
largest first, into the open bin with the least room that still holds the
piece. If none does, a bin of the capacity with the least expected cost per
packed token is opened. Last, every bin is downsized to the least capacity that
holds its contents. A shard carries ids and lengths, no texts.

A bin of capacity c costs ``c + overhead + quadratic * c * c``: padding,
attention and start-up together.

Defined results: null and empty texts have one empty piece, packed like any
other; ties go to the smaller id, then the smaller piece. Repeated rows are
packed each by itself. An empty table has no bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "doc_id long, piece int, start long, length long, bin_id string, bin_capacity long, bin_offset long, bin_used long"
)


@dataclass(frozen=True)
class Capacities:
    sizes: tuple[int, ...] = (512, 1024, 2048, 4096, 8192)
    overhead: float = 16.0
    quadratic: float = 1e-5
    shard_pieces: int = 20_000

    def cost(self, size: int) -> float:
        return size + self.overhead + self.quadratic * size * size


def opening_sizes(lengths: np.ndarray, caps: Capacities) -> dict[int, int]:
    """The capacity to open for each length, given all lengths of the shard.

    A bin opened for a piece is filled up with smaller pieces, as far as there
    are any: the part of the room that they can fill is what all smaller pieces
    together hold, at most the room itself. The least cost per packed token wins,
    then the smaller capacity.
    """
    values, counts = np.unique(lengths, return_counts=True)
    below = np.concatenate(([0], np.cumsum(values * counts)))
    out = {}
    for k, length in enumerate(values.tolist()):
        options = [c for c in sorted(caps.sizes) if c >= length]
        # Half of the last gap stays empty: it is smaller than most pieces.
        filled = [length + min(c - length, int(below[k])) * (1 - min(1.0, float(values[0]) / c) / 2) for c in options]
        out[length] = min(zip(options, filled, strict=True), key=lambda x: (caps.cost(x[0]) / max(1.0, x[1]), x[0]))[0]
    return out


def pack(lengths: np.ndarray, caps: Capacities) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset, and the bin's capacity and contents for pieces in decreasing length."""
    opening = opening_sizes(lengths, caps)
    rooms: list[int] = []  # distinct rooms of open bins, sorted
    holders: dict[int, list[int]] = {}
    used: list[int] = []
    opened: list[int] = []
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        at = bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms[at]
            b = holders[room].pop()
            if not holders[room]:
                del holders[room]
                rooms.pop(at)
        else:
            b = len(used)
            used.append(0)
            opened.append(opening[length])
            room = opened[b]
        bins[i], offsets[i] = b, used[b]
        used[b] += length
        left = room - length
        if left > 0:
            if left not in holders:
                holders[left] = []
                insort(rooms, left)
            holders[left].append(b)
    sizes = np.array(sorted(caps.sizes))
    contents = np.array(used, np.int64)
    fitting = sizes[np.searchsorted(sizes, contents)] if len(used) else contents
    return bins, offsets, fitting[bins], contents[bins]


def best_fit(docs: DataFrame, length: Column, caps: Capacities = Capacities(), doc_id: str = "doc_id") -> DataFrame:
    """One row per piece of every document; ``length`` counts a document's tokens."""
    largest = max(caps.sizes)
    pieces = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("total"))
        .withColumn(
            "piece", F.explode(F.sequence(F.lit(0), (F.greatest(F.col("total") - 1, F.lit(0)) / largest).cast("int")))
        )
        .withColumn("start", F.col("piece").cast("long") * largest)
        .withColumn("length", F.least(F.col("total") - F.col("start"), F.lit(largest)))
    )
    # One narrow pass to know how many shards keep their size the same for any input.
    sums = docs.select(F.ceil(F.greatest(F.coalesce(length, F.lit(0)), F.lit(1)) / largest).alias("n")).agg(F.sum("n"))
    shards = max(1, -(-int(sums.first()[0] or 0) // caps.shard_pieces))
    names = ["doc_id", "piece", "start", "length"]

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        bins, offsets, capacity, used = pack(pdf["length"].to_numpy(), caps)
        made = pdf[names].copy()
        made["bin_id"] = [f"{s}-{b}" for s, b in zip(pdf["shard"], bins, strict=True)]
        made["bin_capacity"], made["bin_offset"], made["bin_used"] = capacity, offsets, used
        return made

    # The partition is part of the hash, so that rows of one repeated id spread as well.
    mixed = F.xxhash64("doc_id", "piece", F.spark_partition_id())
    dealt = pieces.withColumn("shard", F.pmod(mixed, F.lit(shards)).cast("int"))
    return dealt.select("shard", *names).groupBy("shard").applyInPandas(shard, SCHEMA)


def bins(pieces: DataFrame) -> DataFrame:
    """One row per bin with its pieces in order; a bin holds at most its capacity."""
    return pieces.groupBy("bin_id", "bin_capacity", "bin_used").agg(
        F.array_sort(F.collect_list(F.struct("bin_offset", "doc_id", "piece", "start", "length"))).alias("pieces")
    )
