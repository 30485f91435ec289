"""Exact top-k inner products by norm-bucketed retrieval.

Components are turned into ``floor(256 * x)``; scores are integer inner
products. Candidates are sorted by length and cut into buckets of similar
length, so a bucket is a bounded block of vectors. The longest bucket gives
every query a first threshold: its k-th best score there. A bucket whose length
times the query's length stays below the threshold is left out for that query.
For the others the threshold divided by both lengths is the cosine that a
candidate needs. Where that local threshold is high, coordinate pruning pays:
a candidate with at least that cosine has each coordinate near the query's, so
the query's largest coordinates give ranges in the bucket's sorted coordinates
that a candidate must lie in. Where it is low, length pruning is used:
candidates of the bucket are in order of length, and those too short for the
threshold form its tail. What is left is verified by the exact product: pair by
pair where a range holds few candidates, else by one product of matrices.

Groups of query blocks meet groups of buckets, each pair of groups in a task of
its own that reads both where they lie; no block is copied through a shuffle
for it. A task goes through its buckets with the k best of its queries at hand,
which raise the thresholds as it goes, and yields at most k candidates a query,
which a second grouping merges. To the driver come counts and one bucket.

Defined results: vectors that are null, or hold a null or non-finite component,
take no part. Shorter vectors count as padded with zeros. A row is no candidate
for a query with the same id; ties go to the smaller id. Rows equal in id and
vector count once. Products use long arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.sources.scratch import settle

RESULT = "query_id long, rank int, vec_id long, score long"
FOUND = "query_id long, vec_id long, score long"
BLOCK = "block long, rows int, longest double, bytes int, ids binary, vectors binary"
ASKED = "q_block long, q_rows int, q_bytes int, q_ids binary, q_vectors binary, least binary, needs double"
# Sums of whole numbers below these are exact in float32 and float64.
EXACT_SINGLE, EXACT = 2.0**24, 2.0**53
SLACK = 1e-9
# Blocks of one task: groups of buckets and of query blocks.
BUCKET_GROUP, QUERY_GROUP = 64, 32
# Components that pairwise products hold at a time, and queries of a matrix of products.
PAIR_CELLS, TILE = 1 << 21, 256
NONE = (np.zeros(0, np.int64),) * 3


@dataclass(frozen=True)
class Search:
    k: int = 5
    bucket_rows: int = 2048
    query_rows: int = 1024
    scale: int = 256
    # Local cosine from which coordinate ranges are tried, and how many.
    coordinate_from: float = 0.4
    focus: int = 4


def whole(vectors: DataFrame, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """Ids, whole-number vectors and squared lengths of the rows that take part."""
    bad = F.exists(F.col(embedding), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return (
        vectors.where(F.col(embedding).isNotNull() & F.col(vec_id).isNotNull())
        .where(~bad)
        .select(
            F.col(vec_id).cast("long").alias("vec_id"),
            F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"),
        )
        .dropDuplicates(["vec_id", "v"])
        .withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))
    )


def matrix(rows: list, width: int | None = None) -> np.ndarray:
    width = max([width or 0, *map(len, rows)])
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def blocks(frame: DataFrame, size: int) -> DataFrame:
    """Vectors packed into blocks in decreasing length; lengths inside a block are close."""
    parts = frame.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = frame.repartitionByRange(int(parts), F.col("length").desc(), "vec_id").sortWithinPartitions(
        F.col("length").desc(), "vec_id"
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= size:
                rows = pd.concat(held, ignore_index=True)
                for at in range(0, len(rows) - size + 1, size):
                    yield packed(number, rows[at : at + size])
                    number += 1
                held = [rows[len(rows) // size * size :]]
        rows = pd.concat(held, ignore_index=True) if held else []
        if len(rows):
            yield packed(number, rows)

    def packed(number: int, rows: pd.DataFrame) -> pd.DataFrame:
        ids, vectors = rows["vec_id"].to_numpy(np.int64), narrowed(matrix(list(rows["v"])))
        return pd.DataFrame(
            {
                "block": [number],
                "rows": [len(ids)],
                "longest": [rows["length"].max()],
                "bytes": [vectors.itemsize],
                "ids": [ids.tobytes()],
                "vectors": [vectors.tobytes()],
            }
        )

    return dealt.select("vec_id", "v", "length").mapInPandas(pack, BLOCK)


def narrowed(vectors: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest type that holds them."""
    for kind in (np.int16, np.int32):
        if vectors.min(initial=0) >= np.iinfo(kind).min and vectors.max(initial=0) <= np.iinfo(kind).max:
            return vectors.astype(kind)
    return vectors


def unpack(rows: int, size: int, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, f"i{size}").reshape(rows, -1)


class Vectors:
    """Whole-number vectors of one block, with what a search derives from them."""

    def __init__(self, ids: np.ndarray, whole: np.ndarray):
        self.ids, self.whole = ids, whole
        self.real: dict[type, np.ndarray] = {}
        self.length = np.sqrt((self.of(np.float64) ** 2).sum(1))
        self.longest = float(self.length.max(initial=0))

    def of(self, kind: type) -> np.ndarray:
        if kind not in self.real:
            self.real = {kind: self.whole.astype(kind)}
        return self.real[kind]

    @cached_property
    def unit(self) -> np.ndarray:
        """Vectors of length one, a row a coordinate; a vector of no length stays zero."""
        return (self.whole / np.where(self.length > 0, self.length, 1.0)[:, None]).T.copy()

    @cached_property
    def order(self) -> np.ndarray:
        return np.argsort(self.unit, axis=1)

    @cached_property
    def ordered(self) -> np.ndarray:
        return np.take_along_axis(self.unit, self.order, 1)

    @cached_property
    def marks(self) -> np.ndarray:
        """Every so many'th of the ordered coordinates."""
        return self.ordered[:, :: self.few + 1].copy()

    @property
    def few(self) -> int:
        return len(self.ids) // 32

    def focus(self, number: int) -> np.ndarray:
        """A row a vector: its largest coordinates."""
        return np.argsort(-np.abs(self.unit), axis=0, kind="stable")[:number].T


def exact_kind(q: Vectors, c: Vectors) -> type:
    """No sum of some products of two vectors' components exceeds the product of their lengths."""
    most = q.longest * c.longest * (1 + SLACK)
    return np.float32 if most < EXACT_SINGLE else np.float64 if most < EXACT else np.int64


def products(q: Vectors, c: Vectors, rows: np.ndarray | slice = slice(None), head: int | None = None) -> np.ndarray:
    """Exact products of some queries with the first candidates."""
    kind, width = exact_kind(q, c), min(q.whole.shape[1], c.whole.shape[1])
    return q.of(kind)[rows, :width] @ c.of(kind)[:head, :width].T


def pair_products(q: Vectors, c: Vectors, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Exact products of single pairs."""
    kind, width = exact_kind(q, c), min(q.whole.shape[1], c.whole.shape[1])
    a, b, step = q.of(kind)[:, :width], c.of(kind)[:, :width], max(1, PAIR_CELLS // max(1, width))
    out = np.zeros(len(rows), np.int64)
    for at in range(0, len(rows), step):
        cut = slice(at, at + step)
        out[cut] = np.einsum("ij,ij->i", a[rows[cut]], b[cols[cut]])
    return out


def in_ranges(
    q: Vectors, c: Vectors, narrow: np.ndarray, need: np.ndarray, focus: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinate pruning: pairs within the ranges of the queries that have few of them, and the other queries."""
    focus = focus[narrow]
    inside = focus < c.whole.shape[1]  # coordinates that no candidate has are zero: nothing to look up
    t, x = np.minimum(need[narrow], 1.0)[:, None], q.unit[focus, narrow[:, None]]
    reach = np.sqrt(np.maximum(0.0, 1 - t * t) * np.maximum(0.0, 1 - x * x))
    # Bounds hold for cosines of at least t; they open up where x and t leave room for more.
    low = np.where(x > -t, t * x - reach, -1.0) - SLACK
    high = np.where(x < t, t * x + reach, 1.0) + SLACK
    start, stop = np.zeros(focus.shape, np.int64), np.full(focus.shape, len(c.ids))
    # A range that holds two marks holds more than a few candidates, so it is not looked up.
    marks = c.marks[np.where(inside, focus, 0)]
    held = ((marks >= low[..., None]) & (marks <= high[..., None])).sum(2)
    look = np.nonzero(inside & (held < 2))
    for f in np.unique(focus[look]):
        at = tuple(x[focus[look] == f] for x in look)
        start[at] = np.searchsorted(c.ordered[f], low[at], "left")
        stop[at] = np.searchsorted(c.ordered[f], high[at], "right")
    size = np.maximum(0, stop - start)
    best = size.argmin(1)[:, None]
    start, size, by = (np.take_along_axis(x, best, 1)[:, 0] for x in (start, size, focus))
    few = size <= c.few
    at, n = np.flatnonzero(few), size[few]
    place = np.repeat(at, n)
    within = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + start[place]
    cols = c.order[by[place], within] if len(place) else np.zeros(0, np.int64)
    for k in range(focus.shape[1]):
        ok = inside[place, k]
        found = c.unit[np.where(ok, focus[place, k], 0), cols]
        keep = ~ok | (found >= low[place, k]) & (found <= high[place, k])
        place, cols = place[keep], cols[keep]
    return narrow[place], cols, narrow[~few]


def search_bucket(
    q: Vectors, least: np.ndarray, focus: np.ndarray, c: Vectors, how: Search
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, candidates and scores of the pairs of other ids with a score of at least the query's ``least``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(np.isfinite(least), least / (q.length * c.longest), -np.inf)  # local cosine thresholds
        short = np.where(q.length > 0, least / q.length, -np.inf)
    zero = (q.length == 0) | (c.longest == 0)  # all products are 0
    need = np.where(zero, np.where(least > 0, np.inf, -np.inf), need)
    live = need <= 1 + SLACK
    # A score of at least a negative number says nothing of the cosine of a shorter candidate.
    high = (need >= how.coordinate_from) & (least > 0)
    whole, narrow = np.flatnonzero(live & ~high), np.flatnonzero(live & high)
    found = [NONE]
    if len(narrow):
        rows, cols, wide = in_ranges(q, c, narrow, need, focus)
        scores = pair_products(q, c, rows, cols)
        keep = scores >= least[rows]
        found.append((rows[keep], cols[keep], scores[keep]))
        whole = np.concatenate([whole, wide])
    if len(whole):
        # Length pruning: the bucket is in decreasing length, so what can reach the threshold is its head.
        head = np.searchsorted(-c.length, -(short[whole] - SLACK * (1 + np.abs(short[whole]))), side="right")
        whole = whole[head > 0]
        head = int(head.max(initial=0))
        for at in range(0, len(whole), TILE):
            part = whole[at : at + TILE]
            made = products(q, c, part, head)
            enough = least[part].astype(np.float32 if made.dtype == np.float32 else float)
            hits = np.flatnonzero(made >= enough[:, None])
            found.append((part[hits // max(1, head)], hits % max(1, head), made.ravel()[hits].astype(np.int64)))
    rows, cols, scores = (np.concatenate(x) for x in zip(*found, strict=True))
    other = c.ids[cols] != q.ids[rows]
    return rows[other], cols[other], scores[other]


@dataclass
class Best:
    """The k best candidates so far of a block of queries, and the thresholds that follow."""

    q: Vectors
    least: np.ndarray
    how: Search
    kept: tuple[np.ndarray, np.ndarray, np.ndarray] = NONE
    new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    @cached_property
    def focus(self) -> np.ndarray:
        return self.q.focus(self.how.focus)

    def search(self, c: Vectors) -> None:
        rows, cols, scores = search_bucket(self.q, self.least, self.focus, c, self.how)
        if len(rows):
            self.new.append((rows, c.ids[cols], scores))
            if sum(len(x[0]) for x in self.new) >= len(self.q.ids):
                self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Highest score first, then smallest id."""
        rows, ids, scores = (np.concatenate(x) for x in zip(self.kept, *self.new, strict=True))
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last = place == self.how.k - 1
        self.least[rows[last]] = np.maximum(self.least[rows[last]], scores[last])
        keep = place < self.how.k
        self.kept, self.new = (rows[keep], ids[keep], scores[keep]), []
        return self.kept


def joined(blocks: Iterable, size: int) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Ids and vectors of blocks, as many in one list as hold ``size`` rows at most."""
    held, count = [], 0
    for row in blocks:
        if held and count + row.rows > size:
            yield held
            held, count = [], 0
        held.append(unpack(row.rows, row.bytes, row.ids, row.vectors))
        count += row.rows
    if held:
        yield held


def top_k(
    vectors: DataFrame,
    is_query: Column,
    how: Search = Search(),
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """The k best candidates of every row where ``is_query`` (of ``vec_id``) holds, against all rows."""
    # Only the named columns, so a further column of the input cannot clash.
    vectors = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    ready = whole(vectors, how.scale, "vec_id", "embedding")
    buckets = settle(blocks(ready, how.bucket_rows), "buckets")
    asked = settle(blocks(ready.where(is_query), how.query_rows), "queries")

    # First thresholds: the longest bucket, one block of bounded size. It is found by its name, so that
    # partitions do not each send a block to the driver.
    many, named = buckets.agg(F.count(F.lit(1)), F.max(F.struct("longest", "block"))).first()
    seed = buckets.where(F.col("block") == named.block).first() if many else None
    shared = vectors.sparkSession.sparkContext.broadcast(seed and unpack(seed.rows, seed.bytes, seed.ids, seed.vectors))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, c = TaskContext.get().partitionId() << 32, None
        for rows in joined((row for batch in batches for row in batch.itertuples()), how.query_rows):
            c = c or Vectors(*shared.value)
            ids = np.concatenate([x for x, _ in rows])
            q = Vectors(ids, narrowed(matrix([v for _, x in rows for v in x])))
            scores = products(q, c).astype(float)
            scores[q.ids[:, None] == c.ids[None, :]] = -np.inf
            if scores.shape[1] >= how.k:
                least = np.partition(scores, -how.k, axis=1)[:, -how.k]
            else:
                least = np.full(len(ids), -np.inf)
            # The shortest candidate that any query of the block can use.
            with np.errstate(divide="ignore", invalid="ignore"):
                reach = np.where(q.length > 0, least / q.length, np.where(least > 0, np.inf, -np.inf))
            floor = reach.min(initial=np.inf)
            yield pd.DataFrame(
                {
                    "q_block": [number],
                    "q_rows": [len(ids)],
                    "q_bytes": [q.whole.itemsize],
                    "q_ids": [ids.tobytes()],
                    "q_vectors": [q.whole.tobytes()],
                    "least": [least.tobytes()],
                    "needs": [float(floor - SLACK * (1 + abs(floor))) if np.isfinite(floor) else float(floor)],
                }
            )
            number += 1

    # Shuffle partitions may hold few queries each: blocks are joined to full ones.
    rows = asked.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    full = -(-rows // how.query_rows)
    gathered = asked.coalesce(max(1, -(-full // 8))).sortWithinPartitions(F.col("longest").desc())
    known = settle(gathered.mapInPandas(first, ASKED), "asked")

    cores = vectors.sparkSession.sparkContext.defaultParallelism
    tall = min(max(1, many), max(3 * cores, -(-many // BUCKET_GROUP)))
    pairs = buckets.repartition(tall).join(
        known.repartition(max(1, -(-full // QUERY_GROUP))).hint("shuffle_replicate_nl"),
        F.col("longest") >= F.col("needs"),
    )

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, Best] = {}
        block = c = None
        for batch in batches:
            for row in batch.itertuples():
                if row.block != block:  # the queries' blocks pass by one bucket after the other
                    block, c = row.block, Vectors(*unpack(row.rows, row.bytes, row.ids, row.vectors))
                if row.q_block not in held:
                    q = Vectors(*unpack(row.q_rows, row.q_bytes, row.q_ids, row.q_vectors))
                    held[row.q_block] = Best(q, np.frombuffer(row.least, float).copy(), how)
                held[row.q_block].search(c)
        for best in held.values():
            places, ids, scores = best.merge()
            yield pd.DataFrame({"query_id": best.q.ids[places], "vec_id": ids, "score": scores})

    found = pairs.mapInPandas(second, FOUND)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return (
        found.withColumn("rank", place)
        .where(F.col("rank") <= how.k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
