"""Near-duplicates by an LSH forest over MinHash signatures.

A document is the set of its word shingles. Equal sets form a class, and only
one document of a class, its smallest id, goes on. Its MinHash signature is
read in several orders (the trees). Each tree is sorted, so documents with a
long common prefix are neighbours. A region starts as the documents that share
the first ``depth`` values; where it is crowded it is read deeper, until few
enough share the prefix. All pairs of a region that is not crowded are
candidates, at whatever depth that is; where it stays crowded, the next
neighbours in order are.

A tree's rows carry a sketch, four bits of every value of the signature. Only
candidates whose sizes allow the similarity and whose sketches agree in
``alike`` places are confirmed, on their full sets; at similarity 0.80 fewer
than 30 of 64 places agree with probability 9e-10. So the many documents that
share a frequent shingle meet in their sketches alone, and texts move only for
pairs that are nearly always links.

Crowded regions are not cut short. Candidates whose sketches agree in ``agree``
places are near, and what near pairs connect is a group, a family of similar
documents. In each group that links do not connect yet, all pairs from different
components are compared once more, exactly, on the full sets. So a pair inside a
group needs no candidate of its own: of a family of thousands, a partition
reports little more than the edges that hold it together. Documents that are
linked already need no further look at each other, so a large group of copies
costs about as much as its members that are not linked yet. No pairs are emitted
there, only links. Groups do not grow with the corpus around them.

Nothing gathers a group: trees are cut by range, so a prefix that a third of
all documents share is many partitions; sets to compare are dealt in portions
of bounded size; components come from star contraction by joins. Texts are
always joined by shuffle, as the needed ones have no bound.

What it can miss: a link between texts of which no tree shares as many values as
their regions need to thin out. The trees read the same 64 hashes, so they are
not independent. Simulated with the default orders, a million pairs for each
figure: at similarity 0.80 none is missed at depth 2 and 3 and 15 at depth 4; at
0.82 none and 5, at 0.85 none and 1. Unrelated texts that share one value in 25
need depth 3 up to about 3 million documents; for more, raise ``trees``.
Regions that a partition border of a tree cuts are put together again from what
both sides report about their first and last documents.

Defined results: texts without words have an empty set, no links, and stay. A
null id is linked with nothing and stays. Rows that repeat an id and its text
each get the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import annotate, field, pair_hashes, word_numbers
from logloom.sources.scratch import settle

SIGNED = [field("n_shingles", "long"), field("set_key", "binary"), field("signature", "binary")]
TREE_ROW = "tree int, prefix binary, rep long, n long, sketch binary"
# ``near`` is 1 if the pair joins groups, else 0.
PAIR = "a long, b long, n_a long, n_b long, near int"
# A row of a region at a partition's border has no b; its region may go on in the next partition.
FOUND = "a long, b long, n_a long, n_b long, tree int, prefix binary, sketch binary"
# How many of two places agree, by the exclusive or of their byte.
AGREEING = np.array([(x & 15 == 0) + (x >> 4 == 0) for x in range(256)], np.uint8)
PAIRS_AT_ONCE = 1 << 18


@dataclass(frozen=True)
class Forest:
    shingle: int = 5
    similarity: int = 80  # per cent
    hashes: int = 64
    trees: int = 32
    length: int = 12  # values of a tree's order
    depth: int = 2
    crowd: int = 48  # a region with more documents is crowded
    neighbours: int = 4
    alike: int = 30  # places of the sketch that agree, for a candidate pair to be confirmed
    agree: int = 42  # places that agree, for a pair to join groups; at similarity 0.80 fewer do in 1 pair of 500
    partition_rows: int = 200_000
    portion: int = 2_000_000  # shingles of the documents confirmed together
    seed: int = 20


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles; a shorter text is one shingle."""
    numbers, sizes, hashes = word_numbers(texts)
    words = hashes[numbers]
    rolled = words.copy()
    for k in range(1, width):
        rolled[:-k] = pair_hashes(rolled[:-k], words[k:])
    out, at = [], 0
    for size in sizes.tolist():
        n = size - 1
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            # Not a prefix of any full shingle's hash: the number of words comes first.
            whole = np.array([n], np.uint64)
            for k in range(at, at + n):
                whole = pair_hashes(whole, words[k : k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def hash_factors(forest: Forest) -> np.ndarray:
    return np.random.default_rng(forest.seed).integers(1, 1 << 63, forest.hashes, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of each hash over the set."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        part = found[at : at + 1024] ^ (found[at : at + 1024] >> np.uint64(31))
        least = np.minimum(least, (factors[:, None] * part[None, :]).min(1))
    return (least >> np.uint64(32)).astype(np.uint32)


def signed(docs: DataFrame, forest: Forest, text: str) -> DataFrame:
    factors = hash_factors(forest)

    def work(texts: list[str | None]) -> tuple:
        sets = shingle_sets(texts, forest.shingle)
        return (
            [len(s) for s in sets],
            [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
            [signature(s, factors).tobytes() if len(s) else None for s in sets],
        )

    return annotate(docs, lambda: work, SIGNED, text)


def orders(forest: Forest) -> np.ndarray:
    """The signature places that each tree reads."""
    rng = np.random.default_rng(forest.seed + 1)
    return np.stack([rng.permutation(forest.hashes)[: forest.length] for _ in range(forest.trees)])


def planted(classes: DataFrame, forest: Forest, partitions: int) -> DataFrame:
    """All trees, sorted and cut by range. ``classes``: rep, n, signature."""
    places = orders(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.stack([np.frombuffer(x, np.uint32) for x in batch.column("signature").to_pylist()])
            # Big-endian, so that the order of bytes is the order of values.
            low = (sig & 0xFFFF).astype(">u2")
            few = (sig & 15).astype(np.uint8)
            sketch = pa.array(list(map(bytes, few[:, 0::2] | few[:, 1::2] << 4)), pa.binary())
            for tree, place in enumerate(places):
                rows = np.ascontiguousarray(low[:, place]).tobytes()
                width = 2 * forest.length
                prefix = [rows[at : at + width] for at in range(0, len(rows), width)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(prefix), tree, np.int32)),
                        pa.array(prefix, pa.binary()),
                        batch.column("rep"),
                        batch.column("n"),
                        sketch,
                    ],
                    names=["tree", "prefix", "rep", "n", "sketch"],
                )

    rows = classes.select("rep", "n", "signature").mapInArrow(run, TREE_ROW)
    return rows.repartitionByRange(partitions, "tree", "prefix", "rep").sortWithinPartitions("tree", "prefix", "rep")


def regions(tree: np.ndarray, values: np.ndarray, depth: int) -> np.ndarray:
    """Number of each row's region: rows of a tree that share the first values."""
    new = np.ones(len(tree), bool)
    new[1:] = (tree[1:] != tree[:-1]) | (values[1:, :depth] != values[:-1, :depth]).any(1)
    return np.cumsum(new) - 1


@dataclass
class Rows:
    """Rows of trees in order."""

    tree: np.ndarray
    values: np.ndarray
    rep: np.ndarray
    n: np.ndarray
    sketch: np.ndarray

    @classmethod
    def of(cls, tree, prefix: list[bytes], rep, n, sketch: list[bytes], forest: Forest) -> Rows:
        values = np.frombuffer(b"".join(prefix), ">u2").reshape(-1, forest.length).astype(np.uint16)
        return cls(tree, values, rep, n, np.frombuffer(b"".join(sketch), np.uint8).reshape(len(values), -1))


def fitting(rows: Rows, i: np.ndarray, j: np.ndarray, forest: Forest) -> tuple:
    """The pairs of rows that may be links by size and sketch, and which of them are near."""
    close = 100 * np.minimum(rows.n[i], rows.n[j]) >= forest.similarity * np.maximum(rows.n[i], rows.n[j])
    i, j = i[close], j[close]
    agreeing = np.zeros(len(i), np.int32)
    for at in range(0, len(i), PAIRS_AT_ONCE):
        part = slice(at, at + PAIRS_AT_ONCE)
        agreeing[part] = AGREEING[rows.sketch[i[part]] ^ rows.sketch[j[part]]].sum(1, dtype=np.int32)
    keep = agreeing >= forest.alike
    return i[keep], j[keep], agreeing[keep] >= forest.agree


def joined(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels of components after the edges (i, j): the smallest row of each."""
    while (labels[i] != labels[j]).any():
        low, high = np.minimum(labels[i], labels[j]), np.maximum(labels[i], labels[j])
        np.minimum.at(labels, high, low)
        while (labels[labels] != labels).any():
            labels = labels[labels]
    return labels


def neighbour_pairs(rows: Rows, forest: Forest) -> Iterator[tuple]:
    """Pairs of rows, and which join groups.

    All pairs of regions read as deep as they are crowded, and the next in order
    of those that stay crowded; but for pairs that near ones have connected.
    """
    tree, values, count = rows.tree, rows.values, len(rows.tree)
    wanted = np.full(count, forest.length + 1)  # the depth at which a row's region is not crowded
    for depth in range(forest.length, forest.depth - 1, -1):
        region = regions(tree, values, depth)
        small = np.bincount(region)[region] <= forest.crowd
        wanted[small] = depth
    common = np.zeros(max(0, count - 1), np.int64)
    same = tree[1:] == tree[:-1]
    for k in range(forest.length):
        same = same & (values[1:, k] == values[:-1, k])
        common += same
    shared = common.copy()  # the common prefix of rows i and i + apart
    labels = np.arange(count)
    for apart in range(1, forest.crowd):
        if apart > 1:
            if len(shared) < 2:
                return
            shared = np.minimum(shared[:-1], common[apart - 1 :])
        if not (shared >= forest.depth).any():
            return
        take = shared >= np.maximum(wanted[: len(shared)], wanted[apart:][: len(shared)])
        if apart <= forest.neighbours:
            take |= (shared >= forest.depth) & (wanted[: len(shared)] > forest.depth)
        i = np.flatnonzero(take)
        i = i[labels[i] != labels[i + apart]]
        i, j, near = fitting(rows, i, i + apart, forest)
        if len(i):
            yield i, j, near
            labels = joined(labels, i[near], j[near])


def at_borders(tree: np.ndarray, values: np.ndarray, forest: Forest) -> np.ndarray:
    """The rows of the first and the last region of a partition that a document across the border may meet."""
    region = regions(tree, values, forest.depth)
    first, last = np.flatnonzero(region == 0), np.flatnonzero(region == region[-1])
    kept = (first[: forest.crowd], first[-forest.crowd :], last[: forest.crowd], last[-forest.crowd :])
    return np.unique(np.concatenate(kept))


def border_pairs(border: DataFrame, forest: Forest) -> DataFrame:
    """Candidate pairs of the regions that partition borders cut. ``border``: rows of ``candidates`` without b.

    Each partition reports as many rows at either end as an uncrowded region
    may have. They are read like any others: all pairs where few share a prefix,
    the next in order where many do.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["prefix", "a"])
        tree, rep, n = (pdf[c].to_numpy() for c in ("tree", "a", "n_a"))
        rows = Rows.of(tree, list(pdf["prefix"]), rep, n, list(pdf["sketch"]), forest)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)), *neighbour_pairs(rows, forest)]
        i, j, near = (np.concatenate(x) for x in zip(*found, strict=True))
        turn = rep[i] > rep[j]
        i, j = np.where(turn, j, i), np.where(turn, i, j)
        return pd.DataFrame({"a": rep[i], "b": rep[j], "n_a": n[i], "n_b": n[j], "near": near.astype(np.int32)})

    region = F.substring("prefix", 1, 2 * forest.depth)
    return border.withColumn("region", region).groupBy("tree", "region").applyInPandas(run, PAIR)


def candidates(trees: DataFrame, forest: Forest) -> DataFrame:
    """Distinct candidate pairs, the smaller id first, and the rows at partition borders."""
    names = ["a", "b", "n_a", "n_b", "tree", "prefix", "sketch", "near"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        tree, rep, n = (table.column(c).to_numpy() for c in ("tree", "rep", "n"))
        prefix, sketch = table.column("prefix"), table.column("sketch")
        rows = Rows.of(tree, prefix.to_pylist(), rep, n, sketch.to_pylist(), forest)
        at = at_borders(tree, rows.values, forest)
        none, unset = pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int32())
        own = [x.take(at).combine_chunks() for x in (prefix, sketch)]
        columns = [rep[at], none, n[at], none, tree[at], *own, unset]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)
        for i, j, near in neighbour_pairs(rows, forest):
            turn = rep[i] > rep[j]
            i, j = np.where(turn, j, i), np.where(turn, i, j)
            if len(i):
                pairs = [pa.array(x) for x in (rep[i], rep[j], n[i], n[j])]
                none = [pa.nulls(len(i), pa.int32()), *[pa.nulls(len(i), pa.binary())] * 2]
                yield pa.RecordBatch.from_arrays([*pairs, *none, pa.array(near.astype(np.int32))], names=names)

    found = trees.mapInArrow(run, f"{FOUND}, near int").groupBy("a", "b", "tree", "prefix", "sketch")
    return found.agg(*[F.max(c).alias(c) for c in ("n_a", "n_b", "near")])


def confirmed(pairs: DataFrame, docs: DataFrame, forest: Forest) -> DataFrame:
    """Links (a, b) that join all texts that confirmed pairs connect. ``docs``: rep, text."""
    both = pairs.select(F.col("a").alias("v"), F.col("b").alias("w")).union(pairs.select("b", "a"))
    near = both.groupBy("v").agg(F.min(F.least("v", "w")).alias("near"))
    # Pairs around one text go together, so that its text travels once for most of them.
    grouped = (
        pairs.join(near.select(F.col("v").alias("a"), F.col("near").alias("near_a")), "a")
        .join(near.select(F.col("v").alias("b"), F.col("near").alias("near_b")), "b")
        .withColumn("home", F.least("near_a", "near_b"))
        .drop("near_a", "near_b")
    )
    portions = grouped.groupBy("home").agg(F.ceil(F.sum(F.col("n_a") + F.col("n_b")) / forest.portion).alias("portions"))
    dealt = grouped.join(portions, "home").withColumn("portion", F.pmod(F.xxhash64("a"), F.col("portions")))
    dealt = settle(dealt.select("home", "portion", "a", "b"), "dealt")
    needed = (
        dealt.select("home", "portion", F.col("a").alias("rep")).union(dealt.select("home", "portion", "b")).distinct()
    )
    texts = docs.hint("merge").join(needed, "rep")
    texts = texts.select("home", "portion", F.col("rep").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = texts.unionByName(dealt.withColumn("text", F.lit(None).cast("string")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_pair = pdf["b"].notna()
        pairs, held = pdf[is_pair], pdf[~is_pair].drop_duplicates("a")
        sets = dict(zip(held["a"], shingle_sets(held["text"].tolist(), forest.shingle), strict=True))
        parent = {v: v for v in sets}

        def root(v: int) -> int:
            while parent[v] != v:
                parent[v] = v = parent[parent[v]]
            return v

        for a, b in zip(pairs["a"].astype("int64"), pairs["b"].astype("int64"), strict=True):
            x, y = root(a), root(b)
            if x != y:
                common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * common >= forest.similarity * (len(sets[a]) + len(sets[b]) - common):
                    parent[max(x, y)] = min(x, y)
        linked = [(root(v), v) for v in parent if root(v) != v]
        return pd.DataFrame(linked, columns=["a", "b"]).astype("int64")

    return rows.groupBy("home", "portion").applyInPandas(run, "a long, b long")


def members_linked(found: tuple[np.ndarray, np.ndarray, np.ndarray], sets: list[np.ndarray], least: int) -> Iterator[np.ndarray]:
    """For each of ``sets``, the places of the sets in ``found`` that are similar enough.

    ``found`` has the place and the hash of every member of the other sets, sorted by hash.
    """
    place, hashes, sizes = found
    for own in sets:
        low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
        runs = high - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(runs)[:-1])), runs) + np.arange(runs.sum())
        common = np.bincount(place[at], minlength=len(sizes))
        yield np.flatnonzero(100 * common >= least * (len(own) + sizes - common))


def linked_in_groups(members: DataFrame, docs: DataFrame, forest: Forest) -> DataFrame:
    """Links between components of one group. ``members``: rep, n, group, comp; ``docs``: rep, text."""
    parts = members.groupBy("group", "comp").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    totals = parts.groupBy("group").agg(
        F.sum("size").alias("all"), F.sum("n").alias("all_n"), F.max(F.struct("size", "comp", "n")).alias("most")
    )
    # The members outside the largest component meet all members, in tiles of bounded size.
    unsettled = totals.where(F.col("all") > F.col("most.size")).select(
        "group",
        F.col("most.comp").alias("main"),
        F.ceil((F.col("all_n") - F.col("most.n")) / forest.portion).cast("int").alias("rows"),
        F.ceil(F.col("all_n") / forest.portion).cast("int").alias("columns"),
    )
    dealt = members.join(unsettled, "group")

    def tile(own: str, other: str) -> list:
        mine = F.pmod(F.xxhash64("rep"), F.col(own)).cast("int").alias(own[:-1])
        return [mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[:-1])]

    kept = ["rep", "comp", "group"]
    outside = dealt.where("comp <> main").select(*kept, F.lit(True).alias("outside"), *tile("rows", "columns"))
    everyone = dealt.select(*kept, F.lit(False).alias("outside"), *tile("columns", "rows"))
    texts = docs.hint("merge").join(outside.unionByName(everyone), "rep")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, other = pdf[pdf["outside"]], pdf[~pdf["outside"]]
        sets = shingle_sets(other["text"].tolist(), forest.shingle)
        sizes = np.array([len(s) for s in sets], np.int64)
        joined = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(joined, kind="stable")
        found = np.repeat(np.arange(len(sets)), sizes)[order], joined[order], sizes
        comps, out = other["comp"].to_numpy(), set()
        mine = shingle_sets(own["text"].tolist(), forest.shingle)
        for a, at in zip(own["comp"], members_linked(found, mine, forest.similarity), strict=True):
            out.update((min(a, c), max(a, c)) for c in set(comps[at].tolist()) if c != a)
        return pd.DataFrame(sorted(out), columns=["a", "b"]).astype("int64")

    return texts.groupBy("group", "row", "column").applyInPandas(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(v, comp) for every linked id, the smallest id reachable; by star contraction."""
    edges, before = links.select("a", "b").where("a <> b"), None
    while True:
        # Large star: the larger neighbours of each id move to its smallest one.
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        # Small star: the smaller neighbours of each id, and itself, move to the smallest of them.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        edges = settle(small.where("a <> b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("b").alias("v"), F.col("a").alias("comp"))
        before = now


def near_duplicates(
    docs: DataFrame,
    forest: Forest = Forest(),
    doc_id: str = "doc_id",
    text: str = "text",
    text_hash: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``text_hash`` names a further column, the ``xxhash64`` of the text, for
    callers whose ids do not name one text each.
    """
    extra = [] if text_hash is None else [text_hash]
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    narrow = narrow.withColumns({name: F.xxhash64("text") for name in extra})
    table = settle(signed(narrow, forest, "text").drop("text"), "signed")
    with_set = table.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = with_set.groupBy("set_key").agg(
        F.min(F.struct("doc_id", F.col("n_shingles").alias("n"), "signature")).alias("one")
    )
    classes = settle(
        classes.select("set_key", F.col("one.doc_id").alias("rep"), F.col("one.n").alias("n"), "one.signature"), "classes"
    )
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    partitions = max(partitions, -(-classes.count() * forest.trees // forest.partition_rows))
    texts = narrow.select(F.col("doc_id").alias("rep"), "text")

    rows = settle(candidates(planted(classes, forest, partitions), forest), "candidates")
    across = settle(border_pairs(rows.where("b is null"), forest), "across")
    pairs = rows.where("b is not null").select(*across.columns).union(across)
    links = settle(confirmed(pairs, texts, forest), "links")
    found = components(links)
    groups = components(pairs.where("near = 1")).select("v", F.col("comp").alias("group"))
    members = with_component(classes.select("rep", "n"), found, F.col("rep"))
    # The first document of a group stands in no row of its own.
    grouped = members.join(groups, F.col("rep") == F.col("v"), "left").withColumn("group", F.coalesce("group", "rep"))
    grouped = grouped.select("rep", "n", "group", "comp")
    more = settle(linked_in_groups(settle(grouped, "members"), texts, forest), "more")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    final = with_component(classes, found, F.col("rep")).select(
        F.col("set_key").alias("k"), F.col("comp").alias("class_component")
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    return (
        table.join(final, F.col("set_key") == F.col("k"), "left")
        .withColumn("component_id", component)
        .select(
            "doc_id",
            "n_shingles",
            "component_id",
            F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
            *extra,
        )
    )


def with_component(classes: DataFrame, found: DataFrame, rep: Column) -> DataFrame:
    joined = classes.join(found, rep == F.col("v"), "left")
    return joined.withColumn("comp", F.coalesce("comp", rep)).drop("v")
