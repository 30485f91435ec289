"""Language-model scores by deleted interpolation.

The probability of a token mixes maximum-likelihood estimates of the bigram,
the unigram and the uniform distribution. The weights depend on how often the
context was seen: contexts fall into frequency buckets (powers of two), and
each bucket's weights are learned by expectation-maximisation on n-grams of
held-out training documents that the estimates have not seen.

Counts grow with the corpus, so they are never gathered in one place. Texts are
cut into blocks (bounded bytes). A block lists its distinct words and bigrams
once, as sorted hashes packed by hash range. One grouping per range adds up the
counts of all blocks and sends each block the totals of its own entries, in its
own order. A frequent word is one entry a block, whatever its count. Blocks keep
their documents as sequences of word numbers, so texts are read once.

EM works on a histogram: cells of (context bucket, bigram estimate, unigram
estimate) in steps of a sixteenth of a power of two, with the held-out tokens in
each. The number of cells is bounded by the steps, not by the data.

Words are compared by 64 bits of hash, bigrams by 52. Requests are deleted from the
shared folder once they are answered.

Defined results: null and empty texts have one token, their end. Texts learn if
``remainder`` of their id is not 2; of these, remainder 3 is what EM holds out.
Repeated rows count as often as they occur and get equal results; a null id
stays null.
Without learning texts the score is uniform: every token 1 / (V + 1) with V = 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import pair_hashes, remainder, word_numbers
from logloom.sources.scratch import scratch_path, settle

BIGRAM_BITS = 52
STEPS = 16  # of a power of two, in the histogram for EM
BUCKETS = 24  # context frequencies: 0, 1, 2-3, 4-7, ...
LEAST_LOG = -64
TOKENS_AT_ONCE = 1 << 18  # keeps the temporary arrays of scoring small
RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


@dataclass(frozen=True)
class Model:
    held_out: int = 2  # remainder of documents that nothing is learned from
    em_part: int = 3  # remainder of documents whose n-grams EM uses
    modulus: int = 7
    block_bytes: int = 10 << 20
    range_entries: int = 1_000_000  # entries of all blocks that one range task adds up
    rounds: int = 60


def squash(values: np.ndarray) -> bytes:
    """Bytes of one significance lie together, which is what the compressor needs."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return zlib.compress(np.ascontiguousarray(raw.T).tobytes(), 1)


def unsquash(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(kind)


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return pair_hashes(left, right) >> np.uint64(64 - BIGRAM_BITS)


def pairs(numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (context, word) pairs as one number each, and each token's place among them.

    The context of a text's first token is its border, the same number as an end.
    """
    context = np.concatenate((np.zeros(1, numbers.dtype), numbers[:-1])).astype(np.int64)
    joined = context << 32 | numbers
    return np.unique(joined, return_inverse=True)


def counts_of(places: np.ndarray, size: int, kind: np.ndarray) -> np.ndarray:
    """Occurrences by place: in kept learning texts, in those that EM holds out."""
    return np.stack([np.bincount(places[kind == k], minlength=size) for k in (1, 2)], 1).astype(np.uint32)


def packed_block(ids: list, kinds: np.ndarray, texts: list, ranges: int, block: str) -> Iterator[tuple]:
    """Rows (range, block, kind of row, a, b): the block's requests and its documents."""
    numbers, sizes, hashes = word_numbers(texts)
    token_kind = np.repeat(kinds, sizes)
    distinct, place = pairs(numbers, sizes)
    left, right = hashes[distinct >> 32], hashes[distinct & 0xFFFFFFFF]
    for what, keys, where, bits in (("w", hashes, numbers, 64), ("b", mixed(left, right), place, BIGRAM_BITS)):
        counts = counts_of(where, len(keys), token_kind)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        owner = ((keys >> np.uint64(bits - 32)) * np.uint64(ranges)) >> np.uint64(32)
        cuts = np.searchsorted(owner, np.arange(ranges + 1, dtype=np.uint64))
        for r in range(ranges):
            a, b = cuts[r], cuts[r + 1]
            if b > a:
                steps = np.diff(keys[a:b], prepend=np.uint64(0))
                yield r, block, what, squash(steps), squash(counts[a:b].ravel())
    missing = np.array([i is None for i in ids], np.int64)
    known = np.array([i or 0 for i in ids], np.int64)
    head = np.stack([known, missing, kinds.astype(np.int64), sizes.astype(np.int64)], 1)
    # The hashes in word order are needed again to find the order of the answers.
    yield -1, block, "d", squash(head.ravel()), squash(numbers)
    yield -1, block, "h", squash(hashes), b""


PACKED = "numbers binary, head binary, words binary, bigrams binary"
ROWS = "range int, block string, what string, a binary, b binary"
SUMS = ["kept", "held", "vocabulary"]


def blocks(docs: DataFrame, model: Model, ranges: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["range", "block", "what", "a", "b"]
        kinds_of = [pa.int32(), pa.string(), pa.string(), pa.binary(), pa.binary()]
        ids, kinds, texts, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            # All rows of a block are written by one task, so a name only has to differ inside the table.
            block = f"{partition}-{part[0]}"
            part[0] += 1
            for row in packed_block(ids, np.array(kinds), texts, ranges, block):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], k) for x, k in zip(row, kinds_of, strict=True)], names=names
                )

        partition, part = TaskContext.get().partitionId(), [0]
        for batch in batches:
            for i, kind, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(i)
                kinds.append(kind)
                texts.append(text)
                held += len(text or "") + 8
                if held >= model.block_bytes:
                    yield from flush()
                    ids, kinds, texts, held = [], [], [], 0
        if ids:
            yield from flush()

    return docs.mapInArrow(run, ROWS)


def add_up(pdf: pd.DataFrame) -> Iterator[tuple[pd.Series, np.ndarray, np.ndarray]]:
    """For each request of one range: the request, and the totals of its entries (kept, held out)."""
    keys, counts = [], []
    for a, b in zip(pdf["a"], pdf["b"], strict=True):
        keys.append(np.cumsum(unsquash(a, np.uint64), dtype=np.uint64))
        counts.append(unsquash(b, np.uint32).reshape(-1, 2))
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    all_counts = np.concatenate(counts)
    totals = np.stack([np.bincount(place, all_counts[:, k], len(distinct)) for k in (0, 1)], 1).astype(np.uint64)
    ends = np.cumsum([len(k) for k in keys])
    return distinct, totals, np.split(place, ends[:-1])


def answers(requests: DataFrame) -> DataFrame:
    """Rows like the requests, with totals in place of keys; a row of kind ``s`` has the sums over a range's words."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        what, r = pdf["what"].iloc[0], int(pdf["range"].iloc[0])
        distinct, totals, places = add_up(pdf)
        rows = [
            (r, block, what, squash(totals[p].astype(np.uint32).ravel()), b"", None, None, None)
            for block, p in zip(pdf["block"], places, strict=True)
        ]
        if what == "w":
            both = totals.sum(1)
            rows.append((r, "", "s", b"", b"", *(int(x) for x in totals.sum(0)), int(np.count_nonzero(both))))
        found = pd.DataFrame(rows, columns=["range", "block", "what", "a", "b", *SUMS])
        return found.astype(dict.fromkeys(SUMS, "Int64"))

    return requests.groupBy("range", "what").applyInPandas(run, f"{ROWS}, {', '.join(f'{name} long' for name in SUMS)}")


@dataclass
class Block:
    ids: np.ndarray
    missing: np.ndarray  # 1 where the id is null
    kinds: np.ndarray
    sizes: np.ndarray
    numbers: np.ndarray
    context: np.ndarray  # word number before each token
    place: np.ndarray  # each token's place among the block's bigrams
    words: np.ndarray  # totals by word number
    bigrams: np.ndarray  # totals by place


def assembled(pdf: pd.DataFrame) -> Block:
    """A block from its documents and the answers to its requests."""
    by_kind = {what: rows for what, rows in pdf.groupby("what")}
    doc, hashes = by_kind["d"].iloc[0], unsquash(by_kind["h"]["a"].iloc[0], np.uint64)
    head = unsquash(doc["a"], np.int64).reshape(-1, 4)
    numbers = unsquash(doc["b"], np.uint32).astype(np.int64)
    distinct, place = pairs(numbers.astype(np.uint32), head[:, 3])
    keys = {"w": hashes, "b": mixed(hashes[distinct >> 32], hashes[distinct & 0xFFFFFFFF])}
    totals = {}
    for what, key in keys.items():
        rows = by_kind[what].sort_values("range")
        found = np.concatenate([unsquash(a, np.uint32).reshape(-1, 2) for a in rows["a"]]).astype(np.int64)
        totals[what] = np.empty_like(found)
        totals[what][np.argsort(key, kind="stable")] = found
    context = np.concatenate((np.zeros(1, np.int64), numbers[:-1]))
    return Block(*head.T, numbers, context, place, totals["w"], totals["b"])


def packed(block: Block) -> pd.DataFrame:
    """One row that holds all of a block but its hashes."""
    head = np.stack([block.ids, block.missing, block.kinds, block.sizes], 1).ravel()
    arrays = (block.numbers.astype(np.uint32), head, block.words.ravel(), block.bigrams.ravel())
    row = [squash(arrays[0]), squash(arrays[1]), *(squash(x.astype(np.uint32)) for x in arrays[2:])]
    return pd.DataFrame([row], columns=["numbers", "head", "words", "bigrams"])


def unpacked(row) -> Block:
    head = unsquash(row.head, np.int64).reshape(-1, 4)
    numbers = unsquash(row.numbers, np.uint32)
    _, place = pairs(numbers, head[:, 3])
    words, bigrams = (unsquash(x, np.uint32).reshape(-1, 2).astype(np.int64) for x in (row.words, row.bigrams))
    numbers = numbers.astype(np.int64)
    context = np.concatenate((np.zeros(1, np.int64), numbers[:-1]))
    return Block(*head.T, numbers, context, place, words, bigrams)


def per_block(table: DataFrame, work: Callable[[Block], pd.DataFrame], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = next(batch.slice(k, 1).to_pandas().itertuples())
                yield pa.RecordBatch.from_pandas(work(unpacked(row)), preserve_index=False)

    return table.mapInArrow(run, schema)


def forget(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def bucket(counts: np.ndarray) -> np.ndarray:
    """0 for no count, else 1 + floor(log2)."""
    return np.where(counts > 0, np.minimum(1 + np.log2(np.maximum(counts, 1)).astype(np.int64), BUCKETS - 1), 0)


def step(p: np.ndarray) -> np.ndarray:
    """Place of an estimate in the histogram; 0 stands for probability 0."""
    with np.errstate(divide="ignore"):
        log = np.maximum(np.log2(p), LEAST_LOG)
    return np.where(p > 0, 1 + np.round((log - LEAST_LOG) * STEPS).astype(np.int64), 0)


def estimate(place: np.ndarray) -> np.ndarray:
    return np.where(place > 0, np.exp2((place - 1) / STEPS + LEAST_LOG), 0.0)


def expectation_maximisation(cells: np.ndarray, uniform: float, rounds: int) -> np.ndarray:
    """Weights (bucket, estimate) from cells (bucket, bigram step, unigram step, tokens)."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)  # an unseen context has no bigram estimate
    if not len(cells):
        return weights
    p = np.stack([estimate(cells[:, 1]), estimate(cells[:, 2]), np.full(len(cells), uniform)], 1)
    for _ in range(rounds):
        parts = weights[cells[:, 0]] * p
        parts *= (cells[:, 3] / parts.sum(1))[:, None]
        sums = np.stack([np.bincount(cells[:, 0], parts[:, k], BUCKETS) for k in range(3)], 1)
        # A token for each weight keeps all of them above zero.
        sums += np.where(weights > 0, 1.0, 0.0)
        weights = sums / sums.sum(1, keepdims=True)
    return weights


def cells_of(block: Block, kept_tokens: int, em_kind: int = 2) -> np.ndarray:
    """Histogram cells of the tokens that EM holds out, by counts of the kept texts alone."""
    token_kind = np.repeat(block.kinds, block.sizes)
    at = np.flatnonzero(token_kind == em_kind)
    context = block.words[block.context[at], 0]
    both, word = block.bigrams[block.place[at], 0], block.words[block.numbers[at], 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        first = step(np.where(context > 0, np.minimum(1, both / context), 0.0))
    second = step(word / max(1, kept_tokens))
    joined = (bucket(context) << 40) | (first << 20) | second
    found, counts = np.unique(joined, return_counts=True)
    return np.stack([found >> 40, (found >> 20) & 0xFFFFF, found & 0xFFFFF, counts], 1)


def scored(block: Block, weights: np.ndarray, tokens: int, vocabulary: int, remainder_out: int = 0) -> pd.DataFrame:
    """Scores of a block's documents, by counts of all learning texts."""
    words, bigrams = block.words.sum(1), block.bigrams.sum(1)
    known, base, log = np.empty(len(block.numbers), np.int64), np.empty(len(block.numbers)), np.empty(len(block.numbers))
    for start in range(0, len(log), TOKENS_AT_ONCE):
        at = slice(start, start + TOKENS_AT_ONCE)
        count, context, both = words[block.numbers[at]], words[block.context[at]], bigrams[block.place[at]]
        known[at] = count > 0
        base[at] = np.log10((count + 1) / (tokens + vocabulary + 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            first = np.where(context > 0, np.minimum(1, both / context), 0.0)
        second, mix = count / max(1, tokens), weights[bucket(context)]
        log[at] = np.log10(mix[:, 0] * first + mix[:, 1] * second + mix[:, 2] / (vocabulary + 1))
    starts = np.concatenate(([0], np.cumsum(block.sizes)[:-1])).astype(np.int64)
    return pd.DataFrame(
        {
            "doc_id": pd.arrays.IntegerArray(block.ids.astype(np.int64), block.missing.astype(bool)),
            "held_out": block.kinds == remainder_out,
            "n_tokens": block.sizes,
            "n_known": np.add.reduceat(known, starts),
            "train_tokens": np.full(len(block.ids), tokens),
            "base_score": np.add.reduceat(base, starts),
            "score": np.add.reduceat(log, starts),
        }
    )


def score(docs: DataFrame, model: Model = Model(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``."""
    spark = docs.sparkSession
    rest = remainder(doc_id, model.modulus)
    kind = F.when(rest == model.held_out, 0).when(rest == model.em_part, 2).otherwise(1)
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), kind.alias("kind"), F.col(text).alias("text"))
    # A range's work stays the same for any input: entries are at most the letters over four.
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    ranges = max(16, -(-size // (4 * model.range_entries)))
    path = scratch_path(spark, "blocks")
    made = blocks(narrow, model, ranges)
    made.withColumn("request", (F.col("range") >= 0).cast("int")).write.partitionBy("request").parquet(path)
    table = spark.read.schema(f"{ROWS}, request int").parquet(path)
    requests, documents = table.where("request = 1").drop("request"), table.where("request = 0").drop("request")
    replies = settle(answers(requests), "answers")
    forget(spark, f"{path}/request=1")
    kept, held, vocabulary = (x or 0 for x in replies.agg(*[F.sum(name) for name in SUMS]).first())

    parts = documents.unionByName(replies.where("what <> 's'").drop(*SUMS))
    whole = settle(parts.groupBy("block").applyInPandas(lambda pdf: packed(assembled(pdf)), PACKED), "whole")
    forget(spark, f"{path}/request=0")

    def histogram(block: Block) -> pd.DataFrame:
        return pd.DataFrame(cells_of(block, kept), columns=["bucket", "first", "second", "tokens"])

    cell = "bucket long, first long, second long, tokens long"
    found = per_block(whole, histogram, cell).groupBy("bucket", "first", "second")
    rows = found.agg(F.sum("tokens").alias("tokens")).orderBy("bucket", "first", "second").collect()
    cells = np.array([tuple(r) for r in rows], np.int64).reshape(-1, 4)
    # EM sees the estimates of the kept texts; the weights then mix those of all learning texts.
    weights = expectation_maximisation(cells, 1 / (vocabulary + 1), model.rounds)
    tokens = kept + held
    shared = spark.sparkContext.broadcast(weights)

    return per_block(whole, lambda block: scored(block, shared.value, tokens, vocabulary), RESULT)
