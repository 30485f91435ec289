"""Collocations from an FM-index per shard.

A shard is a bounded part of the corpus as a sequence of word ids, one language
after the other, in which 0 ends a piece. Its index sorts the places of the
sequence by the words that follow (as many as a phrase may have), and keeps for
each the word in front: the Burrows-Wheeler transform. The places of a phrase
are an interval of that order. A second index of the reversed sequence does the
same to the other side, and a phrase's interval is kept in both: extending it by
a word on the left reads the first index and moves the interval of the second
along, extending it on the right does the opposite. All phrases of a depth are
extended at once, with array operations.

Counts are added up over shards depth by depth. A phrase may only be frequent
if the two phrases that lack its last and its first word are, so each depth
keeps, of every shard's sequence, the runs whose phrases are frequent in the
whole corpus, and the next index is built of these runs alone. A phrase is
identified by the ids of those two, its left and its right part; nothing is
hashed, counts are exact.

The tables of frequent phrases hold what scores need. A phrase inherits the
counts of all its beginnings from its left part and of all its endings from its
right part. The phrases that extend it by a word are the rows that name it as a
part; a longer phrase around it is never more frequent than these, so the most
frequent of them decides whether it is dropped.

Shards are made where the texts are read; texts are never shuffled. What a shard
counts is shuffled once by phrase, summed there, and what is frequent goes back
to its shard. A shard has one row of a phrase, and no list passes through the
driver. A text is cut into shards at the ends of pieces only, so
memory is bounded by ``shard_bytes`` and the longest piece.

Defined results: null texts count as empty, a null language is ``und``. Repeated
rows count as often as they occur. An empty table has no phrases.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import LOWER
from logloom.sources.scratch import delete_folder, scratch_path, settle

# Bytes that end a piece; a full stop stands for them between words. Tabs become spaces.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
MARKS = bytes(46 if c in ENDS else 32 if c == 9 else c for c in LOWER)
UNKNOWN = "und"
FIRST_ROW = "shard long, lang string, word string, place int, n long, words binary"
SALTS = 64


@dataclass(frozen=True)
class Phrases:
    longest: int = 4  # words
    least: int = 30  # occurrences of a candidate
    scale: int = 2_000_000
    covered: int = 80  # per cent of a phrase's occurrences, inside one longer phrase, that drop it
    top: int = 2000  # phrases reported for each language
    shard_bytes: int = 8 << 20


def squash(values: np.ndarray) -> bytes:
    """Bytes of one significance lie together, which is what the compressor needs."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return zlib.compress(np.ascontiguousarray(raw.T).tobytes(), 1)


def unsquash(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(kind)


# --- shards --------------------------------------------------------------------


class Shard:
    """Words of texts as numbers; 0 ends a piece."""

    def __init__(self) -> None:
        self.known: dict[str, Numbers] = {}
        self.words: list[bytes] = [b""]
        self.parts: list[np.ndarray] = [np.zeros(1, np.uint32)]
        self.held = 0

    def add(self, lang: str, raw: bytes) -> None:
        """``raw``: bytes in which a word ``.`` ends a piece."""
        if lang not in self.known:
            self.known[lang] = Numbers(self.words)
        words = raw.split()
        numbers = np.fromiter(map(self.known[lang].__getitem__, words), np.uint32, len(words))
        self.parts += [numbers, np.zeros(1, np.uint32)]
        self.held += len(raw)

    def table(self, name: int) -> pa.Table:
        """A row for each word, and one for the sequence."""
        numbers, size = np.concatenate(self.parts), len(self.words)
        langs = np.zeros(size, np.int32)
        for at, own in enumerate(self.known.values()):
            places = np.fromiter(own.values(), np.int64, len(own))
            langs[places[places > 0]] = at
        blank = np.arange(size) == 0  # the row of the sequence
        columns = {
            "shard": pa.array(np.full(size, name, np.int64)),
            "lang": pa.array([*self.known, ""], pa.string()).take(pa.array(langs, mask=blank)),
            "word": pa.array([None, *self.words[1:]], pa.binary()).cast(pa.string()),
            "place": pa.array(np.arange(size, dtype=np.int32), mask=blank),
            "n": pa.array(np.bincount(numbers, minlength=size), mask=blank),
            "words": pa.array([squash(numbers), *[None] * (size - 1)], pa.binary()),
        }
        return pa.table(columns)


class Numbers(dict):
    """Number of each word of a language in a shard; ``words`` has those of all languages."""

    def __init__(self, words: list[bytes]) -> None:
        super().__init__({b".": 0})
        self.words = words

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self.words)
        self.words.append(word)
        return found


def parts_of(text: str | None, size: int) -> Iterator[bytes]:
    """The text as bytes with ends of pieces as words, cut at such ends into parts of about ``size`` bytes."""
    raw, start = (text or "").encode("utf-8", "replace").translate(MARKS), 0
    while start < len(raw):
        end = len(raw) if len(raw) - start <= size else raw.find(b".", start + size)
        end = len(raw) if end < 0 else end
        yield raw[start:end].replace(b".", b" . ")
        start = end


def shards(docs: DataFrame, phrases: Phrases) -> DataFrame:
    """Rows of words (shard, lang, word, place, n), and one row of each shard's sequence. ``docs``: lang, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Shards and counts are written together, so a name only has to differ inside the table.
        name, shard = TaskContext.get().partitionId() << 32, Shard()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for part in parts_of(text.as_py(), phrases.shard_bytes):
                    shard.add(lang, part)
                    if shard.held >= phrases.shard_bytes:
                        yield from shard.table(name).to_batches(max_chunksize=1 << 15)
                        name, shard = name + 1, Shard()
        yield from shard.table(name).to_batches(max_chunksize=1 << 15)

    return docs.mapInArrow(run, FIRST_ROW)


# --- the index of a shard ------------------------------------------------------


@dataclass
class Side:
    """One direction of the index: what stands in front of each place of the order, for ranks."""

    order: np.ndarray
    front: np.ndarray  # the transform
    ranked: np.ndarray  # (symbol, row) as one number each, sorted: C[symbol] + occurrences by binary search

    @classmethod
    def of(cls, symbols: np.ndarray, depth: int) -> Side:
        """Places sorted by the next ``depth`` symbols; the sequence is a circle."""
        n, key, width = len(symbols), symbols.astype(np.int64), 1
        while width < depth:
            rank = np.unique(key, return_inverse=True)[1] if width > 1 else key
            key, width = rank * (int(rank.max()) + 1) + np.roll(rank, -width), 2 * width
        order = np.argsort(key, kind="stable")
        front = np.roll(symbols, 1)[order].astype(np.int64)
        ranked = np.sort(front * n + np.arange(n))
        return cls(order, front, ranked)

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rows before ``row`` with that symbol in front, after all rows of smaller symbols."""
        return np.searchsorted(self.ranked, symbol * len(self.front) + row)


@dataclass
class Intervals:
    """Phrases of one depth: where each begins in the left and the right index, and its occurrences."""

    left: np.ndarray
    right: np.ndarray
    size: np.ndarray


def rows_of(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All rows of the intervals, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def extend(side: Side, start: np.ndarray, other: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Every phrase by every word in front of it in ``side``: new start, other start, size.

    The interval in the other index shrinks to the part of the extending word;
    the parts lie in the order of the words, the ends of pieces first.
    """
    symbols = side.front[rows_of(start, size)]
    n = len(side.front)
    pairs, counts = np.unique(np.repeat(np.arange(len(start)), size) * n + symbols, return_counts=True)
    of, symbol = pairs // n, pairs % n
    before = np.cumsum(counts) - counts
    first = np.searchsorted(of, np.arange(len(start)))
    inside = before - before[first][of] if len(of) else before
    word = symbol > 0
    of, symbol, inside, counts = of[word], symbol[word], inside[word], counts[word]
    return side.rank(symbol, start[of]), other[of] + inside, counts


class Index:
    """Both directions of a sequence of word symbols (0 ends a piece), for phrases of up to ``depth`` words."""

    def __init__(self, symbols: np.ndarray, depth: int) -> None:
        # Symbols stay below the length, so that a symbol and a row fit in one number.
        self.symbols, self.depth = symbols, depth
        self.forward = Side.of(symbols, depth)
        self._backward: Side | None = None

    @property
    def backward(self) -> Side:
        if self._backward is None:
            self._backward = Side.of(self.symbols[::-1], self.depth)
        return self._backward

    def words(self) -> Intervals:
        """The phrases of one word."""
        counts = np.bincount(self.symbols)
        start = np.cumsum(counts) - counts
        at = np.flatnonzero(counts)
        at = at[at > 0]
        return Intervals(start[at], start[at], counts[at])

    def extended_left(self, found: Intervals) -> Intervals:
        left, right, size = extend(self.forward, found.left, found.right, found.size)
        return Intervals(left, right, size)

    def extended_right(self, found: Intervals) -> Intervals:
        right, left, size = extend(self.backward, found.right, found.left, found.size)
        return Intervals(left, right, size)

    def phrases(self) -> Intervals:
        """All phrases of ``depth`` words, extended left and right by turns."""
        found = self.words()
        for k in range(1, self.depth):
            found = self.extended_left(found) if k % 2 else self.extended_right(found)
        return found

    def first_places(self, found: Intervals) -> np.ndarray:
        """A place of the sequence where each phrase stands."""
        return self.forward.order[found.left]


def dense(ids: np.ndarray) -> np.ndarray:
    """Ids as symbols from 0 on; 0 stays 0, and is there."""
    return np.unique(np.concatenate((np.zeros(1, ids.dtype), ids)), return_inverse=True)[1][1:]


# --- depth by depth ------------------------------------------------------------

# A shard's sequence at some depth: the word ids, and for each place the id of the phrase
# of the depth before that begins there (0: none; the last words of a run). At first these
# are the words, and nothing is written for them.
STATE = "shard long, words binary, phrases binary"
COUNT = "shard long, left long, right long, n long"


def unpack(words: bytes, phrases: bytes) -> tuple[np.ndarray, np.ndarray]:
    sequence = unsquash(words, np.int64)
    return sequence, unsquash(phrases, np.int64) if phrases else sequence


def counted(words: np.ndarray, phrases: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left part, right part and occurrences of each phrase of ``depth`` words in a shard."""
    index = Index(dense(words), depth)
    found = index.phrases()
    at = index.first_places(found)
    return phrases[at], np.roll(phrases, -1)[at], found.size


def shard_counts(state: DataFrame, depth: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, words, phrases in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                left, right, n = counted(*unpack(words, phrases), depth)
                order = np.lexsort((right, left))
                names = np.full(len(n), shard, np.int64)
                table = pa.table([names, left[order], right[order], n[order]], names=["shard", "left", "right", "n"])
                yield from table.to_batches(max_chunksize=1 << 15)

    return state.mapInArrow(run, COUNT)


def runs(words: np.ndarray, ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of places with an id, each with the words of its last phrase, and 0 around all.

    ``ids``: for each place the id of the frequent phrase of ``depth`` words that begins there, or 0.
    """
    on = np.concatenate(([0], (ids > 0).astype(np.int8), [0]))
    edge = np.diff(on)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = end - start + depth  # phrases, the other words of the last, and a 0
    places = rows_of(start, size)
    inside = np.ones(len(places), bool)
    inside[np.cumsum(size) - 1] = False
    places = np.minimum(places, len(words) - 1)
    new_words = np.where(inside, words[places], 0)
    offset = rows_of(np.zeros(len(start), np.int64), size)
    new_ids = np.where(offset < np.repeat(end - start, size), ids[places], 0)
    zero = np.zeros(1, np.int64)
    return np.concatenate((zero, new_words)), np.concatenate((zero, new_ids))


def ids_of(phrases: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each place the id of the phrase whose parts begin at this place and the next, or 0."""
    n, m = len(phrases), len(ids)
    if not m:
        return np.zeros(n, np.int64)
    parts, place = np.unique(np.concatenate((phrases, left, right)), return_inverse=True)
    own = place[:n] * len(parts) + np.roll(place[:n], -1)
    known = place[n : n + m] * len(parts) + place[n + m :]
    order = np.argsort(known)
    at = np.minimum(np.searchsorted(known[order], own), m - 1)
    hit = (phrases > 0) & (np.roll(phrases, -1) > 0) & (known[order][at] == own)
    return np.where(hit, ids[order][at], 0)


def with_answers(state: DataFrame, answers: DataFrame, step: Callable) -> DataFrame:
    """``step(words, phrases, left, right, id)`` makes the new state of each shard.

    A shard without answers holds nothing frequent any more and goes.
    """
    names = ["shard", "words", "phrases", "left", "right", "id"]

    def run(table: pa.Table) -> pa.Table:
        own = table.column("words").is_valid()
        row, rest = table.filter(own).to_pylist(), table.filter(pc.invert(own))
        if not row or not rest.num_rows:
            return pa.table({name: pa.array([], pa.int64() if name == "shard" else pa.binary()) for name in names[:3]})
        words, phrases = step(row[0]["words"], row[0]["phrases"], *(rest.column(c).to_numpy() for c in names[3:]))
        new = {"shard": pa.array([row[0]["shard"]], pa.int64()), "words": pa.array([squash(words)], pa.binary())}
        return pa.table(new | {"phrases": pa.array([b"" if phrases is words else squash(phrases)], pa.binary())})

    unset = [F.lit(None).cast("long").alias(name) for name in names[3:]]
    blank = [F.lit(None).cast("binary").alias(name) for name in names[1:3]]
    rows = state.select(*names[:3], *unset).union(answers.select("shard", *blank, *names[3:]))
    return rows.groupBy("shard").applyInArrow(run, STATE)


def first_state(sequences: DataFrame, answers: DataFrame) -> DataFrame:
    """Word ids in place of a shard's numbers. ``answers``: shard, place (a word's number), id."""

    def step(words: bytes, _, place: np.ndarray, __, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        numbers = unsquash(words, np.uint32)
        ids = np.zeros(int(numbers.max()) + 1, np.int64)
        ids[place] = found
        sequence, _ = runs(ids[numbers], ids[numbers], 1)
        return sequence, sequence

    state = sequences.select("shard", "words", F.lit(None).cast("binary").alias("phrases"))
    place = F.col("place").cast("long").alias("left")
    return with_answers(state, answers.select("shard", place, F.lit(0).cast("long").alias("right"), "id"), step)


def next_state(state: DataFrame, answers: DataFrame, depth: int) -> DataFrame:
    """The sequences cut down to frequent phrases of ``depth`` words. ``answers``: shard, left, right, id."""

    def step(words: bytes, phrases: bytes, *answer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, parts = unpack(words, phrases)
        return runs(sequence, ids_of(parts, *answer), depth)

    return with_answers(state, answers, step)


def frequent_in_all(rows: DataFrame, least: int, *keys: str) -> DataFrame:
    """The rows (of shards) whose key occurs often enough in all shards together.

    They get ``f``, the sum of ``n`` over the key, ``id``, a number above 0 that
    no other key has, and ``first``, true in one row of each key. A shard has
    one row of a key at most, so no key has more rows than there are shards.
    """
    key = Window.partitionBy(*keys)
    own = rows.withColumn("own", F.monotonically_increasing_id() + 1)
    found = own.withColumns({"f": F.sum("n").over(key), "id": F.min("own").over(key)}).where(F.col("f") >= least)
    return found.withColumn("first", F.col("own") == F.col("id")).drop("own", "n")


def mine(docs: DataFrame, phrases: Phrases = Phrases(), lang: str = "lang", text: str = "text") -> list[DataFrame]:
    """Tables of the frequent phrases of 1, 2, ... words.

    Columns: id, left, right, lang, phrase, last (word), n (words of the
    language), heads and tails (counts of the phrase's beginnings and endings,
    the shortest first; both end with the phrase's own count).
    """
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    folder = scratch_path(spark, "phrases")
    made = shards(source, phrases).withColumn("what", F.when(F.col("words").isNull(), "word").otherwise("shard"))
    made.write.partitionBy("what").parquet(f"{folder}/shards")
    written = spark.read.schema(f"{FIRST_ROW}, what string").parquet(f"{folder}/shards")
    words, sequences = written.where("what = 'word'"), written.where("what = 'shard'")

    sizes = settle(words.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    kept = words.select("shard", "place", "lang", "word", "n")
    kept = settle(frequent_in_all(kept, phrases.least, "lang", "word"), "words", f"{folder}/words")
    none, word, one = F.lit(0).cast("long"), F.col("word"), F.array("f")
    table = kept.where("first").join(sizes, "lang").select(
        "id",
        none.alias("left"),
        none.alias("right"),
        "lang",
        word.alias("phrase"),
        word.alias("last"),
        "n",
        one.alias("heads"),
        one.alias("tails"),
    )
    tables = [settle(table, "phrases-1")]
    state = settle(first_state(sequences, kept.select("shard", "place", "id")), "state", f"{folder}/state-1")
    delete_folder(spark, f"{folder}/shards")
    delete_folder(spark, f"{folder}/words")
    for depth in range(2, phrases.longest + 1):
        kept = frequent_in_all(shard_counts(state, depth), phrases.least, "left", "right")
        kept = settle(kept, "counts", f"{folder}/counts-{depth}")
        if depth < phrases.longest:
            answers = kept.select("shard", "left", "right", "id")
            state = settle(next_state(state, answers, depth), "state", f"{folder}/state-{depth}")
        tables.append(settle(longer(kept.where("first"), tables[-1]), f"phrases-{depth}"))
        delete_folder(spark, f"{folder}/state-{depth - 1}")
        delete_folder(spark, f"{folder}/counts-{depth}")
    return tables


def longer(sums: DataFrame, parts: DataFrame) -> DataFrame:
    """The table of frequent phrases from their sums (id, left, right, f) and the table of their parts."""
    sums = sums.select("id", "left", "right", "f")
    left = parts.select(
        F.col("id").alias("left"), "lang", "n", F.col("phrase").alias("begins"), F.col("heads").alias("begin_counts")
    )
    right = parts.select(F.col("id").alias("right"), "last", F.col("tails").alias("end_counts"))
    own = F.array("f")
    return (
        sums.join(left, "left")
        .join(right, "right")
        .select(
            "id",
            "left",
            "right",
            "lang",
            F.concat_ws(" ", "begins", "last").alias("phrase"),
            "last",
            "n",
            F.concat("begin_counts", own).alias("heads"),
            F.concat("end_counts", own).alias("tails"),
        )
    )


# --- scores --------------------------------------------------------------------


def lowest_cut(words: int, scale: int) -> Column:
    """The cut (score, k, l, r) with the lowest score; of equal ones the first."""
    heads, tails = F.col("heads"), F.col("tails")
    a = heads[words - 1].cast("decimal(19,0)")
    cuts = []
    for k in range(1, words):
        l, r = heads[k - 1], tails[words - k - 1]
        parts = l.cast("decimal(19,0)") + r.cast("decimal(19,0)")
        exact = F.call_function("div", a * F.lit(scale).cast("decimal(19,0)"), parts)
        cuts.append(F.struct(exact.cast("long").alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(
    docs: DataFrame, phrases: Phrases = Phrases(), lang: str = "lang", text: str = "text"
) -> DataFrame:
    """The best ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    tables = mine(docs, phrases, lang, text)
    scored = []
    for words, table in enumerate(tables[1:], 2):
        a = F.col("heads")[words - 1]
        rows = table.select("id", "lang", "phrase", "n", a.alias("a"), lowest_cut(words, phrases.scale).alias("cut"))
        if words < phrases.longest:
            extended = tables[words].select("left", "right", F.col("heads")[words].alias("f"))
            around = extended.select(F.col("left").alias("id"), "f").union(extended.select("right", "f"))
            most = around.groupBy("id").agg(F.max("f").alias("f"))
            much = F.col("f").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * phrases.covered
            rows = rows.join(most, "id", "left").where(~F.coalesce(much, F.lit(False))).drop("f")
        scored.append(rows.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
    found = scored[0]
    for rows in scored[1:]:
        found = found.union(rows)
    return best(found, phrases.top)


def best(found: DataFrame, top: int) -> DataFrame:
    """Ranked per language; a language's phrases are first cut down in parts, whose number is fixed."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    part = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
    few = salted.withColumn("part", part).where(F.col("part") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    ranked = few.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
