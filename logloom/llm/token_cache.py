"""Token counts by a digest cache.

A cache is a Parquet folder of (tokenizer, content, n_tokens): ``tokenizer`` is
a digest of the vocabulary file, the library's version and the rule of
normalisation, ``content`` the SHA-256 of the normalised text. Counting joins
the digests of all texts to the cache, encodes one text of each digest that is
missing, and appends the new counts for the next call.

Normalising merges runs of ASCII white space and cuts them off at both ends,
and lowers A-Z. It never changes a count of a vocabulary whose normaliser does
the same, with two exceptions, in which the case stays: a text with ``<|`` (a
special token is only recognised as it is written) and a text with a combining
mark (letter and mark may have a composed form in one case only).

Only digests are joined to the cache. The texts to encode, one for each digest
that is missing, are fetched by their id and a hash of the text; Spark moves no
text for that if the list of them is small, else all texts once. Copies are one
row in all joins but the last, where Spark may split them. No token, special
token or composed letter crosses ASCII white space, so a text is encoded as its
words, and a task encodes a word once while it remembers it.

Defined results: null counts as empty and has no token. Every row gets its row,
repeated ones too. A null id stays null. Rows written twice by jobs that ran at
the same time are one row when read. An append that failed leaves no rows or
right ones, so it may be run again.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import LOWER, annotate, field
from logloom.sources.scratch import settle

KEEPS_CASE = re.compile("[\u0300-\u036f]")
RULE = "ascii-space,ascii-lower/1"
CACHE_ROW = "tokenizer string, content binary, n_tokens long"
REMEMBERED = 400_000  # words whose counts a task remembers
LONG_WORD = 64  # bytes; longer ones are not remembered
AT_ONCE = 20_000  # words given to the library together


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer of the tokenizers library, as its JSON text (a few megabytes, broadcast to the tasks)."""

    json: str

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            return cls(file.read())

    @property
    def digest(self) -> str:
        parts = "\n".join((RULE, tokenizers.__version__, self.json))
        return hashlib.sha256(parts.encode()).hexdigest()


def content(text: str | None) -> bytes:
    """Digest of the normalised text."""
    spaced = b" ".join((text or "").encode("utf-8", "replace").split())
    if b"<|" not in spaced and (text is None or text.isascii() or not KEEPS_CASE.search(text)):
        spaced = spaced.translate(LOWER)
    return hashlib.sha256(spaced).digest()


_LOADED: dict[str, tokenizers.Tokenizer] = {}


def loaded(json: str) -> tokenizers.Tokenizer:
    """One tokenizer a Python worker."""
    key = hashlib.sha256(json.encode()).hexdigest()
    if key not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = tokenizers.Tokenizer.from_str(json)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _LOADED[key] = tokenizer
    return _LOADED[key]


class Counter:
    """Token counts of texts, word by word."""

    def __init__(self, tokenizer: tokenizers.Tokenizer) -> None:
        self.tokenizer = tokenizer
        self.known: dict[bytes, int] = {}

    def encoded(self, words: list[bytes]) -> Iterator[tuple[bytes, int]]:
        for at in range(0, len(words), AT_ONCE):
            part = words[at : at + AT_ONCE]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            yield from zip(part, map(len, found), strict=True)

    def __call__(self, texts: list[str | None]) -> list[int]:
        split = [(text or "").encode("utf-8", "replace").split() for text in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = set(chain.from_iterable(split)).difference(self.known)
        long = [w for w in new if len(w) > LONG_WORD]
        self.known.update(self.encoded(list(new.difference(long))))
        brief = dict(self.encoded(long))
        if not brief:
            return [sum(map(self.known.__getitem__, words)) for words in split]
        return [sum(self.known[w] if w in self.known else brief[w] for w in words) for words in split]


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """(content, n_tokens) of one tokenizer, a row for each digest; a cache that is not there yet is empty."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "content binary, n_tokens long")
    rows = spark.read.schema(CACHE_ROW).parquet(path).where(F.col("tokenizer") == tokenizer)
    return rows.groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def digested(source: DataFrame) -> DataFrame:
    """doc_id, n_bytes, content, and a hash of the text itself."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = source.withColumns({"n_bytes": size, "raw": F.xxhash64("text")})
    work = lambda texts: [list(map(content, texts))]
    return annotate(rows, lambda: work, [field("content", "binary")], "text").drop("text")


def encoded(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(content, n_tokens) of column ``text``."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary.json)

    def start():
        count = Counter(loaded(shared.value))
        return lambda texts: [list(map(content, texts)), count(texts)]

    rows = annotate(texts, start, [field("content", "binary"), field("n_tokens", "long")], "text")
    return rows.groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame,
    vocabulary: Vocabulary,
    cache: str,
    limit: int = 2048,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit. ``cache`` is the cache's folder."""
    spark, version = docs.sparkSession, vocabulary.digest
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    keys = settle(digested(source), "digests")

    distinct = keys.groupBy("content").agg(F.min(F.struct("doc_id", "raw")).alias("one"))
    found = settle(distinct.join(read_cache(spark, cache, version), "content", "left"), "found")
    # A table of its own, so that its size tells Spark how to join.
    missing = found.where("n_tokens is null").select(F.col("one.doc_id").alias("wanted_id"), F.col("one.raw").alias("wanted"))
    missing = settle(missing, "missing")
    same = (F.xxhash64("text") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("wanted_id"))
    fresh = settle(encoded(source.join(missing, same, "left_semi").select("text"), vocabulary), "fresh")
    new = fresh.select(F.lit(version).alias("tokenizer"), "content", "n_tokens")
    new.write.mode("append").partitionBy("tokenizer").parquet(cache)

    known = found.where("n_tokens is not null").select("content", "n_tokens").union(fresh)
    return keys.join(known, "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
