"""Token counts beside the library's own, with an empty, a full and a partly filled cache."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import token_cache
from logloom.llm.queries import QUERIES
from logloom.llm.token_cache import Counter, Vocabulary, content, count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, content string, n_tokens string, tokenizer string"
TEXTS = [
    "The other queue",
    "the  OTHER\n\nqueue ",
    "<|endoftext|> a",
    "<|ENDOFTEXT|> a",
    "J̌ and ǰ",
    "ǰ and ǰ",
    "漢字 😀 12 !!  É é",
    "",
    " \t\n",
    None,
    "x" * 300_000,
    "word's   " * 40_000,
]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.read(PATH)


@pytest.fixture(scope="module")
def plain():
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def table(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "c", "n", "t") for i, t in enumerate(texts)], SCHEMA)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def expected(rows, plain):
    return sorted(((i, len((t or "").encode()), n, n > 2048) for i, t in rows for n in [plain(t)]), key=str)


def test_counts_of_all_kinds_of_texts(spark, vocabulary, plain, tmp_path):
    rows = [*enumerate(TEXTS), (3, TEXTS[0]), (3, TEXTS[0]), (None, "no id"), (None, "no id"), (None, "other")]
    docs = spark.createDataFrame([(i, t, "c", "n", "t") for i, t in rows], SCHEMA).repartition(3)
    assert result(count_tokens(docs, vocabulary, f"{tmp_path}/cache")) == expected(rows, plain)


def test_only_distinct_misses_are_encoded(spark, vocabulary, plain, tmp_path, monkeypatch):
    cache, seen = f"{tmp_path}/cache", []
    whole = token_cache.encoded

    def watched(texts, vocabulary):
        seen.append(sorted(r["text"] for r in texts.collect()))
        return whole(texts, vocabulary)

    monkeypatch.setattr(token_cache, "encoded", watched)
    first, second = ["a b", "A  b", "c d"], ["c D ", "e f", "e f"]
    count_tokens(table(spark, first), vocabulary, cache).collect()
    found = count_tokens(table(spark, second, 10), vocabulary, cache)
    assert result(found) == expected([(10 + i, t) for i, t in enumerate(second)], plain)
    assert seen == [["a b", "c d"], ["e f"]]
    stored = spark.read.parquet(cache)
    assert stored.count() == 3 and stored.select("tokenizer").distinct().count() == 1
    count_tokens(table(spark, second), vocabulary, cache).collect()
    assert seen[-1] == []


def test_another_version_of_the_tokenizer_has_counts_of_its_own(spark, vocabulary, tmp_path):
    cache = f"{tmp_path}/cache"
    count_tokens(table(spark, ["one two"]), vocabulary, cache).collect()
    other = Vocabulary(vocabulary.json.replace('"Lowercase"', '"NFKC"'))
    assert other.digest != vocabulary.digest
    count_tokens(table(spark, ["one two"]), other, cache).collect()
    assert spark.read.parquet(cache).count() == 2


def test_rows_appended_twice_count_once(spark, vocabulary, plain, tmp_path):
    cache = f"{tmp_path}/cache"
    count_tokens(table(spark, ["one two"]), vocabulary, cache).collect()
    spark.read.parquet(cache).write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert result(count_tokens(table(spark, ["one two"] * 3), vocabulary, cache)) == expected(
        [(i, "one two") for i in range(3)], plain
    )


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_texts_are_fetched_with_and_without_a_shuffle(spark, vocabulary, plain, tmp_path, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        found = result(count_tokens(table(spark, TEXTS), vocabulary, f"{tmp_path}/cache"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == expected(enumerate(TEXTS), plain)


def test_empty_table(spark, vocabulary, tmp_path):
    assert count_tokens(table(spark, []), vocabulary, f"{tmp_path}/cache").collect() == []


ALPHABET = "aAbIJÉéß'<|>endoftx \t\n ̱̌́̇Σς1２漢😀 "


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=40), max_size=4))
def test_words_have_the_tokens_of_the_whole(texts):
    tokenizer = token_cache.loaded(Vocabulary.read(PATH).json)
    whole = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert Counter(tokenizer)(texts) == whole


def test_words_that_are_forgotten(monkeypatch, plain):
    monkeypatch.setattr(token_cache, "REMEMBERED", 3)
    count = Counter(token_cache.loaded(Vocabulary.read(PATH).json))
    rng = random.Random(8)
    for _ in range(20):
        texts = [" ".join(rng.choice(["a", "Bb", "ccc", "y" * 90, "ü" * 40, "é!"]) for _ in range(9)), None, ""]
        assert count(texts) == [plain(t) for t in texts]


def test_equal_digests_mean_equal_counts(plain):
    rng = random.Random(5)
    specials = ["<|endoftext|>", "<|EndOfText|>", "J̌", "İ", " "]
    texts = ["".join(rng.choice([*ALPHABET, *specials]) for _ in range(rng.randint(0, 6))) for _ in range(4000)]
    texts += [t.lower() for t in texts[:2000]] + [f" {t}  " for t in texts[:500]]
    by_digest = {}
    for text in texts:
        by_digest.setdefault(content(text), set()).add(plain(text))
    assert len(by_digest) < len(set(texts)) and all(len(x) == 1 for x in by_digest.values())


def test_query_counts_the_whole_table(spark, plain):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert result(QUERIES["op12_digest_cache"](spark, sf)) == expected([tuple(r) for r in docs], plain)
