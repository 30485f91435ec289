"""Phrases beside plain counting, the index beside a search of the sequence."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from logloom.llm import phrase_mining
from logloom.llm.phrase_mining import Index, Phrases, collocations, parts_of
from logloom.llm.queries import QUERIES

SCHEMA = "doc_id long, lang string, text string, shard string, n long, phrase string"


def grams(rows, longest):
    counts, sizes = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    return counts, sizes


def plain(rows, phrases):
    counts, sizes = grams(rows, phrases.longest)
    frequent = {g: a for g, a in counts.items() if a >= phrases.least and len(g) > 2}
    covered = Counter()
    for (lang, *w), a in frequent.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                inner = (lang, *w[i : i + size])
                covered[inner] = max(covered[inner], a)
    out = {}
    for (lang, *w), a in frequent.items():
        if 100 * covered[lang, *w] >= phrases.covered * a:
            continue
        cuts = []
        for k in range(1, len(w)):
            l, r = counts[lang, *w[:k]], counts[lang, *w[k:]]
            cuts.append((phrases.scale * a // (l + r), k, l, r))
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted(
        (lang, rank, w.decode(), -a, l, r, sizes[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, w, l, r) in enumerate(sorted(found)[: phrases.top], 1)
    )


def frame(spark, rows, partitions=4):
    return spark.createDataFrame([(i, l, t, "s", 1, "p") for i, (l, t) in enumerate(rows)], SCHEMA).repartition(partitions)


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["new", "York", "city", "of", "the", "é", "漢", "a-b", "(x)", "\x1c", " "]
    ends = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", ";", "!", "\r\n", " \x0b"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words[: rng.randint(2, len(words))]) + rng.choice(ends) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), text))
    return rows + [("en", None), (None, ""), ("en", "new york city " * 900), ("fr", " . , "), ("fr", "the the the the")]


def result(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(
    "phrases",
    [
        Phrases(),
        Phrases(shard_bytes=300, least=5),
        Phrases(shard_bytes=1000, least=3, covered=50, top=7),
        Phrases(longest=2, least=4),
        Phrases(longest=6, least=4, shard_bytes=2000),
    ],
)
def test_like_plain_counting(spark, phrases):
    rows = corpus(150, 4) + corpus(150, 4)[:100]
    assert result(collocations(frame(spark, rows), phrases)) == plain(rows, phrases)


def test_ties_and_products_beyond_64_bits(spark):
    rows = [("en", "b a. a b. d c; c d: e f g. " * 40), ("fr", "x y. x y z. " * 40)]
    phrases = Phrases(scale=10**18)
    found = result(collocations(frame(spark, rows, 1), phrases))
    assert found == plain(rows, phrases)
    scores = [(r[0], r[-1]) for r in found]
    assert len(set(scores)) < len(scores)


def test_nothing_frequent_and_empty(spark):
    assert result(collocations(frame(spark, [("en", "one two three")]))) == []
    assert result(collocations(frame(spark, []))) == []


def test_intervals_count_what_a_search_finds():
    rng = np.random.default_rng(2)
    for depth in (2, 3, 4, 5):
        symbols = np.concatenate(([0], rng.integers(0, 5, 400), [0]))
        index = Index(phrase_mining.dense(symbols), depth)
        found = index.phrases()
        windows = [tuple(symbols[i : i + depth]) for i in range(len(symbols) - depth + 1)]
        expected = Counter(w for w in windows if 0 not in w)
        at = index.first_places(found)
        assert {tuple(symbols[i : i + depth]): int(n) for i, n in zip(at, found.size, strict=True)} == expected


def test_both_sides_agree():
    """However a phrase is reached, its intervals are the same."""
    rng = np.random.default_rng(3)
    symbols = np.concatenate(([0], rng.integers(0, 4, 200), [0]))
    index = Index(symbols, 3)
    one = index.words()
    both = [index.extended_left(index.extended_right(one)), index.extended_right(index.extended_left(one))]
    rows = [sorted(zip(x.left.tolist(), x.right.tolist(), x.size.tolist(), strict=True)) for x in both]
    assert rows[0] == rows[1]


def test_parts_are_cut_at_ends_of_pieces():
    text = "one two, three four. five\nsix seven " * 30
    for size in (1, 10, 50, 10_000):
        assert b"".join(parts_of(text, size)).split() == b"".join(parts_of(text, 10**9)).split()


def test_query_reports_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    assert result(QUERIES["op11_fm_index"](spark, sf)) == plain(rows, Phrases())
