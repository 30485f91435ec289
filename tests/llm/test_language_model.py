"""Deleted interpolation beside a plain version: counts, weights and scores."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from logloom.llm.common import LOWER
from logloom.llm.deleted_interpolation import Model, score

END = b""


def remainder(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7


def tokens_of(text):
    return [*(text or "").encode().translate(LOWER).split(), END]


def bucket(count):
    return 0 if not count else min(23, 1 + int(math.log2(count)))


def rough(p):
    """An estimate as the histogram keeps it: a sixteenth of a power of two."""
    return 2 ** (round((max(math.log2(p), -64) + 64) * 16) / 16 - 64) if p else 0.0


def plain(rows, rounds=60):
    counts = {part: (Counter(), Counter()) for part in ("kept", "held")}
    for doc_id, text in rows:
        if remainder(doc_id) != 2:
            words, pairs = counts["held" if remainder(doc_id) == 3 else "kept"]
            tokens = tokens_of(text)
            words.update(tokens)
            pairs.update(zip([END, *tokens], tokens))
    kept, kept_pairs = counts["kept"]
    words, pairs = kept + counts["held"][0], kept_pairs + counts["held"][1]
    n, v = sum(words.values()), len(words)
    kept_n, uniform = max(1, sum(kept.values())), 1 / (v + 1)

    cells = Counter()
    for doc_id, text in rows:
        if remainder(doc_id) == 3:
            tokens = tokens_of(text)
            for context, word in zip([END, *tokens], tokens):
                c = kept[context]
                cells[bucket(c), rough(kept_pairs[context, word] / c if c else 0), rough(kept[word] / kept_n)] += 1
    weights = defaultdict(lambda: (1 / 3, 1 / 3, 1 / 3)) | {0: (0, 0.5, 0.5)}
    for _ in range(rounds if cells else 0):
        sums = {b: [1.0 if w else 0.0 for w in weights[b]] for b in range(24)}
        for (b, first, second), times in cells.items():
            parts = [w * p for w, p in zip(weights[b], (first, second, uniform))]
            for k in range(3):
                sums[b][k] += parts[k] * times / sum(parts)
        weights = {b: [x / sum(s) for x in s] for b, s in sums.items()}

    out = []
    for doc_id, text in rows:
        tokens, total, base = tokens_of(text), 0.0, 0.0
        for context, word in zip([END, *tokens], tokens):
            c = words[context]
            mix = weights[bucket(c)]
            total += math.log10(mix[0] * (pairs[context, word] / c if c else 0) + mix[1] * words[word] / max(1, n) + mix[2] * uniform)
            base += math.log10((words[word] + 1) / (n + v + 1))
        known = sum(words[t] > 0 for t in tokens)
        out.append((doc_id, remainder(doc_id) == 2, len(tokens), known, n, base, total))
    return out


def compare(found, expected):
    key = lambda r: (str(r[0]), r[2], r[6])
    found, expected = sorted(map(tuple, found), key=key), sorted(expected, key=key)
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    for mine, other in zip(found, expected, strict=True):
        assert mine[5:] == pytest.approx(other[5:], rel=1e-9)


def corpus(n=70, seed=6):
    rng = random.Random(seed)
    words = ["the", "The", "of", "queue", "él", "b", "c", "d", "漢"]
    rows = [(i, " ".join(rng.choices(words, range(9, 0, -1), k=rng.randint(0, 40)))) for i in range(n)]
    return [*rows, (900, None), (901, ""), (None, "no id the"), (-1, "an id of its own"), (5, rows[5][1])]


@pytest.mark.parametrize("model", [Model(), Model(block_bytes=300, range_entries=7)])
def test_like_a_plain_version(spark, model):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    compare(score(docs, model).collect(), plain(rows))


def test_the_same_file_read_twice(spark):
    rows = corpus()
    once = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    compare(score(once.union(once), Model(block_bytes=500, range_entries=20)).collect(), plain(rows + rows))


def test_nothing_to_learn_from(spark):
    rows = [(i, "one two") for i in range(60) if remainder(i) == 2]
    compare(score(spark.createDataFrame(rows, "doc_id long, text string")).collect(), plain(rows))
