"""Limits learned from a corpus, and what they reject that the base rule lets through."""

from __future__ import annotations

import random

import pytest
import zstandard

from logloom.llm import compression_bands as bands
from logloom.llm.compression_bands import Band, Bands, Fit

SIZES = (600, 1500, 3000, 9000)
HOW = Fit(sizes=(256, 1 << 10, 2 << 10, 8 << 10), chunk_sizes=(1 << 10, 4 << 10), least_texts=30)


def words(rng, size, vocabulary):
    out = []
    while sum(map(len, out)) + len(out) < size:
        out.append(rng.choice(vocabulary))
    return " ".join(out)


def prose(n=40, seed=2):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    return [words(rng, size + rng.randrange(200), vocabulary) for size in SIZES for _ in range(n)]


def planted(seed=5):
    """(text, size): repetitive and incompressible texts of every band that pass the base rule."""
    rng = random.Random(seed)
    few = {600: 14, 1500: 22, 3000: 30, 9000: 45}
    repetitive = [(words(rng, size, [f"word{k % 7}{k}" for k in range(few[size])]), size) for size in SIZES]
    noise = ["".join(chr(rng.randrange(33, 127)) for _ in range(7)) for _ in range(5000)]
    return repetitive + [(words(rng, size, noise), size) for size in SIZES]


@pytest.fixture(scope="module")
def table(spark):
    rows = [*enumerate(prose()), *[(1000 + i, t) for i, (t, _) in enumerate(planted())], (2000, None), (2001, "again " * 900)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def plain_limits(texts, how, given):
    pack = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)
    whole, chunk = {}, {}
    for text in texts:
        raw = (text or "").encode()
        found = raw.split()
        if len(raw) < how.sizes[0] or len(found) < 50 or 100 * bands.repeat_words(found) > 50 * len(found):
            continue
        pieces = [raw[at : at + 4096] for at in range(0, len(raw), 4096)] if len(raw) > 4096 else []
        for into, own, parts in ((whole, how.sizes, [raw]), (chunk, how.chunk_sizes, [p for p in pieces if len(p) >= 1024])):
            for part in parts:
                size = max(s for s in own if len(part) >= s)
                into.setdefault(size, []).append(round(1000 * len(pack.compress(part)) / len(part)) / 1000)
    out = []
    for found, sizes, default in ((whole, how.sizes, given.whole), (chunk, how.chunk_sizes, given.chunk)):
        for size in sizes:
            shares = sorted(found.get(size, []))
            if len(shares) < how.least_texts:
                own = bands.limits(default, size)
                out.append(Band(size, own.low, own.high))
            else:
                low, high = (next(s for i, s in enumerate(shares, 1) if i >= part * len(shares)) for part in (0.25, 0.75))
                room = how.reach * max(high - low, how.least_spread)
                out.append(Band(size, low - room, high + room))
    return out


def test_limits_like_plain_quartiles(table):
    found = bands.learn(table, how=HOW)
    texts = [r["text"] for r in table.collect()]
    expected = plain_limits(texts, HOW, Bands())
    for mine, other in zip((*found.whole, *found.chunk), expected, strict=True):
        assert mine.size == other.size and (mine.low, mine.high) == pytest.approx((other.low, other.high))


def test_planted_texts_are_rejected_and_prose_is_kept(table):
    rows = {r["doc_id"]: r for r in bands.compression_bands(table, bands.learn(table, how=HOW)).collect()}
    for i, (_, size) in enumerate(planted(), 1000):
        assert not rows[i]["base_failed"] and not rows[i]["kept"], (i, size, rows[i]["share"])
    kept = [rows[i]["kept"] for i in range(len(prose()))]
    assert sum(kept) >= 0.98 * len(kept)
    assert rows[2000]["base_failed"] and rows[2001]["base_failed"] and not rows[2001]["kept"]


def test_verdict_like_a_plain_one(table):
    model = bands.learn(table, how=HOW)
    pack = bands.compressor(model)
    for r in bands.compression_bands(table, model).collect():
        raw = (r["text"] or "").encode()
        fits = True
        if len(raw) >= 256:
            own = [b for b in model.whole if len(raw) >= b.size][-1]
            outside = []
            if len(raw) > 4096:
                for at in range(0, len(raw), 4096):
                    part = raw[at : at + 4096]
                    if len(part) >= 1024:
                        limit = [b for b in model.chunk if len(part) >= b.size][-1]
                        outside.append(not limit.low <= len(pack.compress(part)) / len(part) <= limit.high)
            share = sum(outside) / len(outside) if outside else 0.0
            fits = own.low <= len(pack.compress(raw)) / len(raw) <= own.high and share <= model.chunks_outside
            assert r["chunks_outside"] == share
        assert r["kept"] == (fits and not r["base_failed"])


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    found = bands.learn(none)
    assert [(b.low, b.high) for b in found.whole[:2]] == [(b.low, b.high) for b in (Bands().whole[0], Bands().whole[0])]
    assert bands.compression_bands(none, found).count() == 0
