"""Quality rules by compression bands.

The share ``compressed size / size`` under zstandard is taken over the whole
text and over fixed chunks of it. Repetitive text has a low share,
incompressible text a high one. What is normal depends on the length, so each
band of lengths has limits of its own, and so has each size of chunks (the last
chunk of a text is shorter).

``learn`` takes the limits from the corpus: one pass counts the shares of all
texts that pass the base rule, per band in steps of a thousandth. The limits lie
``reach`` spreads beyond the quartiles, the usual bound for values that are far
out; the spread is the distance of the quartiles. A band with few texts keeps the
limits that were given.

Defined results: null and empty texts have no words, hence fail the base rule
and are not kept. Texts below the first band have no share (null) and the
bands say nothing about them. Rows are independent; repeated rows get equal
results, an empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import annotate, field

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Limits of the share for texts of at least ``size`` bytes."""

    size: int
    low: float
    high: float


@dataclass(frozen=True)
class Bands:
    whole: tuple[Band, ...] = (
        Band(256, 0.30, 0.98),
        Band(1 << 10, 0.25, 0.90),
        Band(4 << 10, 0.22, 0.85),
        Band(16 << 10, 0.18, 0.80),
        Band(64 << 10, 0.15, 0.78),
    )
    chunk_bytes: int = 4096
    chunk: tuple[Band, ...] = (Band(1 << 10, 0.22, 0.88),)
    # The largest part of a text's chunks that may lie outside the limits.
    chunks_outside: float = 0.25
    level: int = 3


@dataclass(frozen=True)
class Fit:
    """How limits are learned."""

    sizes: tuple[int, ...] = tuple(256 << k for k in range(11))  # where bands begin: 256 bytes to 256 KB
    chunk_sizes: tuple[int, ...] = (1 << 10, 2 << 10, 4 << 10)
    reach: float = 3.0
    least_spread: float = 0.01
    least_texts: int = 50  # a band with fewer texts (or chunks) is not learned


STEPS = 1000  # of a share of 1, in the histogram

OUTPUT = [
    field("n_words", "long"),
    field("word_chars", "long"),
    field("n_symbols", "long"),
    field("n_dup_lines", "long"),
    field("n_repeat_words", "long"),
    field("base_failed", "boolean"),
    field("kept", "boolean"),
    field("share", "double"),
    field("chunks_outside", "double"),
]


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words inside a window of ``width`` words that occurs at least twice in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    key = ids[:n]
    for k in range(1, width):
        # Ranks keep the key small whatever the width and the vocabulary.
        if k > 1:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(known) + ids[k : n + k]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[width : n + width] -= twice
    return int(np.count_nonzero(np.cumsum(edge)))


def dup_lines(raw: bytes) -> int:
    lines = [line for line in raw.split(b"\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def limits(bands: tuple[Band, ...], size: int) -> Band | None:
    return next((b for b in reversed(bands) if size >= b.size), None)


def share_of(raw: bytes, pack: zstandard.ZstdCompressor) -> float:
    return len(pack.compress(raw)) / len(raw)


def chunks(raw: bytes, bands: Bands) -> Iterator[bytes]:
    """The chunks of a text of more than one, without a last one that is too short to say anything."""
    if len(raw) > bands.chunk_bytes:
        for at in range(0, len(raw), bands.chunk_bytes):
            part = raw[at : at + bands.chunk_bytes]
            if len(part) >= bands.chunk[0].size:
                yield part


def shares(raw: bytes, bands: Bands, pack: zstandard.ZstdCompressor) -> tuple[float | None, float, bool]:
    """Share of the whole text, part of its chunks outside the limits, and the verdict."""
    band = limits(bands.whole, len(raw))
    if band is None:
        return None, 0.0, True
    share = share_of(raw, pack)
    outside = number = 0
    for part in chunks(raw, bands):
        own = limits(bands.chunk, len(part))
        number += 1
        outside += not own.low <= share_of(part, pack) <= own.high
    part_outside = outside / number if number else 0.0
    return share, part_outside, band.low <= share <= band.high and part_outside <= bands.chunks_outside


def fails_base(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def judge(text: str | None, bands: Bands, pack: zstandard.ZstdCompressor) -> tuple:
    raw = (text or "").encode()
    words = raw.split()  # bytes.split knows exactly the six white-space bytes
    spaces = len(raw) - len(raw.translate(None, SPACES))
    repeats = repeat_words(words)
    failed = fails_base(len(words), repeats)
    share, outside, fits = shares(raw, bands, pack)
    return (
        len(words),
        len(text or "") - spaces,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        dup_lines(raw),
        repeats,
        failed,
        fits and not failed,
        share,
        outside,
    )


def compressor(bands: Bands) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=bands.level, write_checksum=False, write_content_size=False)


def histogram(docs: DataFrame, bands: Bands, text: str) -> DataFrame:
    """Shares of the texts that pass the base rule: (kind of band, its number, step, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, found = compressor(bands), Counter()
        for batch in batches:
            for value in batch.column(0):
                raw = (value.as_py() or "").encode()
                words = raw.split()
                if len(raw) < bands.whole[0].size or fails_base(len(words), repeat_words(words)):
                    continue
                for kind, own, parts in ((0, bands.whole, (raw,)), (1, bands.chunk, chunks(raw, bands))):
                    for part in parts:
                        number = sum(len(part) >= b.size for b in own) - 1
                        found[kind, number, round(STEPS * share_of(part, pack))] += 1
        rows = [(*key, n) for key, n in found.items()]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["kind", "band", "step", "n"])

    found = docs.select(F.col(text)).mapInArrow(run, "kind long, band long, step long, n long")
    return found.groupBy("kind", "band", "step").agg(F.sum("n").alias("n"))


def quartiles(steps: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Shares that a quarter and three quarters of the counted texts do not exceed."""
    order = np.argsort(steps)
    below = np.cumsum(counts[order])
    at = [np.searchsorted(below, part * below[-1]) for part in (0.25, 0.75)]
    return tuple(float(steps[order][k]) / STEPS for k in at)


def learn(docs: DataFrame, bands: Bands = Bands(), how: Fit = Fit(), text: str = "text") -> Bands:
    """``bands`` with limits from all rows; what reaches the driver is a histogram of at most some 15,000 cells."""

    def given(own: tuple[Band, ...], sizes: tuple[int, ...]) -> tuple[Band, ...]:
        return tuple(replace(limits(own, size) or own[0], size=size) for size in sizes)

    cut = replace(bands, whole=given(bands.whole, how.sizes), chunk=given(bands.chunk, how.chunk_sizes))
    cells = np.array([tuple(r) for r in histogram(docs, cut, text).collect()], np.int64).reshape(-1, 4)

    def fitted(kind: int, own: tuple[Band, ...]) -> tuple[Band, ...]:
        out = []
        for number, band in enumerate(own):
            at = cells[(cells[:, 0] == kind) & (cells[:, 1] == number)]
            if at[:, 3].sum() >= how.least_texts:
                low, high = quartiles(at[:, 2], at[:, 3])
                room = how.reach * max(high - low, how.least_spread)
                band = replace(band, low=low - room, high=high + room)
            out.append(band)
        return tuple(out)

    return replace(cut, whole=fitted(0, cut.whole), chunk=fitted(1, cut.chunk))


def compression_bands(docs: DataFrame, bands: Bands = Bands(), text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``OUTPUT``; no shuffle."""

    def start():
        pack = compressor(bands)
        return lambda texts: list(zip(*[judge(t, bands, pack) for t in texts], strict=True))

    return annotate(docs, start, OUTPUT, text)
