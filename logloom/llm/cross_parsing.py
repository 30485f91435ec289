"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of labelled text. A text is parsed against
it: every phrase is the longest match from where the last phrase ended. ``n``
symbols in ``c`` phrases against ``N`` symbols of labelled text cost
``c * log2(N) / n`` bits a symbol; the language with the fewest wins.

The automata are fitted on the driver on a bounded sample: per language at most
``sample_rows`` distinct labelled texts (the first by hash, whatever their
length), of each the first ``sample_chars`` characters from its first letter on,
of which ``train_symbols`` symbols are used. So every language that has a
labelled text with a letter is learned.
They are dense tables, walked with numpy for many text segments and all
languages in step. Whole texts are parsed. A text is cut into segments of
``SEGMENT`` symbols that are parsed on their own and their phrases added up,
which adds at most one phrase a segment.

Defined results: a null text or one without a letter is ``und`` with score 0,
and so is every text if nothing was learned. A tie goes to the smaller language
name. Letters outside the learned alphabet are phrases of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import annotate, field

SEGMENT = 1024
UNDETERMINED = "und"
SPACE, OTHER = 0, 1
COUNTED = 1 << 30
OUTPUT = [field("lang_pred", "string"), field("score", "double")]
# The evidence that counts towards the score, in symbols.
SCORE_SYMBOLS = 32


@dataclass(frozen=True)
class Fit:
    sample_rows: int = 256
    sample_chars: int = 4000  # of each chosen text; longer ones give a piece of this length
    train_symbols: int = 24_000


@dataclass(frozen=True)
class Model:
    languages: list[str]
    sizes: np.ndarray  # learned symbols of each language
    letters: np.ndarray  # code points of the alphabet, sorted; symbol = index + 2
    table: np.ndarray  # next state times the alphabet, with COUNTED where a phrase ends
    roots: np.ndarray


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


_ALPHA: list[np.ndarray] = []


def alphabetic(points: np.ndarray) -> np.ndarray:
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _ALPHA[0][points]


def squeeze(points: np.ndarray) -> np.ndarray:
    """Letters stay; each run of anything else becomes one space."""
    is_letter = alphabetic(points)
    out = np.where(is_letter, points, np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    return out[keep]


def automaton(symbols: np.ndarray, width: int) -> np.ndarray:
    """Transitions of the suffix automaton, -1 where there is none; state 0 is the start."""
    n = len(symbols)
    step = np.full((2 * n + 2, width), -1, np.int32)
    link, length = [-1] * (2 * n + 2), [0] * (2 * n + 2)
    size, last = 1, 0
    for s in symbols.tolist():
        new, size = size, size + 1
        length[new] = length[last] + 1
        p = last
        while p >= 0 and step[p, s] < 0:
            step[p, s] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = int(step[p, s])
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy, size = size, size + 1
                length[copy] = length[p] + 1
                step[copy] = step[q]
                link[copy] = link[q]
                while p >= 0 and step[p, s] == q:
                    step[p, s] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step[:size]


def fit(texts: dict[str, list[str]], how: Fit = Fit()) -> Model:
    learned = {}
    for lang in sorted(texts):
        parts = [squeeze(code_points(t + " ")) for t in texts[lang]]
        joined = np.concatenate(parts)[: how.train_symbols] if parts else np.zeros(0, np.uint32)
        if len(joined):
            learned[lang] = joined
    letters = np.unique(np.concatenate([*learned.values(), np.zeros(0, np.uint32)]))
    letters = letters[letters != 32]
    width = len(letters) + 2
    tables, roots, base = [], [], 0
    for symbols in learned.values():
        step = automaton(to_symbols(symbols, letters), width).astype(np.int64)
        # The last state stands after a symbol that the language lacks: the next one starts a phrase.
        lost = len(step)
        again = np.where(step[0] >= 0, step[0], lost)
        new_phrase = ((again + base) * width | COUNTED)[None, :]
        inside = np.where(step >= 0, (step + base) * width, new_phrase)
        inside[0] = (again + base) * width
        step = np.concatenate((inside, new_phrase))
        tables.append(step.astype(np.int32).ravel())
        roots.append(base * width)
        base += len(step)
    if base * width >= COUNTED:
        raise ValueError("lower train_symbols: the automata do not fit into one table")
    table = np.concatenate([*tables, np.zeros(0, np.int32)])
    return Model(list(learned), np.array([len(x) for x in learned.values()], float), letters, table, np.array(roots, np.int32))


def to_symbols(points: np.ndarray, letters: np.ndarray) -> np.ndarray:
    at = np.searchsorted(letters, points)
    known = letters[np.minimum(at, len(letters) - 1)] == points if len(letters) else np.zeros(len(points), bool)
    return np.where(points == 32, SPACE, np.where(known, at + 2, OTHER)).astype(np.int32)


def phrases(model: Model, docs: list[np.ndarray]) -> np.ndarray:
    """Phrases of each text (rows) in each language (columns)."""
    counts = np.zeros((len(docs), len(model.languages)), np.int64)
    owner = np.repeat(np.arange(len(docs)), [-(-len(d) // SEGMENT) for d in docs])
    cut = [d[i : i + SEGMENT] for d in docs for i in range(0, len(d), SEGMENT)]
    if not cut:
        return counts
    sizes = np.array([len(c) for c in cut])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    grid = np.zeros((len(cut), SEGMENT), np.int32)
    for row, k in enumerate(order):
        grid[row, : len(cut[k])] = cut[k]
    grid = np.ascontiguousarray(grid.T)
    state = np.repeat(model.roots[:, None], len(cut), axis=1)
    found = np.ones(state.shape, np.int32)
    for i in range(int(sizes[0])):
        n = int(np.searchsorted(-sizes, -i, side="left"))  # segments longer than i
        value = model.table[state[:, :n] + grid[i, :n]]
        found[:, :n] += value >> 30
        state[:, :n] = value & (COUNTED - 1)
    np.add.at(counts, owner[order], found.T)
    return counts


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    points = [squeeze(code_points(t or "")) for t in texts]
    full = [i for i, p in enumerate(points) if len(p)]
    lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if not full or not model.languages:
        return lang, score
    docs = [to_symbols(points[i], model.letters) for i in full]
    n = np.array([len(d) for d in docs], float)
    bits = phrases(model, docs) * np.log2(model.sizes + 1)[None, :] / n[:, None]
    best = bits.argmin(axis=1)
    gap = (bits - bits.min(axis=1, keepdims=True)) * np.minimum(n, SCORE_SYMBOLS)[:, None]
    sure = 1 / np.exp2(-gap).sum(axis=1)
    for k, i in enumerate(full):
        lang[i], score[i] = model.languages[best[k]], float(sure[k])
    return lang, score


def learn(docs: DataFrame, may_learn: Column, how: Fit = Fit(), text: str = "text", lang: str = "lang") -> Model:
    """Fit on rows where ``may_learn`` holds; what reaches the driver is bounded by ``how``."""
    piece = F.substring(F.regexp_replace(text, r"^\P{L}++", ""), 1, how.sample_chars)
    able = (
        docs.where(may_learn & F.col(lang).isNotNull())
        .select(F.col(lang).alias("lang"), piece.alias("text"), F.xxhash64(text).alias("mixed"))
        .where("text <> ''")
    )
    # The hashes are ranked first, so copies and long texts are not carried through the window.
    chosen = (
        able.select("lang", "mixed")
        .distinct()
        .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("mixed")))
        .where(F.col("place") <= how.sample_rows)
    )
    rows = (
        able.join(chosen, ["lang", "mixed"])
        .groupBy("lang", "place")
        .agg(F.min("text").alias("text"))
        .orderBy("lang", "place")
        .collect()
    )
    texts: dict[str, list[str]] = {}
    for row in rows:
        texts.setdefault(row["lang"], []).append(row["text"])
    return fit(texts, how)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return annotate(docs, lambda: lambda texts: predict(shared.value, texts), OUTPUT, text)
