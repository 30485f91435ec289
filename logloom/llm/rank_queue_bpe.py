"""Byte-level BPE by a rank queue under a hierarchical bitmap.

All pre-tokens of a slice of texts that are not known yet stand in one linked
list of parts, single bytes at first; links end at a pre-token's border. Every
adjacent pair that the ranks know waits in the bucket of its rank. A bitmap of
three levels of 64-bit words says which buckets hold anything, so the lowest
rank comes from three find-first-set steps however long the list is. A bucket
is merged as a whole with numpy, from left to right where its pairs overlap;
entries whose pair has changed since they were queued are skipped. Merging a
whole bucket equals merging its positions one by one unless a merge makes a
pair of lower rank while its pre-token has more positions in the bucket; such a
pre-token is encoded again with one position at a time. A pre-token of n bytes
takes O(n log n) steps.

Defined results: null text counts as empty and has no ids. Special tokens are
ordinary text. The ids of distinct pre-tokens are kept in a two-generation
cache of bounded size, which only saves time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import annotate, field

OUTPUT = [field("n_tokens", "long"), field("ids_sha256", "string"), field("decoded_sha256", "string")]
CACHED = 250_000
CACHED_CHARS = 64  # longer pre-tokens are encoded again in each slice


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def latin_pattern(pattern: str) -> str:
    """The same pattern with its classes written out for the first 256 code points."""
    named = {
        name: "".join(re.escape(chr(c)) for c in range(256) if regex.match(name, chr(c)))
        for name in (r"\p{L}", r"\p{N}", r"\s")
    }

    def plain(found: re.Match) -> str:
        part = found[0]
        if part == r"\S":
            return f"[^{named[r'\s']}]"
        if part in named:
            return f"[{named[part]}]"
        for name, members in named.items():
            part = part.replace(name, members)
        return part

    return re.sub(r"\[\^?[^\]]*\]|\\p\{[LN]\}|\\[sS]", plain, pattern)


class RankQueue:
    """Positions by rank, in no order; a bucket is a list of whatever is put in."""

    def __init__(self) -> None:
        self.buckets: dict[int, list] = {}
        self.top = 0
        self.middle: dict[int, int] = {}
        self.low: dict[int, int] = {}

    def put(self, rank: int, positions: list) -> None:
        """Queue positions under a rank whose bucket is empty."""
        self.buckets[rank] = positions
        word, group = rank >> 6, rank >> 12
        self.low[word] = self.low.get(word, 0) | 1 << (rank & 63)
        self.middle[group] = self.middle.get(group, 0) | 1 << (word & 63)
        self.top |= 1 << group

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Queue one array of positions for each rank that occurs."""
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        starts = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
        buckets = self.buckets
        for rank, a, b in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)], strict=True):
            bucket = buckets.get(rank)
            if bucket is None:
                self.put(rank, [positions[a:b]])
            else:
                bucket.append(positions[a:b])

    def lowest(self) -> int:
        """The lowest rank that waits, -1 if none does."""
        if not self.top:
            return -1
        group = (self.top & -self.top).bit_length() - 1
        bits = self.middle[group]
        word = group << 6 | (bits & -bits).bit_length() - 1
        bits = self.low[word]
        return word << 6 | (bits & -bits).bit_length() - 1

    def take(self, rank: int) -> list:
        """Empty a bucket."""
        word, group = rank >> 6, rank >> 12
        self.low[word] ^= 1 << (rank & 63)
        if not self.low[word]:
            self.middle[group] ^= 1 << (word & 63)
            if not self.middle[group]:
                self.top ^= 1 << group
        return self.buckets.pop(rank)


class Merges:
    """The pairs of a vocabulary: which two tokens join to which."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.bytes < 0).any():
            raise ValueError("the vocabulary lacks some single bytes")
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is none."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], -1)


def encode_one(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token, merged one position at a time."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair = [-1] * n
    queue = RankQueue()

    def look(i: int) -> None:
        rank = ranks.get(piece[i : after[after[i]]]) if after[i] < n else None
        pair[i] = -1 if rank is None else rank
        if rank in queue.buckets:
            heappush(queue.buckets[rank], i)
        elif rank is not None:
            queue.put(rank, [i])

    for i in range(n - 1):
        look(i)
    while (rank := queue.lowest()) >= 0:
        i = heappop(queue.buckets[rank])
        if not queue.buckets[rank]:
            queue.take(rank)
        if pair[i] != rank:
            continue
        pair[after[i]] = -1
        after[i] = after[after[i]]
        if after[i] < n:
            before[after[i]] = i
        look(i)
        if before[i] >= 0:
            look(before[i])
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


def encode_pieces(pieces: list[bytes], merges: Merges) -> list[list[int]]:
    """Ids of each non-empty pre-token."""
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes)
    part = merges.bytes[np.frombuffer(b"".join(pieces), np.uint8)]  # token at a part's first position
    n = len(part)
    after = np.arange(1, n + 1)  # the next part, -1 at the end of a pre-token
    after[ends - 1] = -1
    before = np.arange(-1, n - 1)
    before[ends - sizes] = -1
    live = np.ones(n, bool)
    one_by_one: set[int] = set()
    pair = np.full(n, -1, np.int64)  # rank of the pair that starts here
    inner = np.flatnonzero(after >= 0)
    pair[inner] = merges.pair_ranks(part[inner], part[inner + 1])
    queue = RankQueue()
    waiting = np.flatnonzero(pair >= 0)
    queue.push(pair[waiting], waiting)
    while (rank := queue.lowest()) >= 0:
        at = np.concatenate(queue.take(rank))
        at = np.unique(at[pair[at] == rank])
        if len(at) > 1:
            # Of pairs that overlap in a run, every second one is merged.
            chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
            if chained.any():
                k = np.arange(len(at))
                at = at[(k - np.maximum.accumulate(np.where(chained, 0, k))) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        follow = after[gone]
        after[at] = follow
        live[gone] = False
        part[at] = rank
        pair[gone] = -1
        before[follow[follow >= 0]] = at[follow >= 0]
        left = before[at]
        touched = np.concatenate((at[follow >= 0], left[left >= 0]))
        pair[at] = -1
        if len(touched):
            made = merges.pair_ranks(part[touched], part[after[touched]])
            pair[touched] = made
            found = made >= 0
            if (made[found] < rank).any():
                owner = np.searchsorted(ends, at, side="right")
                lower = np.searchsorted(ends, touched[found & (made < rank)], side="right")
                one_by_one.update(lower[np.isin(lower, owner[1:][np.diff(owner) == 0])].tolist())
            queue.push(made[found], touched[found])
    kept = np.flatnonzero(live)
    cuts = np.searchsorted(kept, ends)
    ids = part[kept].tolist()
    out = [ids[a:b] for a, b in zip([0, *cuts.tolist()], cuts.tolist(), strict=False)]
    for k in one_by_one:
        out[k] = encode_one(pieces[k], merges.ranks)
    return out


class Coder:
    """Encodes and decodes texts with the ranks of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.merges = Merges(ranks)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.split_any = regex.compile(pattern).findall
        self.split_latin = re.compile(latin_pattern(pattern)).findall
        # Pre-token: number of ids, the ids as text, the bytes they decode to.
        self.young: dict[str, tuple[int, str, bytes]] = {}
        self.old: dict[str, tuple[int, str, bytes]] = {}

    def split(self, text: str) -> list[str]:
        """Pre-tokens; texts of the first 256 code points take the faster engine."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split_any(text)
        return self.split_latin(text)

    def parts(self, texts: list[str | None]) -> Iterator[list[tuple[int, str, bytes]]]:
        split = [self.split(text or "") for text in texts]
        known = self.old | self.young if self.old else self.young
        new = [p for p in set(chain.from_iterable(split)) if p not in known]
        raw = [p.encode("utf-8", "replace") for p in new]
        # A pre-token that is a token stays one, whatever its merges would give.
        whole = {p: [self.ranks[r]] for p, r in zip(new, raw, strict=True) if r in self.ranks}
        rest = [(p, r) for p, r in zip(new, raw, strict=True) if p not in whole]
        ids = encode_pieces([r for _, r in rest], self.merges) if rest else []
        fresh = {
            p: (len(i), " ".join(map(str, i)), b"".join([self.tokens[x] for x in i]))
            for p, i in chain(whole.items(), zip([p for p, _ in rest], ids, strict=True))
        }
        for pieces in split:
            yield [known[p] if p in known else fresh[p] for p in pieces]
        self.young.update((p, x) for p, x in fresh.items() if len(p) <= CACHED_CHARS)
        if len(self.young) >= CACHED:
            self.old, self.young = self.young, {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [[int(i) for part in parts for i in part[1].split()] for parts in self.parts(texts)]

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        out = []
        for parts in self.parts(texts):
            ids = " ".join([p[1] for p in parts]).encode()
            decoded = b"".join([p[2] for p in parts])
            out.append(
                (sum([p[0] for p in parts]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
            )
        return out


_CODERS: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """One coder a Python worker; the vocabulary is part of the executors' installation."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(read_ranks(path), pattern)
    return _CODERS[path, pattern]


def encode_digests(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``OUTPUT``; no shuffle."""

    def start():
        digests = coder(path, pattern).digests
        return lambda texts: list(zip(*digests(texts), strict=True))

    return annotate(docs, start, OUTPUT, text)


def encode_ids(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text as an array."""

    def start():
        encode = coder(path, pattern).encode
        return lambda texts: [encode(texts)]

    return annotate(docs, start, [field(ids, "array<int>")], text)


def decode_ids(df: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids stand for; null ids give null."""

    @F.pandas_udf("binary")
    def decode(column):
        tokens = coder(path, pattern).tokens
        return column.map(lambda x: None if x is None else b"".join([tokens[i] for i in x.tolist()]))

    return df.withColumn(text, decode(F.col(ids)))
