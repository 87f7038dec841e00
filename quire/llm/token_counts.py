"""Operator 6: token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a slice of documents that are not yet known are laid end to end in one
numpy array of symbols. In each round every sequence finds its pair of lowest rank and
applies it at all its places at once, from the left where they overlap; sequences without
a pair leave. What is left of a sequence is its number of tokens.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from quire.llm.common import map_texts
from quire.llm.vocabulary import Vocabulary, splitter

#: Pre-tokens a worker remembers; when full it starts anew. Does not change results.
REMEMBERED = 1_500_000
_NONE = np.int32(2**31 - 1)


class Counter:
    """Counts tokens as the tokenizers library does for a byte-level BPE file, added tokens' strings included."""

    def __init__(self, vocabulary: Vocabulary):
        left, right, made = (np.array(x, np.int64) for x in zip(*vocabulary.merges, strict=True))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made.astype(np.int64)
        self.symbol = np.zeros(256, np.int64)
        for i, token in enumerate(vocabulary.tokens):
            if len(token) == 1:
                self.symbol[token[0]] = i
        self.split = splitter(vocabulary.pattern)
        self.added = [s for s, _ in vocabulary.added]
        self.around = re.compile("|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.known: dict[str, int] = {}

    def sequences(self, pieces: list[bytes]) -> np.ndarray:
        """Number of symbols left of each non-empty byte string."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        out = lengths.copy()
        symbols = self.symbol[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        while len(symbols):
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(symbols), _NONE)
            good = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank[:-1][good] = self.ranks[at[good]]
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[start, len(symbols)])
            lowest = np.repeat(np.minimum.reduceat(rank, start), size)
            place = np.flatnonzero((rank == lowest) & (lowest < _NONE))
            if len(place):  # in a run of overlapping places every second one merges
                first = np.r_[True, place[1:] != place[:-1] + 1]
                index = np.arange(len(place))
                place = place[(index - np.maximum.accumulate(np.where(first, index, 0))) % 2 == 0]
            keep = lowest < _NONE
            symbols[place] = self.made[rank[place]]
            out -= np.bincount(owner[place], minlength=len(out))
            keep[place + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out

    def parts(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens and the number of added tokens of a text."""
        if self.around is None or not any(s in text for s in self.added):
            return self.split(text), 0
        rest = self.around.split(text)
        return [p for part in rest for p in self.split(part)], len(rest) - 1

    def counts(self, texts: list[str]) -> list[int]:
        parts = [self.parts(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = list({p for pieces, _ in parts for p in pieces if p not in known})
        if new:
            known.update(zip(new, self.sequences([p.encode() for p in new]).tolist(), strict=True))
        return [sum([known[p] for p in pieces]) + more for pieces, more in parts]


_COUNTERS: dict[str, Counter] = {}


def count_tokens(df: DataFrame, vocabulary: Vocabulary, keys: list[str], text: str = "text") -> DataFrame:
    """Number of tokens of every whole text, without begin or end tokens.

    Returns the key columns, ``n_bytes`` (UTF-8) and ``n_tokens``, both long. A null text
    counts as empty: 0 and 0. Repeated rows give repeated rows, an empty table an empty
    one. Other columns are not read; key columns named like the results are refused.
    No shuffle.
    """
    digest = xxhash.xxh3_128_hexdigest(b"\0".join(vocabulary.tokens) + repr((vocabulary.pattern, vocabulary.added)).encode())
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the vocabulary

    def make():
        if digest not in _COUNTERS:
            _COUNTERS[digest] = Counter(sent.value)
        counter = _COUNTERS[digest]
        return lambda texts: [[len(t.encode()) for t in texts], counter.counts(texts)]

    return map_texts(df, keys, text, {"n_bytes": "long", "n_tokens": "long"}, make)
