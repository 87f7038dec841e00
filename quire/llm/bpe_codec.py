"""Operator 1: byte-level BPE encoding and decoding by two-tier lookup.

A pre-token that is itself a vocabulary entry is found by a minimal perfect hash: a
bucket's displacement gives the key a slot of its own among exactly as many slots as
there are entries, and the entry's bytes confirm it. Any other pre-token is merged from
its bytes: neighbours are linked, a heap gives the pair of lowest rank, leftmost first.
"""

from __future__ import annotations

import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from quire.llm.common import map_texts
from quire.llm.vocabulary import Vocabulary, splitter

_MASK = (1 << 64) - 1
_KEYS_PER_BUCKET = 3
#: Pre-tokens a worker remembers; when full it starts anew. Does not change results.
REMEMBERED = 400_000


def _slot(h: int, displacement: int, n: int) -> int:
    x = (h ^ (displacement * 0x9E3779B97F4A7C15)) & _MASK
    return ((x * 0xBF58476D1CE4E5B9 & _MASK) >> 24) % n


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: n keys, n slots."""

    def __init__(self, keys: list[bytes]):
        self.n, self.seed = len(keys), 0
        while not self._place(keys):
            self.seed += 1

    def _place(self, keys: list[bytes]) -> bool:
        n = self.n
        self.buckets = max(1, n // _KEYS_PER_BUCKET)
        held: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(key, self.seed)
            held[h % self.buckets].append((h, i))
        self.displacement = [0] * self.buckets
        self.key_at = [-1] * n
        single = []
        for b in sorted(range(self.buckets), key=lambda b: -len(held[b])):
            if len(held[b]) == 1:
                single.append(b)
            elif held[b]:
                if len({h for h, _ in held[b]}) < len(held[b]):
                    return False
                for d in range(1 << 24):
                    slots = [_slot(h, d, n) for h, _ in held[b]]
                    if len(set(slots)) == len(slots) and all(self.key_at[s] < 0 for s in slots):
                        break
                else:
                    return False
                self.displacement[b] = d
                for s, (_, i) in zip(slots, held[b], strict=True):
                    self.key_at[s] = i
        free = (s for s in range(n) if self.key_at[s] < 0)
        for b in single:  # a lone key takes any free slot, written as its negative
            s = next(free)
            self.displacement[b], self.key_at[s] = -s - 1, held[b][0][1]
        return True

    def index(self, key: bytes) -> int:
        """The one key index that ``key`` can have; the caller compares the keys."""
        h = xxhash.xxh3_64_intdigest(key, self.seed)
        d = self.displacement[h % self.buckets]
        return self.key_at[-d - 1 if d < 0 else _slot(h, d, self.n)]


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.tokens = vocabulary.tokens
        self.ids = [i for i, t in enumerate(self.tokens) if t]
        self.keys = [self.tokens[i] for i in self.ids]
        self.whole = PerfectHash(self.keys)
        self.pattern = vocabulary.pattern
        self._ready()

    def _ready(self) -> None:
        self.ranks = dict(zip(self.keys, self.ids, strict=True))
        self.split = splitter(self.pattern)
        self.memory: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("ranks", "split", "memory", "keys")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.keys = [self.tokens[i] for i in self.ids]
        self._ready()

    def piece(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        at = self.whole.index(piece)
        return (self.ids[at],) if self.keys[at] == piece else self.merged(piece)

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Merge linked bytes; a node is named by its first byte, ``after`` gives the next node's, -1 once swallowed."""
        n, rank = len(piece), self.ranks.get
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = after[i]
            if middle < 0 or middle >= n or after[middle] != end:
                continue
            after[i], after[middle] = end, -1
            if end < n:
                before[end] = i
                if (r := rank(piece[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (left := before[i]) >= 0 and (r := rank(piece[left:end])) is not None:
                heapq.heappush(heap, (r, left, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        memory, pieces = self.memory, self.split(text)
        try:
            return list(chain.from_iterable([memory[p] for p in pieces]))
        except KeyError:
            pass
        if len(memory) > REMEMBERED:
            memory.clear()
        for p in pieces:
            if p not in memory:
                memory[p] = self.piece(p.encode())
        return list(chain.from_iterable([memory[p] for p in pieces]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


_CODECS: dict[str, Codec] = {}


def _codec(broadcast) -> Codec:
    """One codec a worker: its memory of pre-tokens outlives the task."""
    digest, codec = broadcast.value
    return _CODECS.setdefault(digest, codec)


def _sent(df: DataFrame, vocabulary: Vocabulary):
    digest = xxhash.xxh3_128_hexdigest(b"\0".join(vocabulary.tokens) + vocabulary.pattern.encode())
    if digest not in _CODECS:
        _CODECS[digest] = Codec(vocabulary)
    return df.sparkSession.sparkContext.broadcast((digest, _CODECS[digest]))  # bounded by the vocabulary


def encode_documents(df: DataFrame, vocabulary: Vocabulary, keys: list[str], text: str = "text") -> DataFrame:
    """Ids of every whole text and the bytes that they decode to.

    Returns the key columns, ``ids`` (array<int>) and ``decoded`` (binary). A null text
    counts as empty and gives no ids. Repeated rows give repeated rows, an empty table an
    empty one. Other columns are not read, whatever their names; key columns named ``ids``
    or ``decoded`` are refused. No shuffle; a long text stays one row.
    """
    sent = _sent(df, vocabulary)

    def make():
        codec = _codec(sent)

        def work(texts: list[str]) -> list:
            ids = [codec.encode(t) for t in texts]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), [codec.decode(x) for x in ids]]

        return work

    return map_texts(df, keys, text, {"ids": "array<int>", "decoded": "binary"}, make)
