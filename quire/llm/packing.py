"""Operator 7: cost-balanced packing of token sequences.

Documents are tokenised once. Full-length pieces are sequences of their own, numbered where
they arise; only the rests are shuffled, to packing groups of bounded size. In a group, pieces in descending cost (linear plus
quadratic in length, as attention inside a document costs) go to the sequence of lowest
cost that still has room. A group opens as many sequences as its tokens need; a piece that
fits nowhere whole is cut, so only a group's last room stays empty.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import keyed_texts, slices, stored
from quire.llm.vocabulary import Vocabulary

CAPACITY = 1024
END = 0
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n; equal at 1,024 tokens.
LINEAR, QUADRATIC = 1024.0, 1.0
#: Rests of a packing group on average.
GROUP_RESTS = 1024
#: White space of this length or more is encoded apart: the library's pattern backtracks over it.
LONG_SPACE = re.compile(r"\s{4096,}")
#: Sequence ids of full pieces start here, above those of groups; a task numbers its rows from its partition << ROW_BITS.
FULL, ROW_BITS = 1 << 62, 36

_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Encodes as the tokenizers library does for a byte-level BPE file whose ids are its merge ranks (checked), whatever the text's length."""

    def __init__(self, vocabulary: Vocabulary):
        if any(a >= c or b >= c for a, b, c in vocabulary.merges) or any(x[2] >= y[2] for x, y in zip(vocabulary.merges, vocabulary.merges[1:])):
            raise ValueError("ids do not follow the ranks of the merges")
        ranks = {t: i for i, t in enumerate(vocabulary.tokens) if t}
        self.library = tiktoken.Encoding("file", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens=dict(vocabulary.added))
        self.added = dict(vocabulary.added)
        self.around = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def encode(self, text: str) -> np.ndarray:
        if not LONG_SPACE.search(text):
            return self.library.encode_to_numpy(text, allowed_special="all")
        parts = self.around.split(text) if self.around else [text]
        return np.concatenate([np.array([self.added[p]], np.uint32) if i % 2 else self._spaced(p) for i, p in enumerate(parts)])

    def _spaced(self, text: str) -> np.ndarray:
        """A run of white space is one pre-token without its last character, which the pattern leaves to what follows."""
        made, at = [], 0
        for run in LONG_SPACE.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            made += [self.library.encode_to_numpy(text[at : run.start()], disallowed_special=()), np.array(self.library._encode_single_piece(text[run.start() : end].encode()), np.uint32)]
            at = end
        return np.concatenate([*made, self.library.encode_to_numpy(text[at:], disallowed_special=())])


def _encoder(sent, digest: str) -> Encoder:
    if digest not in _ENCODERS:
        _ENCODERS[digest] = Encoder(sent.value)
    return _ENCODERS[digest]


def piece_cost(length) -> float:
    return LINEAR * length + QUADRATIC * length * length


def assign(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) of one group; each item is shorter than ``capacity``.

    Ties go to the earlier item and the lower sequence. No token is left out.
    """
    count = -(-sum(lengths) // capacity)
    cost, room = np.zeros(count), np.full(count, capacity, np.int64)
    out = []

    def put(item: int, start: int, length: int, at: int) -> None:
        out.append((item, start, length, at, capacity - int(room[at])))
        room[at] -= length
        cost[at] += piece_cost(length)

    late = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if not lengths[item]:
            continue
        open_cost = np.where(room >= lengths[item], cost, np.inf)
        at = int(open_cost.argmin())
        if np.isfinite(open_cost[at]):
            put(item, 0, lengths[item], at)
        else:
            late.append(item)
    for item in late:  # cut over the largest rooms, lowest cost first among equals
        start = 0
        while start < lengths[item]:
            at = int(np.lexsort((cost, -room))[0])
            length = min(lengths[item] - start, int(room[at]))
            put(item, start, length, at)
            start += length
    return out


PIECE = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack_documents(df: DataFrame, vocabulary: Vocabulary, key: str, text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: key, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` (long), and ``ids`` (binary) if asked for.

    A document is its ids and then id 0; a null or empty text is that one id. ``ids`` and the
    checksum are little-endian unsigned 32-bit. Sequence ids have gaps: full pieces are
    numbered by task, others by group. Repeated rows are documents of their own under one
    key and are dealt to groups like others; a null key is kept. An empty table gives an
    empty one. Other columns are not read; a key named like a result is refused. One
    shuffle, of the rests' ids only; a group has about GROUP_RESTS rests, each shorter than a sequence.
    """
    names = [f.name for f in PIECE] + ["ids"]
    source = keyed_texts(df, [key], text, [*names, "row", "group"])
    digest = xxhash.xxh3_128_hexdigest(b"\0".join(vocabulary.tokens) + repr((vocabulary.pattern, vocabulary.added)).encode())
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the vocabulary
    key_type = source.schema[key]
    mid = T.StructType([key_type, *(T.StructField(n, T.LongType()) for n in ("row", "start", "length", "ids_crc32", "doc_tokens")), T.StructField("ids", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = _encoder(sent, digest), TaskContext.get().partitionId() << ROW_BITS
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                at, rows = [], []
                for i in range(a, b):
                    ids = np.append(coder.encode(texts[i]), END).astype("<u4")
                    for start in range(0, len(ids), capacity):
                        piece = ids[start : start + capacity]
                        data = piece.tobytes()
                        at.append(i)
                        rows.append((row, start, len(piece), zlib.crc32(data), len(ids), data if with_ids or len(piece) < capacity else None))
                        row += 1
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.binary()], strict=True))], names=[f.name for f in mid])

    pieces = stored(source.mapInArrow(cut, mid))
    full, rests = pieces.filter(F.col("length") == capacity), pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-rests.count() // GROUP_RESTS))
    out_schema = T.StructType([key_type, *PIECE, *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    columns_out = [f.name for f in out_schema]

    def pack(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("row").to_numpy(), kind="stable")
        group = group.take(pa.array(order))
        start, length, tokens, whole = (group.column(n).to_numpy() for n in ("start", "length", "doc_tokens", "ids_crc32"))
        ids = group.column("ids").to_pylist()
        base = group.column("group")[0].as_py() << 32
        placed = assign(length.tolist(), capacity)
        rows = []
        for i, s, n, at, o in placed:
            piece = ids[i] if n == length[i] else ids[i][4 * s : 4 * (s + n)]
            rows.append((int(start[i]) + s, n, int(whole[i]) if n == length[i] else zlib.crc32(piece), int(tokens[i]), base + at, o, piece))
        columns = [pa.array(c) for c in zip(*rows, strict=True)]
        taken = group.column(key).combine_chunks().take(pa.array([p[0] for p in placed]))
        return pa.Table.from_arrays([taken, *columns[: 6 + with_ids]], names=columns_out)

    packed = rests.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy("group").applyInArrow(pack, out_schema)
    own = full.withColumn("sequence_id", F.col("row") + F.lit(FULL)).withColumn("offset", F.lit(0).cast("long")).select(columns_out)
    return packed.unionByName(own)
