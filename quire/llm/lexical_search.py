"""Operator 13: ranked lexical search by presence masks.

One pass over the texts keeps, per document, its number of terms and the frequencies of
those terms that some item asks for. In a slice of documents every term of an item is a
bitmap; laid side by side they give each document a mask of the terms that it holds, and
the documents of an item fall into groups of equal mask. A mask's score is bounded by the
best frequency and length among its terms' holders. Groups are scored in the order of
falling bounds, until no group left can reach the item's k-th score so far.

Items come in blocks of bounded size, each against all documents; a task gives out k
documents an item at most.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quire.llm.common import keyed_texts, map_texts, stored

#: Bytes of item texts that go to the tasks at once, documents of a slice, cells of a slice's table for one item, documents scored together.
BLOCK_BYTES = 8 << 20
SLICE_DOCUMENTS = 4096
CELLS = 4 << 20
SCORED_TOGETHER = 256
#: Parts into which an item's results are dealt before the last cut.
PARTS = 64
#: Weight, frequency and length of the score, all but the logarithm in 64-bit integers.
SCALE, TIMES, LENGTH, BASE, SLOPE = 1_000_000_000, 1000, 20, 100, 50
# letters and digits of ASCII and all bytes of longer code points stand; A-Z become small, everything else a blank
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and code points from U+0080, A-Z lower-cased, as UTF-8."""
    return text.encode().translate(_TERMS).split()


def weight(documents: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holders + 1)))


def length_norm(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """100 - 50 + 50 * n * documents div total, exact for products beyond 64 bits too."""
    if int(n.max(initial=0)) * documents < (1 << 62) // SLOPE:
        return BASE - SLOPE + SLOPE * n * documents // total
    return np.array([BASE - SLOPE + SLOPE * int(x) * documents // total for x in n], np.int64)


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return SCALE * tf // (TIMES * tf + LENGTH * m)


@dataclass
class Best:
    """The k best (score, key) of one item so far, highest first; ties go to the smaller key, null keys last."""

    k: int
    rows: list

    def least(self) -> int:
        """Score that a further document must reach."""
        return self.rows[-1][0] if len(self.rows) >= self.k else 1

    def add(self, scores: np.ndarray, keys: list) -> None:
        self.rows += zip(scores.tolist(), keys, strict=True)
        self.rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))
        del self.rows[self.k :]


@dataclass(frozen=True)
class Slice:
    """Postings of some documents, ordered by term: ``docs`` and ``tf`` of term t are at ``starts[t]`` to ``starts[t + 1]``."""

    keys: list
    m: np.ndarray
    starts: np.ndarray
    docs: np.ndarray
    tf: np.ndarray

    @staticmethod
    def of(keys: list, m: np.ndarray, lengths: np.ndarray, ids: np.ndarray, tf: np.ndarray, vocabulary: int) -> Slice:
        order = np.argsort(ids, kind="stable")
        starts = np.searchsorted(ids[order], np.arange(vocabulary + 1))
        return Slice(keys, m, starts, np.repeat(np.arange(len(keys)), lengths)[order], tf[order].astype(np.int64))

    def search(self, asked: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Take this slice's documents into an item's best; returns how many were scored."""
        scored, step = 0, max(64, CELLS // max(1, len(asked)))
        for low in range(0, len(self.keys), step):
            scored += self._search(asked, weights, best, low, min(low + step, len(self.keys)))
        return scored

    def _search(self, asked: np.ndarray, weights: np.ndarray, best: Best, low: int, high: int) -> int:
        held = []
        for t in asked:
            a, b = self.starts[t], self.starts[t + 1]
            docs = self.docs[a:b]
            if high - low < len(self.keys):
                c, d = np.searchsorted(docs, [low, high])
                a, b, docs = a + c, a + d, docs[c:d]
            if len(docs) and weights[t] > 0:
                held.append((t, docs - low, self.tf[a:b]))
        if not held:
            return 0
        rows, width = high - low, len(held)
        tf = np.zeros((rows, width), np.int64)
        masks = np.zeros((rows, -(-width // 64)), np.uint64)
        bounds = np.zeros(width, np.int64)
        for j, (t, docs, times) in enumerate(held):
            masks[docs, j // 64] |= np.uint64(1 << (j % 64))
            tf[docs, j] = times
            bounds[j] = weights[t] * saturation(times.max(), self.m[low + docs].min())
        w = np.array([weights[t] for t, _, _ in held], np.int64)
        some = np.flatnonzero(masks.any(1))
        kinds, group = np.unique(masks[some], axis=0, return_inverse=True) if masks.shape[1] > 1 else np.unique(masks[some, 0], return_inverse=True)
        bits = np.unpackbits(np.ascontiguousarray(kinds).reshape(len(kinds), -1).view(np.uint8), axis=1, bitorder="little")[:, :width]
        most = bits.astype(np.int64) @ bounds
        order = np.argsort(-most, kind="stable")  # groups by falling bound
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ranked = some[np.argsort(place[group.ravel()], kind="stable")]
        ends, falling = np.cumsum(np.bincount(group.ravel(), minlength=len(kinds))[order]), most[order]
        at = done = 0
        while at < len(order) and falling[at] >= best.least():
            # groups until k documents are there, and more as long as they are few
            upto = min(max(int(np.searchsorted(ends, done + best.k)) + 1, int(np.searchsorted(ends, done + SCORED_TOGETHER, "right"))), len(order))
            upto = at + max(1, int((falling[at:upto] >= best.least()).sum()))
            docs = ranked[done : ends[upto - 1]]
            scores = (w * saturation(tf[docs], self.m[low + docs][:, None])).sum(1)
            good = scores >= best.least()
            if good.sum() > best.k:
                good &= scores >= np.partition(scores, len(scores) - best.k)[len(scores) - best.k]
            found = docs[good] + low
            best.add(scores[good], [self.keys[i] for i in found])
            at, done = upto, int(ends[upto - 1])
        return done


def counted(df: DataFrame, key: str, text: str, vocabulary: list[bytes]) -> DataFrame:
    """Per document its key, number of terms ``n`` and the places (``terms``) and frequencies (``tfs``) of the terms in a bounded vocabulary."""
    places = df.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def make():
        known = places.value

        def work(texts: list[str]) -> list:
            n, ids, tfs = [], [], []
            for text in texts:
                found = terms(text)
                n.append(len(found))
                times = Counter(known[t] for t in found if t in known)
                ids.append(list(times))
                tfs.append(list(times.values()))
            return [n, ids, tfs]

        return work

    return map_texts(df, [key], text, {"n": "long", "terms": "array<int>", "tfs": "array<long>"}, make)


def _blocks(items: DataFrame, item: str, text: str) -> Iterator[dict]:
    """Items and their distinct terms, in blocks of about BLOCK_BYTES of text; rows of one item are taken together."""
    source = items.select(F.col(item).alias("item"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    for b in range(blocks):
        found: dict = {}
        for row in source.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toLocalIterator():
            found.setdefault(row.item, set()).update(terms(row.text))
        yield {i: t for i, t in found.items() if t}


def rank_documents(documents: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", k: int = 50) -> DataFrame:
    """The ``k`` highest-scoring documents of each item: item, ``rank`` (int, from 1), key, ``score`` (long, above 0).

    Equal scores go by the smaller key; rows that repeat a key are documents of their own, and null
    keys come last. A null or empty text has no terms: such a document counts nowhere and
    matches nothing, and such an item has no result. Rows that repeat an item (null included) are one
    item with all their terms. A term that every document holds weighs nothing. Empty tables
    give an empty one. Texts are read whole; other columns are not read. A key named like
    a result is refused.
    """
    if {key, item} & {"rank", "score", "n", "terms", "tfs", "part"} or key == item:
        raise ValueError("key columns named like results")
    spark = documents.sparkSession
    keyed_texts(documents, [key], text, [])
    key_field, item_field = documents.schema[key], items.schema[item]
    schema = T.StructType([T.StructField(item, item_field.dataType), T.StructField(key, key_field.dataType), T.StructField("score", T.LongType())])
    parts = []
    for block in _blocks(items, item, text):
        vocabulary = sorted(set().union(*block.values()))
        place = {t: i for i, t in enumerate(vocabulary)}
        features = stored(counted(documents, key, text, vocabulary))
        count, total = features.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(vocabulary), np.int64)
        for row in features.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # the vocabulary's rows at most
            weights[row.t] = weight(count, row["count"])
        asked = spark.sparkContext.broadcast([(i, np.sort(np.array([place[t] for t in found], np.int64))) for i, found in block.items()])
        search = _searcher(asked, weights, count, total, k, schema)
        parts.append(features.filter(F.size("terms") > 0).select(key, "n", "terms", "tfs").mapInArrow(search, schema))
    if not parts:
        return spark.createDataFrame([], T.StructType([schema[0], T.StructField("rank", T.IntegerType()), *schema[1:]]))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    order = [F.desc("score"), F.col(key).asc_nulls_last()]
    dealt = found.withColumn("part", F.pmod(F.xxhash64(key), F.lit(PARTS)))
    dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(item, "part").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(item).orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select(item, F.col("rank").cast("int").alias("rank"), key, "score")


def _searcher(asked, weights: np.ndarray, count: int, total: int, k: int, schema: T.StructType):
    names, item_type = [f.name for f in schema], to_arrow_type(schema[0].dataType)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k, []) for _ in asked.value]
        kinds = None
        for batch in batches:
            kinds = batch.schema.field(0).type
            for low in range(0, batch.num_rows, SLICE_DOCUMENTS):
                part = batch.slice(low, SLICE_DOCUMENTS)
                lengths = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                ids, tf = (part.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
                m = length_norm(part.column(1).to_numpy(zero_copy_only=False), count, total)
                held = Slice.of(part.column(0).to_pylist(), m, lengths, ids, tf, len(weights))
                for own, (_, wanted) in zip(best, asked.value, strict=True):
                    held.search(wanted, weights, own)
        if kinds is not None:
            rows = [(i, key, score) for own, (i, _) in zip(best, asked.value, strict=True) for score, key in own.rows]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], item_type), pa.array(columns[1], kinds), pa.array(columns[2], pa.int64())], names=names)

    return search
