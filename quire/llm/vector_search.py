"""Operator 10: nearest neighbours by balanced posting lists.

Centroids come from balanced halving of a bounded sample. A vector is posted to its
nearest centroid and, if it lies near a boundary, to others within a distance ratio.
Centroids are searched on an in-memory neighbour graph, for postings and queries alike. A
query reads the lists whose centroids lie within a distance ratio of the nearest; that
ratio is fitted on the sample to a recall goal. Neighbouring lists lie in a pack of bounded
size, long lists in several; a query is sent once to each pack that holds a list it reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import stored

#: Vectors sampled for centroids and ratio at most, by smallest seeded hash.
SAMPLE_LIMIT = 8_192
#: Vectors of a list on average, and lists at most; beyond that lists grow and are cut into several packs.
LIST_ROWS = 256
MAX_LISTS = 2_048
#: A vector is posted to lists within this ratio of its nearest centroid's distance, COPIES at most.
POST_RATIO = 1.05
COPIES = 2
NEIGHBOURS = 16
#: Centroids kept in view by the graph search at least.
VIEW = 24
RECALL_GOAL = 0.97
#: Rows of a pack at least, and bytes of its vectors in double precision at most (for the queries that meet it likewise).
PACK_ROWS = 2_048
PACK_BYTES = 16 << 20
#: Links followed, and scores worked out, at once in a worker.
LOOKS = 16_384
SCORES = 1 << 22


def takes_part(vector: Column) -> Column:
    """Not null, not zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def balanced_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Halve the sample again and again at the median of its main direction; a cell's mean is its centroid. Cells differ by one row a halving."""
    cells = [sample]
    while len(cells) * 2 <= lists and min(map(len, cells)) >= 2:
        halves = []
        for cell in cells:
            centred = cell - cell.mean(0)
            direction = centred[np.argmax((centred**2).sum(1))]
            for _ in range(8):
                direction = centred.T @ (centred @ direction)
                direction /= np.linalg.norm(direction) or 1.0
            order = np.argsort(centred @ direction, kind="stable")
            halves += [cell[order[: len(cell) // 2]], cell[order[len(cell) // 2 :]]]
        cells = halves
    return np.array([c.mean(0) for c in cells])


@dataclass(frozen=True)
class Graph:
    """Centroids, each linked to its nearest ones and to its neighbours along the order of the halvings (which keeps the graph connected)."""

    centroids: np.ndarray
    links: np.ndarray

    @staticmethod
    def of(centroids: np.ndarray) -> Graph:
        n = len(centroids)
        gap = ((centroids[:, None] - centroids[None]) ** 2).sum(2) if n <= 512 else (centroids**2).sum(1)[:, None] - 2 * centroids @ centroids.T + (centroids**2).sum(1)
        near = np.argsort(gap, axis=1, kind="stable")[:, : NEIGHBOURS + 1]
        around = np.arange(n)[:, None]
        far = [(around + (1 << k)) % n for k in range(0, max(1, n.bit_length()))]
        return Graph(centroids, np.concatenate([near, (around + 1) % n, (around - 1) % n, *far], axis=1))

    def within(self, vectors: np.ndarray, ratio: float) -> np.ndarray:
        """Distances to the centroids seen (infinity: not seen), for vectors in blocks: those within the ratio of the nearest, and VIEW at least."""
        n, k = len(vectors), len(self.centroids)
        seen = np.full((n, k), np.inf)
        done = np.zeros((n, k), bool)
        # one product a block costs less than gathering the many pairs that are looked at
        apart = np.sqrt(np.maximum((vectors**2).sum(1)[:, None] - 2 * vectors @ self.centroids.T + (self.centroids**2).sum(1), 0))
        entries = np.unique(np.linspace(0, k - 1, min(k, 8)).astype(int))
        seen[:, entries] = apart[:, entries]
        view = min(VIEW, k) - 1
        while True:
            bound = np.maximum(seen.min(1) * ratio, np.partition(seen, view, axis=1)[:, view])
            rows, nodes = np.nonzero(~done & (seen <= bound[:, None]) & np.isfinite(seen))
            if not len(rows):
                return seen
            done[rows, nodes] = True
            for a in range(0, len(rows), LOOKS):
                r, c = rows[a : a + LOOKS, None], self.links[nodes[a : a + LOOKS]]
                seen[r, c] = apart[r, c]


@dataclass(frozen=True)
class Index:
    graph: Graph | None
    ratio: float
    size: int


def lists_of(graph: Graph, vectors: np.ndarray, ratio: float, copies: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: the nearest list and those within the ratio, the nearest ``copies`` of them."""
    rows, found = [], []
    for a in range(0, len(vectors), 256):
        seen = graph.within(vectors[a : a + 256], ratio)
        keep = seen <= seen.min(1, keepdims=True) * ratio
        if copies is not None and copies < seen.shape[1]:
            limit = np.partition(seen, copies - 1, axis=1)[:, copies - 1]
            keep &= seen <= limit[:, None]
        r, c = np.nonzero(keep)
        rows.append(r + a)
        found.append(c)
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, int), np.zeros(0, int))


def fit_ratio(graph: Graph, sample: np.ndarray, k: int) -> float:
    """Smallest ratio at which queries of the sample find RECALL_GOAL of their k nearest sample rows."""
    queries = np.arange(0, len(sample), max(1, len(sample) // 256))
    score = sample[queries] @ sample.T
    score[np.arange(len(queries)), queries] = -np.inf
    best = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    row, posted = lists_of(graph, sample, POST_RATIO, COPIES)
    holds = np.zeros((len(sample), len(graph.centroids)), bool)
    holds[row, posted] = True
    d = np.array([np.sqrt(((sample[i] - graph.centroids) ** 2).sum(1)) for i in queries])
    relative = d / np.maximum(d.min(1, keepdims=True), 1e-12)
    # a neighbour is found once any of its lists is read
    needed = np.array([np.where(holds[b], relative[i], np.inf).min(1) for i, b in enumerate(best)]).ravel()
    return float(np.quantile(needed, RECALL_GOAL, method="higher")) * (1 + 1e-9) if len(needed) else 1.0


def fit_index(vectors: DataFrame, key: str, vector: str, k: int) -> Index:
    """Centroids, graph and ratio from at most SAMPLE_LIMIT vectors of smallest seeded hash; bounded on the driver."""
    size = vectors.count()
    rows = vectors.select(key, vector).orderBy(F.xxhash64(F.lit("index"), key), key).limit(SAMPLE_LIMIT).toPandas()
    if not len(rows):
        return Index(None, 1.0, size)
    width = rows[vector].map(len).mode()[0]
    sample = unit(np.array([x for x in rows[vector] if len(x) == width], np.float64))
    graph = Graph.of(balanced_centroids(sample, min(MAX_LISTS, max(1, size // LIST_ROWS))))
    return Index(graph, fit_ratio(graph, sample, k), size)


def _parts(df: DataFrame, index: Index, key: str, vector: str) -> tuple[DataFrame, str]:
    """(id, v) of the rows of the index's width, and the type of v: single precision stays, all else is double."""
    element = df.schema[vector].dataType.elementType.simpleString()
    kind = f"array<{element if element == 'float' else 'double'}>"
    rows = df.filter(F.size(vector) == index.graph.centroids.shape[1])
    return rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v")), kind


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _post(df: DataFrame, index: Index, key: str, vector: str) -> DataFrame:
    """(id, v, list): every row, once for each of its lists."""
    rows, kind = _parts(df, index, key, vector)
    width = index.graph.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = lists_of(index.graph, unit(_matrix(batch.column(1), width)), POST_RATIO, COPIES)
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(found.astype(np.int32))], names=["id", "v", "list"])

    return rows.mapInArrow(run, f"id long, v {kind}, list int")


def packs_of(rows: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """First pack and number of packs of each list: neighbours share one until it holds ``most`` rows, a list of more has its own."""
    packs, at, filled = {}, 0, 0
    for name, n in sorted(rows.items()):
        if filled and filled + n > most:
            at, filled = at + 1, 0
        packs[name] = (at, -(-n // most))
        if n > most:
            at += packs[name][1]
        else:
            filled += n
    return packs


def _ask(df: DataFrame, index: Index, key: str, vector: str, packs: dict[int, tuple[int, int]]) -> DataFrame:
    """(id, v, packs): every query once, with the lists that it reads in each pack."""
    rows, kind = _parts(df, index, key, vector)
    width = index.graph.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                row, found = lists_of(index.graph, unit(_matrix(part.column(1), width)), index.ratio, None)
                read = [{} for _ in range(part.num_rows)]
                for i, c in zip(row.tolist(), found.tolist()):
                    first, n = packs.get(c, (0, 0))
                    for p in range(first, first + n):
                        read[i].setdefault(p, []).append(c)
                made = pa.array([[{"pack": p, "lists": c} for p, c in x.items()] for x in read], pa.list_(pa.struct({"pack": pa.int32(), "lists": pa.list_(pa.int32())})))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), made], names=["id", "v", "packs"])

    return rows.mapInArrow(run, f"id long, v {kind}, packs array<struct<pack: int, lists: array<int>>>")


def nearest(df: DataFrame, key: str, vector: str, is_query: Column, k: int = 5) -> DataFrame:
    """The ``k`` nearest rows of each query row by cosine: ``query_id``, ``rank`` (int, from 1), ``vec_id`` (long), ``score`` (double).

    Candidates are all rows with another key. Nearest first, ties to the smaller key. Rows
    whose key is null, or whose vector is null, zero, not finite somewhere or of another
    length than most, take no part. Rows that repeat a key are one candidate, at its best score.
    Fewer candidates than ``k`` give them all. An empty table gives an empty one. Other columns are
    not read. Every valid row is posted; scores are worked out in double precision from the
    original vectors. A hot list is spread over packs, which its queries visit all.
    """
    valid = df.filter(F.col(key).isNotNull() & takes_part(F.col(vector)))
    index = fit_index(valid, key, vector, k)
    schema = "query_id long, vec_id long, score double"
    if index.graph is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    postings = stored(_post(valid, index, key, vector))
    rows_of = {r.list: r["count"] for r in postings.groupBy("list").count().collect()}  # MAX_LISTS rows at most
    width, spark = index.graph.centroids.shape[1], df.sparkSession
    largest = max(PACK_ROWS, PACK_BYTES // (8 * width))
    packs = packs_of(rows_of, max(PACK_ROWS, min(largest, sum(rows_of.values()) // (4 * spark.sparkContext.defaultParallelism))))
    asked = stored(_ask(valid.filter(is_query), index, key, vector, packs)).select("id", "v", F.explode("packs").alias("at")).select("id", "v", "at.pack", "at.lists")
    blocks = asked.groupBy("pack").agg(F.ceil(F.count(F.lit(1)) / F.lit(largest)).cast("int").alias("blocks"))
    part = F.pmod(F.xxhash64(F.lit("p"), "id"), F.col("packs")).cast("int")
    places = spark.createDataFrame([(c, *p) for c, p in packs.items()], "list int, first int, packs int")
    held = postings.join(F.broadcast(places), "list").withColumn("pack", F.col("first") + part)
    held = held.join(F.broadcast(blocks), "pack").select("pack", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v", "list")
    asked = asked.join(F.broadcast(blocks), "pack").select("pack", F.pmod(F.xxhash64(F.lit("q"), "id"), F.col("blocks")).cast("int").alias("block"), "id", "v", "lists")

    def score(queries: pa.Table, rows: pa.Table) -> pa.Table:
        qi, ri = (t.column("id").to_numpy() for t in (queries, rows))
        out = ([], [], [])
        if len(qi) and len(ri):
            q, r = (_matrix(t.column("v"), width) for t in (queries, rows))
            length = np.linalg.norm(r, axis=1)
            lists, of = np.unique(rows.column("list").to_numpy(), return_inverse=True)
            same, times = np.unique(ri, return_inverse=True, return_counts=True)[1:]
            most = k * int(times.max())  # so many rows hold k keys
            reads = queries.column("lists").combine_chunks()
            ends, read = reads.offsets.to_numpy(), reads.values.to_numpy()
            step = max(1, min(256, SCORES // len(ri)))
            for a in range(0, len(qi), step):
                b = min(a + step, len(qi))
                reading = np.zeros((b - a, len(lists)), bool)
                names = read[ends[a] : ends[b]]
                at = np.minimum(np.searchsorted(lists, names), len(lists) - 1)
                held = lists[at] == names
                reading[np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))[held], at[held]] = True
                near = np.flatnonzero(reading.any(0)[of])
                if not len(near):
                    continue
                s = q[a:b] @ r[near].T / (np.linalg.norm(q[a:b], axis=1)[:, None] * length[near])
                s[~reading[:, of[near]] | (qi[a:b, None] == ri[near])] = -np.inf
                least = np.partition(s, len(near) - most, axis=1)[:, len(near) - most] if len(near) > most else np.full(b - a, -np.inf)
                i, j = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                found, j = s[i, j], near[j]
                order = np.lexsort((ri[j], -found, i))
                i, j, found = i[order], j[order], found[order]
                once = np.sort(np.unique(i * len(times) + same[j], return_index=True)[1])
                i, j, found = i[once], j[once], found[once]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                for column, values in zip(out, (qi[a + i[keep]], ri[j[keep]], found[keep])):
                    column.append(values)
        ids, near, scores = (np.concatenate(x) if x else np.zeros(0) for x in out)
        return pa.table({"query_id": pa.array(ids, pa.int64()), "vec_id": pa.array(near, pa.int64()), "score": pa.array(scores, pa.float64())})

    deal = ["pack", "block"]
    found = asked.groupBy(*deal).cogroup(held.groupBy(*deal)).applyInArrow(score, schema)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")

