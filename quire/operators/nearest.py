"""Exact nearest vectors by cosine, with blocks that a query need not read.

On unit vectors a larger cosine is a smaller distance, so the triangle inequality holds: no
vector of a block lies nearer to a query than the query's distance to the block's centre less
the block's radius. Vectors go to the nearest of a bounded set of pivots, and a pivot's
vectors to blocks of bounded size. Each query first reads the block of the nearest centre,
which gives its k-th score so far, then only the blocks that may hold a better one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from quire.functions.ordered import top_n
from quire.sources.scratch import written

#: Pivots at most, and vectors that call for one; vectors of a block, queries that meet a block in one task, centres that meet queries in one task, about.
PIVOTS = 256
PIVOT_ROWS = 64
BLOCK_ROWS = 2048
QUERY_ROWS = 1024
CENTRES = 1024
#: Scores are ranked by so many digits; bounds leave room for as much.
SCORE_DIGITS = 12
SLACK = 1e-9


def usable(vector: Column | str, width: int) -> Column:
    """A finite vector of that many numbers, not all zero: one that has a cosine."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == width) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _with_pivot(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    schema = Ty.StructType([*rows.schema, Ty.StructField("__pivot", Ty.IntegerType())])
    at, width = rows.columns.index("__v"), pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest = (unit(_matrix(batch.column(at), width)) @ pivots.T).argmax(1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _dealt(rows: DataFrame, keys: list[str], size: int, by: Column, name: str) -> DataFrame:
    """Adds ``name``, a part from 0, so that a part of a key holds about ``size`` rows, and ``__parts``."""
    parts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("__parts"))
    joined = rows.alias("r").join(parts.select(*[F.col(k).alias(f"__p_{k}") for k in keys], "__parts"), _same(keys, "__p_"))
    return joined.drop(*[f"__p_{k}" for k in keys]).withColumn(name, F.pmod(by, F.col("__parts")).cast("int"))


def _same(keys: list[str], prefix: str) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(prefix + k))
    return condition


def blocks_of(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, __pivot, __part, centre, radius) of every block of unit vectors."""
    block = [*keys, "__pivot", "__part"]
    schema = Ty.StructType([*(rows.schema[k] for k in block), *Ty._parse_datatype_string("centre array<double>, radius double")])

    def sums(group: pa.Table) -> pa.Table:
        x = unit(_matrix(group.column("__v"), width))
        centre = x.mean(0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(1)).max())
        held = [group.column(k).combine_chunks().slice(0, 1) for k in block]
        return pa.Table.from_arrays([*held, pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([radius])], names=schema.names)

    return rows.select(*block, "__v").groupBy(*block).applyInArrow(sums, schema)


def block_pairs(queries: DataFrame, blocks: DataFrame, keys: list[str], width: int, sizes: tuple[int, int]) -> DataFrame:
    """(query columns, __pivot, __part) of the blocks that a query must read.

    queries: (query_id, __q, *keys, best, seen_pivot, seen_part). Without ``best`` (null) that is the block of the nearest
    centre among those that meet the query in one task; with it, every block but the seen one that may hold a score
    of ``best`` or more. ``sizes`` counts the queries and the blocks: each side is dealt to as many packs as they ask for, and
    all packs of a scope meet.
    """
    columns = queries.columns
    schema = Ty.StructType([*queries.schema, *Ty._parse_datatype_string("__pivot int, __part int, gap double")])
    query_packs, block_packs = (max(1, -(-n // size)) for n, size in zip(sizes, (QUERY_ROWS, CENTRES)))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pack = lambda by, n: F.pmod(by, F.lit(n)).cast("int")
    left = queries.select(*columns, pack(F.xxhash64("query_id"), query_packs).alias("__qp"), all_of(block_packs).alias("__bp"))
    right = blocks.select(*blocks.columns, all_of(query_packs).alias("__qp"), pack(F.xxhash64("__pivot", "__part"), block_packs).alias("__bp"))

    def meet(q: pa.Table, b: pa.Table) -> pa.Table:
        rows, found, gaps = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if q.num_rows and b.num_rows:
            x, c = unit(_matrix(q.column("__q"), width)), _matrix(b.column("centre"), width)
            apart = np.sqrt(np.maximum(1 + (c * c).sum(1) - 2 * x @ c.T, 0))
            best = q.column("best").to_numpy().astype(np.float64)
            first = np.isnan(best)
            least = apart - b.column("radius").to_numpy()
            keep = least <= np.sqrt(np.maximum(2 - 2 * best, 0))[:, None] + SLACK
            seen = (q.column("seen_pivot").to_numpy()[:, None] == b.column("__pivot").to_numpy()) & (q.column("seen_part").to_numpy()[:, None] == b.column("__part").to_numpy())
            keep = np.where(first[:, None], np.arange(len(c)) == apart.argmin(1)[:, None], keep & ~seen)
            rows, found = np.nonzero(keep)
            gaps = apart[rows, found]
        taken = q.select(columns).take(pa.array(rows))
        held = b.take(pa.array(found))
        return pa.Table.from_arrays([*taken.columns, held.column("__pivot"), held.column("__part"), pa.array(gaps)], names=schema.names)

    deal = [*keys, "__qp", "__bp"]
    return left.groupBy(*deal).cogroup(right.groupBy(*deal)).applyInArrow(meet, schema)


def block_scores(pairs: DataFrame, rows: DataFrame, keys: list[str], width: int, k: int) -> DataFrame:
    """(query_id, node_id, *keys, score): the k best of each pair's block."""
    block = [*keys, "__pivot", "__part"]
    schema = Ty.StructType([pairs.schema["query_id"], rows.schema["node_id"], *(rows.schema[c] for c in keys), Ty.StructField("score", Ty.DoubleType())])
    asked = _dealt(pairs.select("query_id", "__q", *block), block, QUERY_ROWS, F.xxhash64("query_id"), "__qp")
    counts = asked.select(*[F.col(c).alias(f"__c_{c}") for c in block], "__parts").distinct()
    held = rows.select("node_id", "__v", *block).join(counts, _same(block, "__c_")).withColumn("__qp", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).select("node_id", "__v", *block, "__qp")

    def score(q: pa.Table, n: pa.Table) -> pa.Table:
        who, which, scores = [], [], []
        if q.num_rows and n.num_rows:
            x, y = unit(_matrix(q.column("__q"), width)), unit(_matrix(n.column("__v"), width))
            order = np.empty(len(y), np.int64)
            order[pc.sort_indices(n.column("node_id")).to_numpy()] = np.arange(len(y))
            for a in range(0, len(x), 128):
                s = x[a : a + 128] @ y.T
                for i, row in enumerate(s):
                    near = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k] - SLACK) if len(row) > k else np.arange(len(row))
                    near = near[np.lexsort((order[near], -np.round(row[near], SCORE_DIGITS)))][:k]
                    who += [a + i] * len(near)
                    which += near.tolist()
                    scores += row[near].tolist()
        at, of = pa.array(who, pa.int64()), pa.array(which, pa.int64())
        return pa.Table.from_arrays([q.column("query_id").take(at), n.column("node_id").take(of), *[n.column(c).take(of) for c in keys], pa.array(scores, pa.float64())], names=schema.names)

    deal = [*block, "__qp"]
    return asked.groupBy(*deal).cogroup(held.groupBy(*deal)).applyInArrow(score, schema)


def exact_top_k(nodes: DataFrame, queries: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """(query_id, node_id, *keys, score, rank): the k nearest nodes of each query in its scope, all of them if fewer.

    nodes: (node_id, embedding, *keys); queries: (query_id, query_vector, *keys), ids unique. Ranked by the score to twelve
    digits, ties by the smaller id. A vector that is null, zero, not finite or of another length than most has no score: such nodes
    follow the others by id, and such a query gets the first nodes by id without a score.
    """
    base = nodes.select("node_id", *keys, F.transform("embedding", lambda x: x.cast("double")).alias("__v"))
    asked = queries.select("query_id", *keys, F.transform("query_vector", lambda x: x.cast("double")).alias("__q"))
    width = base.groupBy(F.size("__v").alias("n")).count().filter("n > 0").orderBy(F.desc("count"), "n").first()
    held, width = (width["count"], width.n) if width else (0, 0)
    ranked = [F.desc_nulls_last(F.round("score", SCORE_DIGITS)), F.asc("node_id")]
    good, fit = usable("__v", width), usable("__q", width)
    first = lambda rows: top_n(rows.select("node_id", *keys), keys or [F.lit(0)], [F.asc("node_id")], k, "__r").drop("__r").toDF("node_id", *[f"__f_{c}" for c in keys])
    unscored = asked.join(first(base.filter(~good)), _same(keys, "__f_")).unionByName(asked.filter(~fit).join(first(base.filter(good)), _same(keys, "__f_")))
    unscored = unscored.select("query_id", "node_id", *keys, F.lit(None).cast("double").alias("score"))
    sample = base.filter(good).orderBy(F.xxhash64("node_id"), "node_id").limit(max(1, min(PIVOTS, held // PIVOT_ROWS))).select("__v").collect()  # PIVOTS vectors at most
    if not sample:
        return top_n(unscored, ["query_id"], ranked, k)
    pivots = unit(np.array([r[0] for r in sample]))
    rows = written(_dealt(_with_pivot(base.filter(good), pivots), [*keys, "__pivot"], BLOCK_ROWS, F.xxhash64("node_id"), "__part").drop("__parts"), "vectors")
    blocks = written(blocks_of(rows, keys, width), "blocks")
    none = lambda kind: F.lit(None).cast(kind)
    start = asked.filter(fit).select("query_id", *keys, "__q", none("double").alias("best"), none("int").alias("seen_pivot"), none("int").alias("seen_part"))
    sizes = start.count(), blocks.count()
    nearest = top_n(block_pairs(start, blocks, keys, width, sizes), ["query_id"], [F.asc("gap"), F.asc("__pivot"), F.asc("__part")], 1)
    nearest = written(nearest.select("query_id", *keys, "__q", F.col("__pivot"), F.col("__part")), "nearest")
    near = written(block_scores(nearest, rows, keys, width, k), "near")
    least = top_n(near, ["query_id"], ranked, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    least = least.select(F.col("query_id").alias("__id"), F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(-1.0)).alias("best"))
    again = nearest.join(least, F.col("query_id") == F.col("__id")).select("query_id", *keys, "__q", "best", F.col("__pivot").alias("seen_pivot"), F.col("__part").alias("seen_part"))
    far = block_scores(block_pairs(again, blocks, keys, width, sizes), rows, keys, width, k)
    return top_n(near.unionByName(far).unionByName(unscored), ["query_id"], ranked, k)
