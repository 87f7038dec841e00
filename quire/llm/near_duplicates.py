"""Operator 9: near-duplicate documents by a multi-index Hamming join of b-bit signatures.

A document's set of hashed five-word shingles gets a signature of HASHES minima, of which
BITS bits each are kept. Two sets of Jaccard similarity s differ in about (1 - s) * HASHES
places. The signature is cut into CHUNKS chunks; if two signatures differ in fewer than
2 * CHUNKS places, some chunk differs in at most one (pigeonhole). So every chunk is
written once for each of its places, with that place left out: two chunks with at most one
error share such a key, and every pair within MAX_DISTANCE meets. Pairs that meet and lie near
are confirmed on full sets; nothing further apart is.

Meeting pairs are let through up to NEAR places, a little beyond what is guaranteed. At similarity
0.85 a pair exceeds MAX_DISTANCE with a chance of 8e-6, shares no key with one of about 7e-9, and
exceeds NEAR with one of 1e-7: that is the link that can be lost.

Equal sets are one node from the start. Each key's nodes are first held against the key's
smallest node, a star that is linear in their number; each node is confirmed against the one it shares
most keys with, which joins most copies. Where a key still holds nodes of different components, their
signatures are compared in pairs of blocks, each a task of bounded size. Components that come within
the distance form a family, whose full sets are compared in pairs of blocks; a task gives out only as
many links as join what it found. Texts that share keys but are further apart cost no full set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import keyed_texts, map_texts, stored
from quire.llm.components import components

SHINGLE = 5
HASHES = 48
BITS = 16
CHUNKS = 10
#: Differing places within which every pair of signatures is found.
MAX_DISTANCE = 2 * CHUNKS - 1
#: Differing places up to which pairs that meet are confirmed.
NEAR = 22
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Nodes of a block in which signatures or full sets are compared, hashes held as columns at a time, rows of small groups that share a task.
BLOCK = 512
COLUMNS = 4096
TASK_ROWS = 16_384
_FACTORS = np.random.default_rng(5).integers(0, 2**64, (2, HASHES), np.uint64) | np.uint64(1)
_PLACE = np.random.default_rng(6).integers(0, 2**64, SHINGLE, np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of a whole text, A-Z lower-cased; a shorter text is one shingle, one without words none."""
    words = text.encode().lower().split()  # bytes: exactly A-Z and the six ASCII white-space characters
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(len(h), SHINGLE)
    total = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        total += h[i : len(h) - n + 1 + i] * _PLACE[i]
    return np.unique(_mixed(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    """HASHES places of BITS bits of a non-empty set."""
    lowest = np.full(HASHES, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), 8192):
        part = hashes[k : k + 8192, None] * _FACTORS[0] + _FACTORS[1]
        lowest = np.minimum(lowest, part.min(0))
    return (_mixed(lowest) >> np.uint64(64 - BITS)).astype(np.uint64)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """Per signature (row) one key a place: its chunk without that place."""
    keys = np.empty(signatures.shape, np.uint64)
    for c, places in enumerate(np.array_split(np.arange(HASHES), CHUNKS)):
        for p in places:
            h = np.full(len(signatures), int(c) * 1000 + int(p), np.uint64)
            for q in places:
                if q != p:
                    h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + signatures[:, q] + np.uint64(1))
            keys[:, p] = h
    return keys


def _features(texts: list[str]) -> list:
    sets = [shingle_set(t) for t in texts]
    held = [i for i, s in enumerate(sets) if len(s)]
    marks = np.array([signature(sets[i]) for i in held], np.uint64).reshape(-1, HASHES)
    keys = dict(zip(held, chunk_keys(marks).astype(np.int64).tolist(), strict=True))
    signs = dict(zip(held, [m.astype("<u2").tobytes() for m in marks], strict=True))
    return [[len(s) for s in sets], [node_of(s) for s in sets], [keys.get(i) for i in range(len(sets))], [signs.get(i) for i in range(len(sets))]]


def node_of(hashes: np.ndarray) -> int | None:
    """64-bit hash that stands for a whole set."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63) if len(hashes) else None


def node_sets(nodes: DataFrame, documents: DataFrame, key: str, text: str) -> DataFrame:
    """Full sets (node, set) of the nodes of a table (node, doc), worked out anew from one document of each."""
    chosen = nodes.select(F.col("doc").alias("__doc")).distinct()
    rows = documents.select(F.col(key), F.col(text)).join(chosen, F.col(key).eqNullSafe(F.col("__doc")), "left_semi")

    def work(texts: list[str]) -> list:
        sets = [shingle_set(t) for t in texts]
        return [[node_of(s) for s in sets], [s.tobytes() for s in sets]]

    # a key may be repeated with other texts, whose nodes stand elsewhere
    return map_texts(rows, [], text, {"node": "long", "set": "binary"}, lambda: work).join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets, as a matrix of integers; hashes are taken COLUMNS at a time."""
    out = np.zeros((len(left), len(right)), np.int64)
    if len(left) * len(right) <= 4:
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                out[i, j] = np.intersect1d(x, y, assume_unique=True).size
        return out
    sides = [(np.concatenate(s), np.repeat(np.arange(len(s)), [len(x) for x in s])) for s in (left, right)]
    both = np.intersect1d(sides[0][0], sides[1][0])
    placed = []
    for values, rows in sides:
        at = np.minimum(np.searchsorted(both, values), max(0, len(both) - 1))
        held = both[at] == values if len(both) else np.zeros(len(values), bool)
        order = np.argsort(at[held], kind="stable")
        placed.append((at[held][order], rows[held][order]))
    for k in range(0, len(both), COLUMNS):
        made = []
        for (at, rows), side in zip(placed, (left, right), strict=True):
            a, b = np.searchsorted(at, [k, k + COLUMNS])
            flags = np.zeros((len(side), COLUMNS), np.float32)
            flags[rows[a:b], at[a:b] - k] = 1
            made.append(flags)
        out += (made[0] @ made[1].T).astype(np.int64)  # COLUMNS at most, exact
    return out


def _joined(parent: dict[int, int], a: int, b: int) -> bool:
    """Union of two roots; whether they were apart."""
    found = []
    for x in (a, b):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        found.append(x)
    parent[max(found)] = min(found)
    return found[0] != found[1]


def block_links(percent: int):
    """For the rows (family, node, root, side, set) of a task: links between different roots of a family, as few as join them."""

    def run(rows: pa.Table) -> pa.Table:
        family, node, root, side = (rows.column(n).to_numpy() for n in ("family", "node", "root", "side"))
        sets = [np.frombuffer(s, np.uint64) for s in rows.column("set").to_pylist()]
        out: tuple[list[int], list[int]] = ([], [])
        order = np.argsort(family, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(family[order])) + 1):
            one = group[side[group] == 0]
            two = group[side[group] == 1] if (side[group] == 1).any() else one
            common = common_counts([sets[i] for i in one], [sets[i] for i in two])
            sizes = [np.array([len(sets[i]) for i in x]) for x in (one, two)]
            near = 100 * common >= percent * (sizes[0][:, None] + sizes[1] - common)
            parent: dict[int, int] = {}
            for i, j in zip(*np.nonzero(near & (root[one][:, None] != root[two])), strict=True):
                if _joined(parent, int(root[one[i]]), int(root[two[j]])):
                    out[0].append(int(node[one[i]]))
                    out[1].append(int(node[two[j]]))
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places in which the signatures of two lists differ, as a matrix."""
    out = np.zeros((len(left), len(right)), np.int16)
    for place in range(left.shape[1]):
        out += left[:, place, None] != right[None, :, place]
    return out


def _signs(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, HASHES)


def close_pairs(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """Those pairs (a, b) of nodes whose signatures lie within NEAR places."""
    both = pairs.join(signs.select(F.col("node").alias("a"), F.col("sign").alias("sa")), "a").join(signs.select(F.col("node").alias("b"), F.col("sign").alias("sb")), "b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = (_signs(batch.column(2)) != _signs(batch.column(3))).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(apart <= NEAR))

    return both.select("a", "b", "sa", "sb").mapInArrow(near, "a long, b long")


def _block_pairs(rows: pa.Table) -> pa.Table:
    """For the rows (key, side, root, sign) of a task: pairs of roots with nodes of one key within NEAR places, as few as join them."""
    key, side, root = (rows.column(n).to_numpy() for n in ("key", "side", "root"))
    sign, out = _signs(rows.column("sign")), ([], [])
    order = np.argsort(key, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        one = group[side[group] == 0]
        two = group[side[group] == 1] if (side[group] == 1).any() else one
        near = (distances(sign[one], sign[two]) <= NEAR) & (root[one][:, None] != root[two])
        parent: dict[int, int] = {}
        for i, j in zip(*np.nonzero(near), strict=True):
            x, y = int(root[one[i]]), int(root[two[j]])
            if _joined(parent, x, y):
                out[0].append(x)
                out[1].append(y)
    return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})


def roots_near(rooted: DataFrame, signs: DataFrame) -> DataFrame:
    """Links (a, b) of different roots with nodes that share a key and lie within NEAR places, enough to join all such roots; from rows (key, node, root).

    A key is cut into blocks of about BLOCK nodes by hash. Tasks are pairs of blocks; small keys share tasks, of which
    there are as many as their rows ask for.
    """
    mixed = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("n")).filter("least <> most")
    blocks = mixed.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    held = stored(rooted.join(blocks, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))
    tasks = max(1, -(-held.filter("parts = 1").count() // TASK_ROWS))
    # a row goes to the tasks that pair its block with each block of its key
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = held.select("key", "node", "root", "parts", "part", other)
    low, high = F.least("part", "other"), F.greatest("part", "other")
    task = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("key"), F.lit(tasks))).otherwise(F.xxhash64("key", low, high))
    dealt = dealt.select("key", "node", "root", task.alias("task"), (F.col("part") > F.col("other")).cast("int").alias("side"))
    met = dealt.join(signs, "node").select("key", "root", "side", "sign", "task")
    return met.groupBy("task").applyInArrow(_block_pairs, "a long, b long").distinct()


def star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of nodes whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = np.intersect1d(x, y, assume_unique=True).size
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(close, "a long, b long")


def family_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different roots inside families, from rows (family, node, root).

    A family is cut into blocks of about BLOCK nodes; a root with many nodes has blocks of
    its own, and two blocks of one such root are never compared. Tasks are pairs of blocks;
    small families share tasks.
    """
    large = F.col("n") > BLOCK // 4
    by_root = members.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = by_root.groupBy("family").agg(F.count(F.lit(1)).alias("roots"), F.sum("n").alias("nodes")).filter("roots > 1")
    whole = F.col("nodes") <= BLOCK
    major = F.when(~whole & large, F.col("root"))
    parts = by_root.join(mixed.select("family", "nodes"), "family").withColumn("major", major)
    blocks = parts.groupBy("family", "nodes", "major").agg(F.sum("n").alias("n")).withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    placed = (
        members.join(parts.select("family", "root", "major"), ["family", "root"])
        .join(blocks.select("family", F.col("major").alias("__major"), "parts", "nodes"), "family")
        .filter(F.col("major").eqNullSafe(F.col("__major")))
        .withColumn("block", F.xxhash64("major", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("parts"))))
    )
    labels = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("family", "major", "nodes", F.xxhash64("major", F.col("part").cast("long")).alias("block"))
    other = labels.select("family", F.col("major").alias("major2"), F.col("block").alias("block2"))
    # pairs of blocks, not of documents: few a family
    deals = labels.join(other, "family").filter((F.col("block") <= F.col("block2")) & (F.col("major").isNull() | F.col("major2").isNull() | (F.col("major") != F.col("major2"))))
    bins = F.lit(max(1, -(-members.count() // TASK_ROWS)))
    task = F.when(whole, F.pmod(F.xxhash64("family"), bins)).otherwise(F.xxhash64("family", "block", "block2"))
    deals = deals.select("family", "block", "block2", task.alias("task"))
    one = deals.select("family", "block", "task", F.lit(0).alias("side"))
    two = deals.filter("block <> block2").select("family", F.col("block2").alias("block"), "task", F.lit(1).alias("side"))
    rows = placed.select("family", "node", "root", "block").join(one.unionByName(two), ["family", "block"]).join(sets, "node")
    return rows.select("task", "family", "node", "root", "side", "set").groupBy("task").applyInArrow(block_links(percent), "a long, b long")


def near_duplicates(df: DataFrame, key: str, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row for each row of ``df``: key, ``n_shingles`` (long), ``component_id`` and ``kept``.

    ``component_id`` is the smallest key that links can reach, the row's own included;
    ``kept`` marks the row that holds it. A null text, or one without words, has no shingles,
    is linked with nothing and kept under its own key. Rows of a null key are linked by
    their texts as others; they are kept only where no key is in their component. Rows that repeat a
    key are told apart by their texts. Equal texts are linked whatever their number. An
    empty table gives an empty one. Other columns are not read; keys named like results are
    refused. Nodes are 64-bit hashes of whole sets.
    """
    keyed_texts(df, [key], text, ["n_shingles", "component_id", "kept", "node", "doc", "chunks", "sign"])
    features = stored(map_texts(df, [key], text, {"n_shingles": "long", "node": "long", "chunks": "array<long>", "sign": "binary"}, lambda: _features))
    filled = features.filter("node IS NOT NULL")
    nodes = stored(filled.groupBy("node").agg(F.min(key).alias("doc")))
    alike = filled.groupBy("node").agg(F.first(F.struct("chunks", "sign")).alias("f"))
    alike = stored(alike.select("node", "f.*"))
    signs, rows = alike.select("node", "sign"), stored(alike.select(F.explode("chunks").alias("key"), "node"))
    pivots = rows.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot <> last").select("key", "pivot")
    shared = stored(rows.join(pivots, "key"))
    met = shared.filter("node <> pivot").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("keys"))
    best = met.groupBy("node").agg(F.max_by("pivot", F.struct("keys", "pivot")).alias("pivot"))
    stars = stored(close_pairs(best.select(F.col("pivot").alias("a"), F.col("node").alias("b")), signs))

    sets = stored(node_sets(shared.select("node").distinct().join(nodes, "node").select("node", "doc"), df, key, text))
    first = stored(star_links(stars, sets, percent))
    rooted = stored(shared.select("key", "node").join(components(first), "node", "left").withColumn("root", F.coalesce("root", "node")))
    families = components(roots_near(rooted, signs)).select(F.col("node").alias("root"), F.col("root").alias("family"))
    members = stored(rooted.select("node", "root").distinct().join(families, "root").select("family", "node", "root"))
    roots = components(first.unionByName(stored(family_links(members, sets, percent))))
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    ids = stored(named.join(smallest, "root").select("node", "component_id"))
    out = features.select(key, "n_shingles", "node").join(ids, "node", "left")
    component = F.when(F.col("node").isNull(), F.col(key)).otherwise(F.col("component_id"))
    return out.select(key, "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col(key)).alias("kept"))

