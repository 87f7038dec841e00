"""Operator 12: n-gram Jaccard join with adaptive multi-match prefixes.

Shingles stand in the order of their hashes. Of a set of n shingles, any partner shares
o = ceil(n * percent / 100) or more; the prefix of level l is the first n - o + l of them, and
two linked sets share at least ``needed`` shingles of their prefixes, a number that grows with
both levels. Each set looks up how many sets hold each shingle of its longest prefix and
takes the level of least estimated cost: holders met through the prefix, and candidates
left to verify, of which fewer pass the higher the level.

Shingles with more than FREQUENT holders are never paired. A set steps over them by taking
a level above their number in its prefix, so a linked partner also meets it elsewhere. Sets
with too many of them for that meet the others as before; among themselves they are joined anew,
whole sets now, in the order of rising holders. What can't step over its frequent shingles
even then is mostly made of them (large families of near copies): such sets are
first confirmed against the smallest holder of a shingle, and only those still apart are
compared, in blocks of full sets.

Equal sets are one node. Links are confirmed on full sets, first each set's best
candidate, then the candidates that are still apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import keyed_texts, map_texts, stored
from quire.llm.components import components
from quire.llm.near_duplicates import family_links, node_of, node_sets, shingle_set, star_links

#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Holders above which a shingle pairs nothing; cost of verifying a pair in units of a met holder.
FREQUENT = 16
VERIFY = 4.0
#: One level more for so many shingles of the required overlap.
LEVEL_STEP = 16


def overlap(n, percent: int = PERCENT):
    """Shingles that a set of n shares with any partner of its size or smaller, at least."""
    return -(-n * percent // 100)


def levels(n, percent: int = PERCENT):
    """Highest level of a set of n; n less prefix never falls as n grows, which ``needed`` relies on."""
    return 1 + overlap(n, percent) // LEVEL_STEP


def needed(n_a, l_a, n_b, l_b, percent: int = PERCENT):
    """Shingles that the prefixes of two linked sets share at least."""
    o_a, o_b = overlap(n_a, percent), overlap(n_b, percent)
    return np.maximum(o_a, o_b) - np.maximum(o_a - l_a, o_b - l_b)


def best_level(n: int, place: np.ndarray, holders: np.ndarray, percent: int = PERCENT, most: int = FREQUENT) -> tuple[int, int]:
    """Level of a set and the frequent shingles in its prefix, from the places (ascending, from 0) and holders of its shared shingles.

    Only levels above the number of frequent shingles in their prefix count; where there is
    none, the highest level is taken, and the set must meet others by frequent shingles too.
    """
    top, base = levels(n, percent), n - overlap(n, percent)
    frequent = holders > most
    ends = np.searchsorted(place, base + np.arange(1, top + 1))  # shared shingles in the prefix of each level
    hot = np.r_[0, np.cumsum(frequent)][ends]
    met = np.r_[0, np.cumsum(np.where(frequent, 0, holders - 1))][ends]
    level = np.arange(1, top + 1)
    cost = np.where(level > hot, met + VERIFY * met / level, np.inf)
    at = int(cost.argmin()) if np.isfinite(cost).any() else top - 1
    return at + 1, int(hot[at])


def _prefixes(percent: int):
    def work(texts: list[str]) -> list:
        sets = [shingle_set(t) for t in texts]
        sizes = [len(s) for s in sets]
        return [sizes, [node_of(s) for s in sets], [s[: n - overlap(n, percent) + levels(n, percent)].astype(np.int64) for s, n in zip(sets, sizes, strict=True)]]

    return work


def _levelled(percent: int, most: int, by_holders: bool = False):
    """Rows (node, n, shared) to (node, n, level, hot, token, frequent): the level of every node and the shared shingles of its prefix.

    ``shared`` holds (place, token, holders) of a set's shared shingles; ``by_holders`` orders
    the whole set by holders instead, shingles of its own first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(2).offsets.to_numpy()
            ends = ends - ends[0]
            rows = batch.column(2).flatten()
            places, tokens, holders = (rows.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            node, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for i, n in enumerate(size.tolist()):
                own = slice(ends[i], ends[i + 1])
                order = (np.lexsort((tokens[own], holders[own])) if by_holders else np.argsort(places[own], kind="stable")) + ends[i]
                place = n - len(order) + np.arange(len(order)) if by_holders else places[order]
                level, hot = best_level(n, place, holders[order], percent, most)
                keep = order[place < n - overlap(n, percent) + level]
                k = len(keep)
                for column, value in zip(out, (np.full(k, node[i]), np.full(k, n), np.full(k, level), np.full(k, hot), tokens[keep], holders[keep] > most), strict=True):
                    column.append(value)
            made = [np.concatenate(c) if c else np.zeros(0) for c in out]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, kinds, strict=True)], names=["node", "n", "level", "hot", "token", "frequent"])

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, set) to (node, n, token)."""
    for batch in batches:
        for node, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held = np.frombuffer(data.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), node)), pa.array(np.full(len(held), len(held))), pa.array(held)], names=["node", "n", "token"])


def postings_of(rows: DataFrame, percent: int, most: int, by_holders: bool = False) -> DataFrame:
    """Levels and postings from rows (node, n, place, token): a shuffle that counts holders, one that brings them back, one by node."""
    holders = rows.groupBy("token").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    shared = rows.join(holders, "token").groupBy("node", "n").agg(F.collect_list(F.struct("place", "token", "holders")).alias("shared"))  # a set's own shingles
    return shared.mapInArrow(_levelled(percent, most, by_holders), "node long, n long, level int, hot int, token long, frequent boolean")


def _close_in_size(percent: int):
    return percent * F.greatest("na", "nb") <= 100 * F.least("na", "nb")


def candidates(postings: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared): pairs that share as many shingles of their prefixes as linked sets must, met through shingles that are not frequent."""
    rare = postings.filter("NOT frequent").select("token", "node", "n", "level", "hot")
    side = lambda s: rare.select("token", *[F.col(c).alias(f"{c}{s}") for c in ("node", "n", "level", "hot")])
    o = lambda n: F.ceil(F.col(n) * percent / F.lit(100)).cast("long")
    least = F.greatest(o("na"), o("nb")) - F.greatest(o("na") - F.col("levela"), o("nb") - F.col("levelb")) - F.least("hota", "hotb")
    met = side("a").join(side("b"), "token").filter((F.col("nodea") < F.col("nodeb")) & _close_in_size(percent))
    pairs = met.select(F.col("nodea").alias("a"), F.col("nodeb").alias("b"), F.greatest(least, F.lit(1)).alias("least"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max("least").alias("least")).filter("shared >= least").select("a", "b", "shared")


def pivots(postings: DataFrame) -> DataFrame:
    """(a, b, shared): for sets that could not step over their frequent shingles, the smallest such set that holds the shingle (a), unless it is the set itself."""
    bound = postings.filter("frequent AND hot >= level").select("token", "node")
    smallest = bound.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("a <> last").select("token", "a")
    met = bound.join(smallest, "token").filter("node <> a")
    return met.groupBy("a", F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("shared"))


def best_partners(pairs: DataFrame) -> DataFrame:
    """For each node the pair of most shared shingles, ties to the smaller partner; a pair once."""
    both = pairs.select("a", "b", "shared").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    top = both.groupBy("a").agg(F.max(F.struct("shared", (-F.col("b")).alias("less"))).alias("top"))
    return top.select(F.least("a", -F.col("top.less")).alias("a"), F.greatest("a", -F.col("top.less")).alias("b")).distinct()


def jaccard_classes(df: DataFrame, key: str, text: str = "text", percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """One row for each row of ``df``: key, ``n_shingles`` (long) and ``component_id``, the smallest key that links can reach, its own included.

    Two texts link when 100 * intersection >= percent * union of their sets of five-word
    shingles; a text of fewer words is one shingle. A null text, or one without words, has no
    shingles, is linked with nothing and keeps its own key. Rows of a null key are linked by
    their texts as others; their class is null only where no key is in it. Rows that repeat a key are
    told apart by their texts. Equal texts are linked whatever their number. An empty table
    gives an empty one. Other columns are not read; keys named like results are refused.
    Nodes are 64-bit hashes of whole sets. No pair within the threshold is lost.
    """
    keyed_texts(df, [key], text, ["n_shingles", "component_id", "node", "doc", "prefix"])
    features = stored(map_texts(df, [key], text, {"n_shingles": "long", "node": "long", "prefix": "array<long>"}, lambda: _prefixes(percent)))
    filled = features.filter("node IS NOT NULL")
    nodes = stored(filled.groupBy("node").agg(F.min(key).alias("doc")))
    alike = filled.groupBy("node").agg(F.first("prefix").alias("prefix"), F.first("n_shingles").alias("n"))
    rows = alike.select("node", "n", F.posexplode("prefix").alias("place", "token"))
    postings = stored(postings_of(rows, percent, frequent))
    bound = stored(postings.filter("hot >= level").select("node").distinct())

    met = stored(candidates(postings, percent))
    named = met.select(F.col("a").alias("node")).union(met.select("b")).union(bound).distinct()
    sets = stored(node_sets(named.join(nodes, "node").select("node", "doc"), df, key, text))
    whole = sets.join(bound, "node", "left_semi").select("node", "set").mapInArrow(_tokens, "node long, n long, token long")
    postings = stored(postings_of(whole.withColumn("place", F.lit(0)), percent, frequent, by_holders=True))
    met = stored(met.unionByName(candidates(postings, percent)).groupBy("a", "b").agg(F.max("shared").alias("shared")))
    stars = stored(pivots(postings))
    first = stored(star_links(best_partners(met).unionByName(best_partners(stars)).distinct(), sets, percent))
    roots = stored(components(first))
    root = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    apart = met.join(root("a"), "a", "left").join(root("b"), "b", "left").filter("NOT coalesce(root_a, a) <=> coalesce(root_b, b)").select("a", "b")
    second = stored(star_links(apart, sets, percent))
    roots = stored(components(first.unionByName(second)))
    families = components(stars.select("a", "b")).withColumnRenamed("root", "family")
    members = stored(families.join(roots, "node", "left").select("family", "node", F.coalesce("root", "node").alias("root")))
    third = stored(family_links(members, sets, percent))
    roots = components(first.unionByName(second).unionByName(third))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    ids = stored(rooted.join(smallest, "root").select("node", "component_id"))
    out = features.select(key, "n_shingles", "node").join(ids, "node", "left")
    return out.select(key, "n_shingles", F.when(F.col("node").isNull(), F.col(key)).otherwise(F.col("component_id")).alias("component_id"))
