"""Operator 5: shards by proportional stratified interleaving, in DataFrame operations alone.

Rows of a source are shuffled by a seeded hash and ranked; a row's place in the corpus is
its fractional rank (rank - 1 + u) / rows of the source, where u in [0, 1) is hashed from the
source, so that small sources spread over all shards. Sorting by it interleaves the
sources in proportion, and cutting the sequence into equal runs gives shards that each
hold the mixture. The law kept is ``rows``: shard sizes are at most one row apart.

Neither ranking goes through one task: a rank is the rank inside a tile of the order
(hash range, or range of the fraction) plus the rows of earlier tiles, and the tables of
tile counts are small. A tile that many equal rows share is cut by their row numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import stored

#: Rows of a tile on average; the number of tiles follows the table. A tile of more than WIDE times as many is cut.
TILE_ROWS = 32_768
WIDE = 4


def _ranked(df: DataFrame, keys: list[str], tile: str, order: list, name: str) -> DataFrame:
    """1-based rank along (tile, order) inside ``keys``: the tile's own ranks plus the counts of earlier tiles."""
    counts = df.groupBy(*keys, tile).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy(tile).rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(tile).alias("__k_tile"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = df.withColumn("__inside", F.row_number().over(Window.partitionBy(*keys, tile).orderBy(*order)))
    same = F.col(tile) == F.col("__k_tile")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return inside.join(sums, same).withColumn(name, F.col("__inside") + F.col("__before")).drop("__inside", "__before", "__k_tile", *[f"__k_{k}" for k in keys])


def stratified_shards(df: DataFrame, source: str, tie: list[str], shards: int = 8, seed: int = 7, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Adds ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard) to every row.

    ``tie`` names columns that tell rows apart; rows equal in all of them are
    interchangeable, however many. A null source is a stratum of its own. Repeated rows are rows of their
    own. An empty table gives an empty one. Other columns are carried along, so pass only
    the ones needed; columns named ``shard`` or ``slot`` are refused.
    """
    clash = sorted(set(df.columns) & {"shard", "slot"})
    if clash:
        raise ValueError(f"columns named like results: {clash}")
    held = stored(df.withColumn("__hash", F.xxhash64(F.lit(seed), *tie)).withColumn("__row", F.monotonically_increasing_id()))
    rows = held.count()
    tiles = max(1, -(-rows // tile_rows))
    # the hash without its sign bit, in equal ranges
    range_of = F.floor(F.shiftrightunsigned("__hash", 33).cast("double") / float(2**31) * tiles).cast("long")
    tiled = held.withColumn("__range", range_of).withColumn("__order", F.shiftrightunsigned("__hash", 1))
    wide = tiled.groupBy(source, "__range").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > WIDE * tile_rows)
    wide = wide.select(F.col(source).alias("__w_source"), F.col("__range").alias("__w_range"), F.ceil(F.col("__n") / tile_rows).cast("long").alias("__parts"))
    cut = tiled.join(wide, F.col(source).eqNullSafe(F.col("__w_source")) & (F.col("__range") == F.col("__w_range")), "left")
    tiled = cut.withColumn("__tile", F.struct("__range", F.coalesce(F.pmod("__row", "__parts"), F.lit(0).cast("long")).alias("__part"))).drop("__w_source", "__w_range", "__parts")
    ranked = _ranked(tiled, [source], "__tile", ["__order", *tie], "__rank")
    sizes = held.groupBy(source).agg(F.count(F.lit(1)).alias("__size")).withColumnRenamed(source, "__source")
    phase = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("phase"), F.col(source)), 11) / float(2**53)
    placed = ranked.join(sizes, F.col(source).eqNullSafe(F.col("__source"))).withColumn("__fraction", (F.col("__rank") - 1 + phase) / F.col("__size"))
    spread = stored(placed.select(*df.columns, "__rank", "__fraction")).withColumn("__tile", F.floor(F.col("__fraction") * tiles).cast("long")).withColumn("__one", F.lit(0))
    order = ["__fraction", F.col(source).asc_nulls_first(), "__rank"]
    cut = _ranked(spread, ["__one"], "__tile", order, "__position")
    # shard s holds positions from ceil(s * rows / shards): sizes at most one apart
    shard = F.expr(f"CAST((__position - 1) * {shards} DIV {max(rows, 1)}L AS INT)")
    slot = F.expr(f"__position - 1 - (shard * {rows}L + {shards - 1}) DIV {shards}L")
    out = cut.withColumn("shard", shard).withColumn("slot", slot)
    return out.select(*df.columns, "shard", "slot")
