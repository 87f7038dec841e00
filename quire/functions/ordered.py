"""Ordered scans that survive one group holding a third of the rows.

A plain window puts a whole group in one task. Here a group is cut into tiles by
its order column; each tile is scanned alone, one summary row per tile carries the
state over, and the two are joined on (group, tile), the partitioning the tile
scan already has: one shuffle of the rows, read by scan and summary alike. The group is named by a
struct of its keys, for structs are equal where the same fields are null: a null-safe comparison of
each key would be a partitioning of its own and shuffle all rows again. A group of n rows costs tasks of at most ``width`` rows plus one
scan of n/width summary rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

TILE_WIDTH = 65536
TILE = "__tile"


def read_once(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Shuffle by ``keys`` such that several uses of the result share one computation.

    Spark reuses an exchange only where both uses need the same columns; pruning would
    make them differ and run everything below twice. The always-true filter names every
    column and is not deterministic, so it stays above the exchange and keeps it whole. It is one
    condition, for of two joined by AND the optimiser pushes the deterministic one down; and it takes
    the partition's number, for a comparison of ``rand`` with a bound is folded away.
    """
    flat = [F.map_entries(f.name) if isinstance(f.dataType, MapType) else F.col(f.name) for f in df.schema.fields]
    return df.repartition(*keys).filter((F.xxhash64(*flat) >= F.lit(-(2**63))) | (F.spark_partition_id() < 0))


@dataclass(frozen=True)
class Scan:
    """One output column of an ordered scan.

    kind: ``last`` last non-null value so far; ``last_before`` the same without the
    current row; ``sum`` running sum; ``sum_before`` without the current row;
    ``prev`` / ``next`` the neighbouring row's value; ``bits`` all integers of the group, or-ed.
    """

    kind: str
    value: Column


def tile_of_integer(column: Column | str, width: int = TILE_WIDTH) -> Column:
    """Tile of a unique integer order column: at most ``width`` rows per tile."""
    column = F.col(column) if isinstance(column, str) else column
    return F.floor(column / F.lit(width)).cast("long")


def tiled_by_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Tiles that are contiguous in (keys, order) and hold about equally many rows, however a key's or a value's rows mass."""
    return df.repartitionByRange(*keys, *order).withColumn(TILE, F.spark_partition_id().cast("long"))


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    tile: Column | None,
    scans: dict[str, Scan],
) -> DataFrame:
    """Add the scan columns; ``tile`` must not decrease along ``order``.

    Without a tile the rows are cut into ranges of (keys, order) by row count, with borders from
    Spark's sample of the rows: right for any type of order and for values that many rows
    share, as long as ``order`` as a whole tells a key's rows apart. It costs one more shuffle.
    """
    group = F.struct(*keys)
    tiled = read_once(df.withColumn(TILE, tile) if tile is not None else tiled_by_rows(df, keys, order), group, TILE)
    by_order = Window.partitionBy(group, TILE).orderBy(*order)
    upto, before = (
        by_order.rowsBetween(Window.unboundedPreceding, 0),
        by_order.rowsBetween(Window.unboundedPreceding, -1),
    )
    rank = F.struct(*order)
    local, summary = {}, {}
    for name, scan in scans.items():
        v = scan.value
        if scan.kind in ("last", "last_before"):
            boxed = F.when(v.isNotNull(), F.struct(v.alias("v")))
            local[name] = F.last(boxed, ignorenulls=True).over(upto if scan.kind == "last" else before)
            summary[name] = F.max_by(boxed, F.when(v.isNotNull(), rank))
        elif scan.kind in ("sum", "sum_before"):
            local[name] = F.coalesce(F.sum(v).over(upto if scan.kind == "sum" else before), F.lit(0))
            summary[name] = F.coalesce(F.sum(v), F.lit(0))
        elif scan.kind == "prev":
            local[name] = F.lag(F.struct(v.alias("v"))).over(by_order)
            summary[name] = F.max_by(F.struct(v.alias("v")), rank)
        elif scan.kind == "next":
            local[name] = F.lead(F.struct(v.alias("v"))).over(by_order)
            summary[name] = F.min_by(F.struct(v.alias("v")), rank)
        elif scan.kind == "bits":
            summary[name] = F.bit_or(v)
        else:
            raise ValueError(scan.kind)
    tiles = tiled.groupBy(group.alias("__group"), TILE).agg(*[c.alias(n) for n, c in summary.items()])
    by_tile = Window.partitionBy("__group").orderBy(TILE)
    earlier = by_tile.rowsBetween(Window.unboundedPreceding, -1)
    later = by_tile.rowsBetween(1, 1)
    carried = []
    for name, scan in scans.items():
        if scan.kind in ("last", "last_before", "prev"):
            carried.append(F.last(F.col(name), ignorenulls=True).over(earlier).alias(f"__c_{name}"))
        elif scan.kind in ("sum", "sum_before"):
            carried.append(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"__c_{name}"))
        elif scan.kind == "bits":
            carried.append(F.bit_or(name).over(Window.partitionBy("__group")).alias(f"__c_{name}"))
        else:
            carried.append(F.first(F.col(name), ignorenulls=True).over(later).alias(f"__c_{name}"))
    carry = tiles.select("__group", F.col(TILE).alias("__group_tile"), *carried)
    scanned = tiled.select("*", *[c.alias(f"__l_{n}") for n, c in local.items()])
    condition = (group == F.col("__group")) & (F.col(TILE) == F.col("__group_tile"))
    joined = scanned.join(carry, condition, "left")
    out = []
    for name, scan in scans.items():
        if scan.kind in ("sum", "sum_before"):
            value = F.col(f"__l_{name}") + F.col(f"__c_{name}")
        elif scan.kind == "bits":
            value = F.col(f"__c_{name}")
        else:
            value = F.coalesce(F.col(f"__l_{name}"), F.col(f"__c_{name}")).getField("v")
        out.append(value.alias(name))
    return joined.select(*df.columns, *out)


def position_in_group(
    df: DataFrame, keys: list[str], order: list[str], tile: Column, name: str = "position"
) -> DataFrame:
    """1-based position, the scan form of ``row_number``."""
    return ordered_scan(df, keys, order, tile, {name: Scan("sum", F.lit(1))})


def first_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """First row per key by ``order``: a map-side combined ``min_by``, never a window."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("__row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def latest_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows per key; Spark cuts each partition to ``n`` before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def salted_join(
    big: DataFrame, small: DataFrame, on: list[str], how: str, salt_from: Column, salts: int = 16
) -> DataFrame:
    """Equi join in which a hot key of ``big`` spreads over ``salts`` tasks.

    ``small`` holds at most one row per key, so its copies stay small.
    """
    left = big.withColumn("__salt", F.pmod(F.xxhash64(salt_from), F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")
