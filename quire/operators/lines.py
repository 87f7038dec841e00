"""Line tables: each text is read once, in its own row, with its neighbours beside it.

Neighbour access is by zipping shifted arrays, so no line ever needs a shuffle or a
window and cost stays linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T


def line_table(chunks: DataFrame, text: str = "text", reach: int = 3, keep: list[str] | None = None) -> DataFrame:
    """One row per non-blank line: ``line_no`` (0-based), ``line`` (stripped), ``before``
    and ``after`` (up to ``reach`` neighbouring non-blank lines with their numbers) and
    ``next_line`` (next non-blank line)."""
    keep = keep or [c for c in chunks.columns if c != text]
    numbered = F.transform(
        T.lines(F.coalesce(F.col(text), F.lit(""))), lambda v, i: F.struct(i.alias("n"), T.strip(v).alias("s"))
    )
    base = chunks.select(*keep, F.filter(numbered, lambda v: v["s"] != "").alias("__nb"))
    size = F.size("__nb")
    shifts = [F.col("__nb").alias("k0")]
    for k in range(1, reach + 1):
        pad = F.array_repeat(F.lit(None).cast("struct<n:int,s:string>"), k)
        shifts.append(F.concat(pad, F.col("__nb")).alias(f"b{k}"))
        shifts.append(F.slice(F.col("__nb"), k + 1, F.greatest(size, F.lit(1))).alias(f"a{k}"))
    zipped = base.select(*keep, F.explode(F.arrays_zip(*shifts)).alias("z")).filter(F.col("z.k0").isNotNull())
    around = lambda side: F.filter(
        F.array(*[F.col(f"z.{side}{k}") for k in (range(reach, 0, -1) if side == "b" else range(1, reach + 1))]),
        lambda v: v.isNotNull(),
    )
    return zipped.select(
        *keep,
        F.col("z.k0.n").alias("line_no"),
        F.col("z.k0.s").alias("line"),
        around("b").alias("before"),
        around("a").alias("after"),
        F.col("z.a1.s").alias("next_line"),
    )


def near(side: Column, line_no: Column, distance: int) -> Column:
    """Texts of the neighbours at most ``distance`` raw lines away."""
    close = F.filter(side, lambda v: F.abs(v["n"] - line_no) <= distance)
    return F.transform(close, lambda v: v["s"])
