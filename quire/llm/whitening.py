"""Operator 11: embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become integers (a fixed-point grid), so counts, sums and deviations are exact. With
X the centred rows, each step multiplies one direction by X and the outcome u by the
transpose of X, in one distributed pass that gives back one number a dimension. A left
vector u has as many entries as there are rows; it is never stored, since u = X p for a short
p that obeys the same recurrence, and its products with earlier ones follow from X'u. Both
sides are reorthogonalised in full. The singular values of the small bidiagonal matrix are
the components' deviations, its right vectors turn the Lanczos basis into the components.

A step that ends in an invariant subspace is followed by a fresh direction orthogonal to all
earlier ones, so repeated deviations and constant dimensions are found too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import stored

#: Grid of the entries: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Numbers of a block of rows at most; tolerance of the iteration; least variance of a component against the first one's.
BLOCK_NUMBERS = 1 << 18
TOLERANCE = 1e-13
LEAST = 1e-12


@dataclass(frozen=True)
class Whitening:
    """``sums`` over ``n`` integer rows; ``components`` as columns, their variances, the trace, and the largest entry of the whitened covariance minus the identity."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.variances)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - sums / n as doubles: the whole part of the mean is taken off in integers."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole) - np.array([(s % n) / n for s in sums])


def deviation(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """Sum of (n * x - sums)^2 of each row, exact at any size."""
    y = x - np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    if int(np.abs(y).max(initial=0)) * n < 1 << 28 and len(rest) < 1 << 6:
        d = n * y - np.array(rest, np.int64)
        return (d * d).sum(1).tolist()
    return [sum((n * int(v) - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in y]


def grid_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Key and ``x`` (array<long>) of the rows whose vector is finite throughout and as long as most are (at least one entry)."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    valid = df.select(key, vector).filter(F.coalesce(finite & (F.size(vector) > 0), F.lit(False)))
    width = valid.groupBy(F.size(vector).alias("width")).count().orderBy(F.desc("count"), "width").first()
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    return valid.filter(F.size(vector) == (width.width if width else 0)).select(key, x.alias("x"))


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    x = batch.column(column)
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _blocks(rows: DataFrame, width: int) -> DataFrame:
    """Rows of ``x`` as blocks (count, bytes), so that a pass reads a few large values."""
    step = max(1, BLOCK_NUMBERS // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, 0)
            cut = [x[a : a + step] for a in range(0, len(x), step)]
            yield pa.RecordBatch.from_arrays([pa.array([len(c) for c in cut], pa.int32()), pa.array([c.astype("<i8").tobytes() for c in cut], pa.binary())], names=["count", "data"])

    return rows.select("x").mapInArrow(run, "count int, data binary")


def _summed(blocks: DataFrame, make: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Sum over all blocks of a short array; a task sends one number a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for count, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = make(np.frombuffer(data.as_buffer(), "<i8").reshape(count, -1))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total, {"long": pa.int64(), "double": pa.float64()}[kind])], names=["place", "value"])

    sums = blocks.mapInArrow(run, f"place int, value {kind}").groupBy("place").agg(F.sum("value").alias("value"))
    found = dict(sums.collect())  # one row a place
    return np.array([found[i] for i in range(len(found))])


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for b in basis:
            v = v - (b @ v) * b
    return v


def bidiagonalise(products: Callable[[np.ndarray], np.ndarray], width: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest singular values of X, falling, and its right singular vectors (columns), from ``products(q) = X'Xq``.

    Steps go on until the wanted values have settled to rounding, or all directions are used.
    """
    random = np.random.default_rng(11)
    fresh = lambda: _orthogonal(random.standard_normal(width), right)
    right: list[np.ndarray] = []
    left: list[np.ndarray] = []  # p, with u = X p
    images: list[np.ndarray] = []  # X'u
    b = np.zeros((width + 1, width + 1))
    scale, v = 0.0, fresh()
    v /= np.linalg.norm(v)
    while True:
        k, m = len(right), len(left)
        right.append(v)
        q = v.copy()
        for _ in range(2):
            for p, g in zip(left, images, strict=True):
                q = q - (g @ q) * p
        if m:
            b[m - 1, k] = images[-1] @ v
        s = products(q)
        alpha = float(np.sqrt(max(q @ s, 0.0)))
        scale = max(scale, alpha)
        beta = 0.0
        if alpha > TOLERANCE * scale:
            b[m, k] = alpha
            left.append(q / alpha)
            images.append(s / alpha)
            rest = _orthogonal(images[-1] - alpha * v, right)
            beta = float(np.linalg.norm(rest))
            scale = max(scale, beta)
        outer, values, inner = np.linalg.svd(b[: max(1, len(left)), : k + 1])
        if k + 1 == width:
            break
        settled = k + 1 >= wanted and beta > TOLERANCE * scale and len(values) >= wanted and (beta * np.abs(outer[-1, :wanted]) <= TOLERANCE * values[0]).all()
        if settled:
            break
        v = rest / beta if beta > TOLERANCE * scale else fresh()
        v /= np.linalg.norm(v)
    held = min(wanted, len(values))
    return values[:held], np.array(right).T @ inner[:held].T


def fit_whitening(df: DataFrame, key: str, vector: str, components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """Integer rows (key, ``x``), stored, and the whitening fitted on all of them; None where no component has a variance above zero."""
    rows = stored(grid_rows(df, key, vector))
    first = rows.select(F.size("x")).first()
    if first is None:
        return rows, None
    width = first[0]
    blocks = stored(_blocks(rows, width))
    ends = _summed(blocks, lambda x: np.r_[len(x), x.sum(0)], "long")
    n, sums = int(ends[0]), tuple(int(s) for s in ends[1:])
    total = float(_summed(blocks, lambda x: np.r_[(centred(x, n, sums) ** 2).sum()], "double")[0])
    if not total:
        return rows, None

    def products(q: np.ndarray) -> np.ndarray:
        def both(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            return c.T @ (c @ q)

        return _summed(blocks, both, "double")

    values, directions = bidiagonalise(products, width, min(components, width))
    kept = values**2 > LEAST * values[0] ** 2
    directions = directions[:, kept]
    directions = directions * np.sign(directions[np.abs(directions).argmax(0), np.arange(directions.shape[1])])
    plain = Whitening(n, sums, directions, values[kept] ** 2 / n, total / n, 0.0)

    def moments(x: np.ndarray) -> np.ndarray:
        w = plain.whitened(x)
        return np.r_[w.sum(0), (w.T @ w).ravel()]

    size = directions.shape[1]
    found = _summed(blocks, moments, "double") / n
    covariance = found[size:].reshape(size, size) - np.outer(found[:size], found[:size])
    return rows, Whitening(n, sums, directions, plain.variances, plain.trace, float(np.abs(covariance - np.eye(size)).max()))


def whiten(df: DataFrame, key: str, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened vectors: key, ``n`` (long), ``deviation`` (decimal), ``whitened`` and ``explained`` (array<double>, a place a component), ``identity_error``.

    Takes part: every row whose vector is not null, has only finite entries, and is as long
    as the vectors of most rows (the shorter length among equals); all other rows, and empty vectors, are
    dropped. Entries become floor(64 * c) + 1000000 and must fit 64 bits (else Spark's
    cast error). All these rows, repeated ones and those of null key included, are the fit list. Components go
    by falling variance; where fewer directions than asked for vary, there are fewer, and no row if
    none does (one row alone, all vectors equal, an empty table). The sign makes each
    component's largest entry positive. Other columns are not read; a key named like a
    result is refused.
    """
    schema = T.StructType([df.schema[key], *T._parse_datatype_string("n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")])
    if key in schema.names[1:] + ["x"]:
        raise ValueError("key column named like a result")
    rows, fitted = fit_whitening(df, key, vector, components)
    if fitted is None:
        return df.sparkSession.createDataFrame([], schema)
    explained = (fitted.variances / fitted.trace).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, 1)
            w = fitted.whitened(x)
            made = [
                pa.array([fitted.n] * len(x), pa.int64()),
                pa.array([Decimal(d) for d in deviation(x, fitted.n, fitted.sums)], pa.decimal128(38, 0)),
                pa.array(list(w), pa.list_(pa.float64())),
                pa.array([explained] * len(x), pa.list_(pa.float64())),
                pa.array([fitted.identity_error] * len(x), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=schema.names)

    return rows.mapInArrow(run, schema)
