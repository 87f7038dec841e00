"""What the operators share: Arrow maps over texts, stored tables, bounded labelled samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows handed to numpy code at once; a slice also ends once its texts reach SLICE_CHARS.
SLICE_ROWS = 512
SLICE_CHARS = 4_000_000

ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
         "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


def small_batches(spark: SparkSession) -> None:
    """Arrow batches that stay small when texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))


def keyed_texts(df: DataFrame, keys: list[str], text: str, taken: list[str]) -> DataFrame:
    """The key columns and the text as ``__text`` (null: empty); no other column is read."""
    clash = sorted(set(keys) & {*taken, "__text"})
    if clash:
        raise ValueError(f"key columns named like results: {clash}")
    return df.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of at most SLICE_ROWS texts that end soon after SLICE_CHARS characters."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= SLICE_CHARS or i + 1 - start >= SLICE_ROWS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def map_texts(df: DataFrame, keys: list[str], text: str, outputs: dict[str, str], make: Callable[[], Callable[[list[str]], list]]) -> DataFrame:
    """Add columns worked out from whole texts, in Arrow batches; no shuffle.

    ``make()`` runs once a task and gives a function from a list of texts to one list or
    array for each of ``outputs`` (name: type).
    """
    source = keyed_texts(df, keys, text, list(outputs))
    schema = T.StructType([*(source.schema[k] for k in keys), *(T.StructField(n, T._parse_datatype_string(t)) for n, t in outputs.items())])
    kinds = [ARROW[t] for t in outputs.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or make()
            texts = batch.column(len(keys)).to_pylist()
            for a, b in slices(texts):
                made = [x if isinstance(x, pa.Array) else pa.array(x, type=kind) for x, kind in zip(work(texts[a:b]), kinds, strict=True)]
                held = [batch.column(i).slice(a, b - a) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*held, *made], names=[*keys, *outputs])

    return source.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only for a local master without one."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="quire-shared-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder


def stored(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends there, and lost executors cost only the reading."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def smallest_hashes(rows: DataFrame, group: str, order: list[str | Column], limit: int) -> DataFrame:
    """Per group the ``limit`` rows of smallest seeded hash, with their ``__rank`` (from 1): a bounded, repeatable sample.

    Groups are few. Only rows whose hash lies in the lowest 4 * limit / rows of its group are
    ranked (a share that holds fewer than ``limit`` of them does not occur in practice), so one task
    sees a bounded number of rows however large the group.
    """
    hashed = rows.withColumn("__hash", F.xxhash64(F.lit("sample"), *order))
    sizes = rows.groupBy(F.col(group).alias("__group")).agg(F.count(F.lit(1)).alias("__size"))
    low = F.shiftrightunsigned("__hash", 11) / float(1 << 53) < 4.0 * (limit + 16) / F.col("__size")
    drawn = hashed.join(F.broadcast(sizes), F.col(group) == F.col("__group")).filter(low)  # one row a group
    w = Window.partitionBy(group).orderBy(F.shiftrightunsigned("__hash", 11), *order)
    return drawn.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= limit).drop("__hash", "__group", "__size")
