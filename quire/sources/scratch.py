"""Files that a job writes for its own later steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; a temporary folder stands in for it on a local master only."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quire-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends there, and all later uses read it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task as the lines of one JSON array."""
    first = True
    for batch in batches:
        lines = [(b"[" if first and not i else b",") + v.as_buffer().to_pybytes() for i, v in enumerate(batch.column(0))]
        first = first and not lines
        yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in lines], pa.string())], names=["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], names=["value"])


def write_json_arrays(elements: DataFrame, path: str) -> None:
    """One file a partition, a JSON array each, from a single column of JSON values."""
    elements.toDF("value").mapInArrow(_as_array, "value string").write.text(path)
