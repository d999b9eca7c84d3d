"""Intermediate tables in the cluster's shared folder, and small helpers of all operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.sources.sinks import work_dir


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table under ``spark.checkpoint.dir`` and read it again.

    Cuts lineage: what follows survives the loss of executors, never computes
    the table twice, and sees its real size.
    """
    path = work_dir(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Whole texts go to Python in batches of a few megabytes, unless the session says otherwise.

    Spark's own 64 MB are held several times over, by each task and by its worker.
    """
    key, usual = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(key) != usual:
        yield
        return
    spark.conf.set(key, "8m")
    try:
        yield
    finally:
        spark.conf.set(key, usual)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (string, null as empty) of a table, whatever other columns it has."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def by_columns(make: Callable[[pa.RecordBatch], Sequence | None], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function from one that makes the columns of a batch's result (None: no rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (columns := make(batch)) is not None:
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, type=t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    return run


def release_memory() -> None:
    """Give what numpy and Arrow have freed back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def binary(flat, lengths, wide: int) -> pa.Array:
    """One binary cell for each of ``lengths`` items of ``wide`` bytes from a flat numpy array."""
    import numpy as np

    offsets = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64) * wide))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())
