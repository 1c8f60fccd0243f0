"""Shared folders, staged tables and byte-level text helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_DIR = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only where unset and the master is local, a
    local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or LOCAL_DIR).rstrip("/")


def stage_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/parasift/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends in files that
    outlive any executor."""
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.parquet(path, compression=compression)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


#: A key with more than one in so many rows is hot; there can be no more such keys than that.
HOT_SHARE = 1000


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], count: str) -> DataFrame:
    """``rows`` joined to ``table``, which has one row a key and in ``count`` how many of ``rows`` have it.

    Hot keys, ``HOT_SHARE`` at most, go to the rows by broadcast, so their rows stay where they lie; all
    others meet in a hash join. Both are to be staged tables, as each is read twice.
    """
    bound = rows.count() / HOT_SHARE
    hot, others = table.where(F.col(count) > bound), table.where(F.col(count) <= bound)
    return rows.join(others, on).unionByName(rows.join(F.broadcast(hot), on))


def unstage(df: DataFrame) -> None:
    """Delete the files of a table that ``stage`` returned and nothing will read again."""
    remove(df.sparkSession, df.staged_path)


def remove(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives freed memory back to the system when it ends: worker processes serve
    many tasks, of many stages, and would each keep the most that any of them took."""

    @functools.wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return tidied


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string (or binary) column as one array, and each row's offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    dtype = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, dtype=dtype)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def row_chunks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes each, or of one longer row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), rows)
        yield row, stop
        row = stop


def row_bytes(data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
    whole = data.tobytes()
    for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield whole[a:z]


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of a few planned rows as one literal, without a Python scan."""
    import json

    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def file_system(uri: str):
    """The file system of a shared folder and the path in it, for Python workers."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri[5:] if uri.startswith('file:') else uri}")
