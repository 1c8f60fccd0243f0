"""Tables written once in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_DIR = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset a local folder serves a local master; a cluster needs one that
    all its executors see."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or LOCAL_DIR).rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: what made it runs once, and its files outlive any executor."""
    path = f"{shared_dir(df.sparkSession)}/parasift/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(staged: DataFrame, block: str) -> list[list[str]]:
    """The files of each ``block`` of a staged table, in the order of the blocks; small numbers, one a file."""
    named = staged.select(block, F.col("_metadata.file_path").alias("file"))
    own = named.groupBy(block).agg(F.collect_set("file").alias("files")).collect()
    return [sorted(r["files"]) for r in sorted(own, key=lambda r: r[block])]


def slices(texts: pd.Series, rows: int = 256, chars: int = 1_000_000) -> Iterator[slice]:
    """A batch's rows in slices of at most ``rows`` and about ``chars`` characters: what a worker makes of one, in
    objects many times its text, goes back before the next begins. A longer text is a slice of its own."""
    begin = held = 0
    for i, text in enumerate(texts):
        size = len(text) if isinstance(text, str) else 0
        if i > begin and (i - begin >= rows or held + size > chars):
            yield slice(begin, i)
            begin, held = i, 0
        held += size
    if len(texts) > begin:
        yield slice(begin, len(texts))


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder and the path in it, for workers."""
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri[5:] if uri.startswith('file:') else uri}")


def read_file(file: str, columns: list[str]) -> pa.Table:
    """A file of a staged table, for a worker."""
    system, path = file_system(file)
    with system.open_input_file(path) as source:
        return pq.read_table(source, columns=columns)
