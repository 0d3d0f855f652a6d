"""Cutting the lineage of iterative jobs so that they survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names for checkpoints.

    Only a local session without any setting gets a folder of its own; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="offerlens-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows read back from the shared folder, without their lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: no lineage, and later reads take only the columns they need.

    A table that this function has returned is not written again.
    """
    if vars(df).get("_written"):
        return df
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def parquet_batches(path: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of a table in the shared folder, read by a task itself, in the same order by every task. Hadoop and Arrow write some locations differently."""
    if path.startswith("file:"):
        system, path = fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    elif "://" in path:
        system, path = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    else:
        system = fs.LocalFileSystem()
    for f in sorted(x.path for x in system.get_file_info(fs.FileSelector(path)) if x.path.endswith(".parquet")):
        with system.open_input_file(f) as opened:
            yield from parquet.ParquetFile(opened).iter_batches(columns=columns)
