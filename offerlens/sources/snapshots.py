"""Sinks of a run and readers of optional inputs."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_snapshot(df: DataFrame, path: str, run_date=None, fmt: str = "parquet", cluster_by: list[str] | None = None) -> None:
    """Full rewrite of a table, or of its `run_date` partition.

    `cluster_by` hash-partitions the rows before writing (by series for histories), so
    that files hold whole groups and row-group statistics prune lookups.
    """
    out = df if cluster_by is None else df.repartition(*cluster_by).sortWithinPartitions(*cluster_by)
    writer = out.write.mode("overwrite").format(fmt)
    if run_date is not None:
        out = out.withColumn("run_date", F.lit(run_date).cast("date"))
        writer = out.write.mode("overwrite").format(fmt).partitionBy("run_date").option("partitionOverwriteMode", "dynamic")
    writer.save(path)


def read_optional(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """The table at `path`, or an empty one where nothing was written yet; unreadable data still fails."""
    try:
        return spark.read.format(fmt).schema(schema).load(path)
    except AnalysisException as error:
        if re.search("PATH_NOT_FOUND", str(error.getCondition() or error)):
            return spark.createDataFrame([], schema)
        raise
