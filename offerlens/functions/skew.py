"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows in memory may take this many times the bytes of a Parquet file, whose dictionaries hold repeated texts once (measured: 40 to 80).
FILE_FACTOR = 100


def measured_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of the given one in which joins do not trust the size of compressed files.

    By file size Spark would broadcast, through the driver, tables whose rows take hundreds of megabytes. Counted with
    FILE_FACTOR, such a join is planned as a shuffle, and adaptive execution still broadcasts a side that is measured to be small.
    A factor set by the caller stays, if it is larger. The caller's own session is not changed.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.get(key, None) != value and own.conf.isModifiable(key):
            own.conf.set(key, value)
    factor = "spark.sql.sources.fileCompressionFactor"
    own.conf.set(factor, str(max(float(spark.conf.get(factor, "1.0")), FILE_FACTOR)))
    return own


def splits_skew_itself(df: DataFrame) -> bool:
    """Whether the session splits oversized shuffle-join partitions at run time."""
    conf = df.sparkSession.conf
    return all(conf.get(f"spark.sql.adaptive.{k}", "true") == "true" for k in ("enabled", "skewJoin.enabled"))


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Inner or left join of `many` to `few`, where a key may hold a large share of `many`.

    Adaptive execution splits such partitions with no extra pass. Where the session has it
    switched off, the hot keys are salted instead.
    """
    return many.join(few, keys, how) if splits_skew_itself(many) else salted_join(many, few, keys, how)


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", rows_per_task: int = 1_000_000) -> DataFrame:
    """Join with a salt on keys having more than `rows_per_task` rows in `many`.

    Their rows in `few` are repeated once per split; all other keys have one split. The list of
    hot keys is at most rows / rows_per_task long.
    """
    splits = (
        many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > rows_per_task)
        .select(*keys, F.ceil(F.col("_rows") / rows_per_task).cast("int").alias("_splits"))
    )
    n = F.coalesce("_splits", F.lit(1))
    salted = many.join(splits, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*many.columns), n).cast("int"))
    repeated = few.join(splits, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1)))
    return salted.drop("_splits").join(repeated.drop("_splits"), [*keys, "_salt"], how).drop("_salt")
