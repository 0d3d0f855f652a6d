"""Running values over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions.durable import checkpointed


def with_max_before(df: DataFrame, keys: list[str], order: str, value: str, name: str, block: int = 100_000) -> DataFrame:
    """Adds `name`: the largest `value` among the group's rows with a lower `order` (a whole number), else null.

    The group is cut into blocks of `block` order numbers. Block maxima run over the blocks and the
    rows over their own block, so that no task sorts more than a block of one group.
    """
    cut = df.withColumn("_block", F.floor(F.col(order) / block))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.groupBy(*keys, "_block").agg(F.max(value).alias("_top")).select(*keys, "_block", F.max("_top").over(before).alias("_carried"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.withColumn("_inside", F.max(value).over(inside)).join(carried, [*keys, "_block"])
    return out.withColumn(name, F.greatest("_carried", "_inside")).drop("_block", "_carried", "_inside")


def with_sum_before(df: DataFrame, keys: list[str], order: str, value: str, name: str, block: int = 100_000) -> DataFrame:
    """Adds `name`: the sum of `value` over the group's rows with a lower `order`, computed block-wise as above."""
    cut = df.withColumn("_block", F.floor(F.col(order) / block))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.groupBy(*keys, "_block").agg(F.sum(value).alias("_top")).select(*keys, "_block", F.sum("_top").over(before).alias("_carried"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.withColumn("_inside", F.sum(value).over(inside)).join(carried, [*keys, "_block"])
    total = F.coalesce("_carried", F.lit(0)) + F.coalesce("_inside", F.lit(0))
    return out.withColumn(name, total.cast("long")).drop("_block", "_carried", "_inside")


def with_place(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds `name`: how many of the group's rows come before in this order (ties in any order).

    All rows are sorted at once, so a hot group is spread over partitions; only counts per group and partition are windowed.
    """
    rows = checkpointed(df.orderBy(*keys, *order).withColumn("_row", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_row", 33))
    spans = rows.groupBy(*keys, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.select(*keys, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, [*keys, "_part"]).withColumn(name, F.col("_start") + F.col("_row") - F.col("_first")).drop("_row", "_part", "_first", "_start")
