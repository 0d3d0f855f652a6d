"""Registered queries run in a session that does not trust the size of compressed files."""

from pyspark.sql import functions as F

from offerlens.plans import registry


def test_small_files_of_large_rows_are_not_broadcast(spark, tmp_path):
    path = str(tmp_path / "repeated")
    spark.range(200_000).select("id", F.repeat(F.lit("the same text "), 50).alias("text")).coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.sources.fileCompressionFactor")

    def joined(i):
        rows = i.spark.read.parquet(path)
        return rows.join(rows.select("id", F.col("text").alias("other")), "id")

    registry.query("_joined")(joined)
    out = registry.QUERIES.pop("_joined")(spark, "")
    assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 200_000
    assert out.sparkSession.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    assert spark.conf.get("spark.sql.sources.fileCompressionFactor") == before
