"""The change log as an incremental job.

State is three tables under one shared path, in hash buckets of the series key, written step by step: days holds one row per series
and day (last, lowest and highest price), log the entries that changed (a null price takes an entry away), late what came after a later day
of its series was logged. Batch n is step 2n; merging the late rows of batches up to n is step 2n + 1.

A step reads only the buckets its rows fall into and recomputes only the days they touch and the days right after these.
It reads parts of earlier steps and overwrites its own, so a repeated step gives the same tables. Every batch also writes
some buckets in full, in turn, so that each bucket has a full part within the last `compact_every` batches and no older part is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.operators import history as hist

OBSERVATIONS = "entity_key long, shop_id string, obs_date date, obs_seq long, price long"
LOG = "entity_key long, shop_id string, date date, price long"
DAYS = f"{LOG}, seq long, low long, high long"
BUCKETS = 64


def _with_bucket(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*hist.SERIES), F.lit(buckets)).cast("int"))


def _keyed(schema: str, observations: DataFrame) -> str:
    return schema.replace("entity_key long", f"entity_key {observations.schema['entity_key'].dataType.simpleString()}", 1)


def _write(df: DataFrame, path: str, step: int, buckets: int) -> None:
    """A step's part, one file per bucket."""
    _with_bucket(df, buckets).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/step={step}")


def _parts(spark: SparkSession, path: str, before: int, schema: str, compact_every: int, only: list[int] | None = None) -> DataFrame:
    """Rows of the steps before `before` that count, with bucket and step; of the buckets `only` if given."""
    if before <= 0:
        return spark.createDataFrame([], f"{schema}, bucket int, step int")
    last = (before - 1) // 2
    steps = range(2 * max(0, last - compact_every + 1), before)
    read = spark.read.schema(f"{schema}, bucket int, step int").option("basePath", path).parquet(f"{path}/step={{{','.join(map(str, steps))}}}")
    # The last batch up to `last` whose turn the bucket was; both conditions prune folders.
    full = F.lit(last) - F.pmod(F.lit(last) - F.col("bucket"), F.lit(compact_every))
    read = read.filter(F.col("step") >= 2 * full)
    return read if only is None else read.filter(F.col("bucket").isin(only))


def _newest(log: DataFrame) -> DataFrame:
    """Of log rows of the same day the one of the latest step (its price may be null)."""
    newest = F.max_by(F.struct("price"), "step").alias("newest")
    return log.groupBy(*hist.SERIES, "date").agg(newest).select(*hist.SERIES, "date", "newest.price")


def _advance(spark: SparkSession, state: str, step: int, rows: DataFrame, schema: str, buckets: int, compact_every: int, turn: list[int]) -> None:
    """Takes day rows into days and log; the buckets in `turn` are written in full."""
    # At most `buckets` numbers.
    touched = [r["bucket"] for r in _with_bucket(rows, buckets).select("bucket").distinct().collect()]
    wanted = sorted({*touched, *turn})
    days_schema = schema + DAYS.removeprefix(LOG)
    stored = _parts(spark, f"{state}/days", step, days_schema, compact_every, wanted)
    kept = stored.drop("bucket", "step")
    concerned = kept.join(rows.select(*hist.SERIES).distinct(), hist.SERIES, "left_semi")
    patch = hist.log_patch(hist.merge_days(concerned.unionByName(rows)), rows)
    in_turn = F.col("bucket").isin(turn) if turn else F.lit(False)
    full_days = hist.merge_days(stored.filter(in_turn).drop("bucket", "step").unionByName(_with_bucket(rows, buckets).filter(in_turn).drop("bucket")))
    _write(_with_bucket(rows, buckets).filter(~in_turn).drop("bucket").unionByName(full_days), f"{state}/days", step, buckets)
    logged = _parts(spark, f"{state}/log", step, schema, compact_every, turn or [-1]).drop("bucket")
    patched = _with_bucket(patch, buckets)
    full_log = _newest(logged.unionByName(patched.filter(in_turn).drop("bucket").withColumn("step", F.lit(step)))).filter("price IS NOT NULL")
    _write(patched.filter(~in_turn).drop("bucket").unionByName(full_log), f"{state}/log", step, buckets)


def process_batch(observations: DataFrame, batch: int, state: str, compact_every: int = 20, buckets: int = BUCKETS) -> None:
    """Logs one micro-batch of observations; those older than a day already logged for their series are put aside as late."""
    spark, step = observations.sparkSession, 2 * batch
    schema = _keyed(LOG, observations)
    days_schema = schema + DAYS.removeprefix(LOG)
    arrived = f"{state}/arrived"
    # The batch is evaluated once; everything else reads this table.
    _write(hist.day_rows(observations), arrived, step, buckets)
    rows = spark.read.schema(f"{days_schema}, bucket int").parquet(f"{arrived}/step={step}")
    touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
    last = _parts(spark, f"{state}/days", step, days_schema, compact_every, touched).groupBy(*hist.SERIES).agg(F.max("date").alias("last_day"))
    judged = rows.drop("bucket").join(last, hist.SERIES, "left").withColumn("is_late", F.coalesce(F.col("date") < F.col("last_day"), F.lit(False))).drop("last_day")
    _write(judged.filter("is_late").drop("is_late"), f"{state}/late", step, buckets)
    _advance(spark, state, step, judged.filter("NOT is_late").drop("is_late"), schema, buckets, compact_every, [b for b in range(buckets) if b % compact_every == batch % compact_every])


def merge_late(spark: SparkSession, state: str, batch: int, since: int = 0, schema: str = LOG, compact_every: int = 20, buckets: int = BUCKETS) -> None:
    """Takes the late rows of the batches `since`..`batch` into the log, after `batch` and before the next one.

    Only series with late rows are replayed, and of these only the days concerned. Rows merged before may be merged again.
    """
    days_schema = schema + DAYS.removeprefix(LOG)
    parts = [f"{state}/late/step={2 * n}" for n in range(since, batch + 1)]
    rows = hist.merge_days(spark.read.schema(days_schema).option("basePath", f"{state}/late").parquet(*parts))
    _advance(spark, state, 2 * batch + 1, rows, schema, buckets, compact_every, [])


def stream_change_log(observations: DataFrame, state: str, checkpoint: str, compact_every: int = 20, merge_late_every: int | None = None, buckets: int = BUCKETS):
    """Starts the job on a stream of observations; it ends when everything available is logged.

    With `merge_late_every` the late rows are merged after each that many batches.
    """
    schema = _keyed(LOG, observations)

    def run(df: DataFrame, batch: int) -> None:
        process_batch(df, batch, state, compact_every, buckets)
        if merge_late_every and (batch + 1) % merge_late_every == 0:
            merge_late(df.sparkSession, state, batch, batch + 1 - merge_late_every, schema, compact_every, buckets)

    return observations.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_change_log(spark: SparkSession, state: str, schema: str = LOG) -> DataFrame:
    """The whole log: of entries of the same day the one of the latest step."""
    return _newest(spark.read.schema(f"{schema}, step int").parquet(f"{state}/log")).filter("price IS NOT NULL")


def read_late(spark: SparkSession, state: str, schema: str = LOG) -> DataFrame:
    """Late rows of all batches: one per series, day and batch, merged into the log or not."""
    return spark.read.schema(f"{schema}{DAYS.removeprefix(LOG)}, step int").parquet(f"{state}/late")
