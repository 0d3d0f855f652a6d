"""The streaming change log fed with the event stream in three deliveries."""

import uuid

from pyspark.sql import functions as F

from offerlens.functions.durable import shared_folder
from offerlens.plans.registry import query
from offerlens.streaming import change_log


@query("st1_stream_change_log", "SELECT entity_key, shop_id, date, price FROM hist")
def stream_change_log(i):
    base = f"{shared_folder(i.spark)}/stream-{uuid.uuid4().hex}"
    observations = i.obs
    # Deliveries end within a day, so that later ones overwrite entries of a day already logged.
    bounds = observations.agg(F.percentile_approx("obs_seq", [1 / 3, 2 / 3]).alias("b")).head()["b"]
    edges = [None, *bounds, None]
    for low, high in zip(edges, edges[1:]):
        part = observations
        part = part if low is None else part.filter(F.col("obs_seq") > low)
        part = part if high is None else part.filter(F.col("obs_seq") <= high)
        part.write.mode("append").parquet(f"{base}/in")
        arriving = i.spark.readStream.schema(change_log.OBSERVATIONS).parquet(f"{base}/in")
        change_log.stream_change_log(arriving, f"{base}/state", f"{base}/checkpoint", compact_every=2, buckets=8).awaitTermination()
    return change_log.read_change_log(i.spark, f"{base}/state")


@query("st1_late_merge", "SELECT entity_key, shop_id, date, price FROM hist")
def late_merge(i):
    """Deliveries in any order of days: most rows of the later ones are late, and merging them gives the log of all rows."""
    base = f"{shared_folder(i.spark)}/stream-{uuid.uuid4().hex}"
    delivery = F.pmod(F.xxhash64("obs_seq"), F.lit(3))
    for number in range(3):
        i.obs.filter(delivery == number).write.mode("append").parquet(f"{base}/in")
        arriving = i.spark.readStream.schema(change_log.OBSERVATIONS).parquet(f"{base}/in")
        change_log.stream_change_log(arriving, f"{base}/state", f"{base}/checkpoint", compact_every=2, merge_late_every=1, buckets=8).awaitTermination()
    return change_log.read_change_log(i.spark, f"{base}/state")
