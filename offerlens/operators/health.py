"""Health of the sources of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class RunAborted(RuntimeError):
    """Nothing may be written in this run."""


class UnhealthySources(RuntimeError):
    """The data is written, but some source needs attention."""


def source_health(shops: DataFrame, batch: DataFrame, stored_offers: DataFrame, outcomes: DataFrame | None = None,
                  min_baseline: int = 20, drop: float = 0.5) -> DataFrame:
    """Report of a run, one row per enabled shop.

    fetched counts this run's listings, previous the items that already hold an offer of
    the shop. `outcomes(shop_id, error, paused, message)` tells which fetches failed or paused.
    """
    active = shops.filter(F.col("enabled")).select("shop_id", "shop_name")
    fetched = batch.groupBy("shop_id").agg(F.count(F.lit(1)).alias("fetched"))
    # One stored row per (item, shop): a plain count, no distinct needed.
    previous = stored_offers.groupBy("shop_id").agg(F.count(F.lit(1)).alias("previous"))
    report = active.join(fetched, "shop_id", "left").join(previous, "shop_id", "left")
    if outcomes is None:
        report = report.withColumns({"error": F.lit(None).cast("string"), "paused": F.lit(False), "message": F.lit("")})
    else:
        report = report.join(outcomes, "shop_id", "left")
    paused, failed = F.coalesce("paused", F.lit(False)), F.col("error").isNotNull()
    got = F.when(failed | paused, F.lit(0)).otherwise(F.coalesce("fetched", F.lit(0)))
    before = F.coalesce("previous", F.lit(0))
    collapsed = (before >= min_baseline) & (got < before * drop)
    return report.select(
        "shop_id", "shop_name", got.cast("long").alias("fetched"), before.cast("long").alias("previous"),
        F.when(failed, "error").when(paused, "paused").otherwise("active").alias("status"),
        F.when(failed, F.lit(False)).when(paused, F.lit(True)).otherwise(~collapsed).alias("healthy"),
        "error", F.when(paused & ~failed, F.coalesce("message", F.lit(""))).otherwise("").alias("message"),
    )


def run_exclusions(report: DataFrame) -> DataFrame:
    """Shops left out of this run's best offers: failed, paused or unhealthy."""
    return report.filter((F.col("status") != "active") | ~F.col("healthy")).select("shop_id")


def run_gate(report: DataFrame) -> DataFrame:
    """One row telling whether the run may write: some source answered and some row arrived."""
    return report.agg(
        F.count_if(F.col("status") != "error").alias("answered"),
        F.coalesce(F.sum("fetched"), F.lit(0)).cast("long").alias("listings"),
    ).withColumn("may_write", (F.col("answered") > 0) & (F.col("listings") > 0))


def assert_run_gate(report: DataFrame) -> None:
    row = run_gate(report).head()
    if not row["may_write"]:
        raise RunAborted("no source delivered any listing")


def health_summary(report: DataFrame) -> DataFrame:
    """One labelled line per source."""
    paused, ok = F.col("status") == "paused", F.col("healthy")
    label = F.when(paused, "PAUSED").when(ok, "OK").otherwise("NG")
    note = (
        F.when(paused, F.col("message"))
        .when(F.col("error").isNotNull(), F.concat(F.lit("fetch failed: "), "error"))
        .otherwise(F.format_string("previously %d", "previous"))
    )
    return report.select("shop_id", label.alias("label"), "fetched", note.alias("note"),
                         (~ok & ~paused).alias("needs_attention"),
                         F.format_string("%s %s: %d (%s)", label, F.col("shop_id"), F.col("fetched"), note).alias("line"))


def assert_healthy(report: DataFrame) -> None:
    """Raised after writing, so that one broken source does not discard the others' prices."""
    broken = report.filter(~F.col("healthy")).count()
    if broken:
        raise UnhealthySources(f"{broken} source(s) unhealthy")
