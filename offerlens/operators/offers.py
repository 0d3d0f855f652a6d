"""Offers: availability, best offer per item, retention, listing index.

Tables: offers(entity_key, shop_id, latest_price, image_url, source_name, ...),
shops(shop_id, shop_name, ordinal, enabled), items(entity_key, name, model_no, ...).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions.columns import nonblank
from offerlens.operators import history as hist


def unavailable_shops(shops: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """Shops switched off in the registry, paused, or unhealthy with nothing fetched."""
    off = shops.filter(~F.col("enabled")).select("shop_id")
    if report is None:
        return off
    down = report.filter(
        (F.col("status") == "paused") | ((~F.col("healthy")) & (F.coalesce("fetched", F.lit(0)) == 0))
    ).select("shop_id")
    return off.unionByName(down).distinct()


def best_offer(offers: DataFrame, shops: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Highest positive price per item among available shops; ties go to the lower shop ordinal."""
    priced = hist.without_shops(offers, exclude).filter(F.col("latest_price") > 0)
    ranked = priced.join(shops.select("shop_id", "ordinal"), "shop_id", "left")
    order = F.struct("latest_price", -F.coalesce("ordinal", F.lit(2**31 - 1)))
    return ranked.groupBy("entity_key").agg(
        F.max_by("shop_id", order).alias("best_shop_id"),
        F.max("latest_price").alias("best_price"),
        F.max_by("image_url", order).alias("best_image_url"),
    )


def refresh_best(items: DataFrame, offers: DataFrame, history: DataFrame, item_history: DataFrame,
                 shops: DataFrame, exclude: DataFrame | None = None, mode: str = "merge",
                 run_date=None) -> tuple[DataFrame, DataFrame]:
    """Items with their best offer, and the item-level history (entity_key, date, price).

    append: the best price is logged as an observation of `run_date`.
    merge: the best shop's history overrides the item history date by date.
    """
    best = best_offer(offers, shops, exclude)
    refreshed = items.join(best, "entity_key", "left").withColumns({
        "best_shop_id": F.coalesce("best_shop_id", F.lit("")),
        "best_price": F.coalesce("best_price", F.lit(0)).cast("long"),
        "best_image_url": F.coalesce("best_image_url", F.lit("")),
    })
    if mode == "append":
        today = best.join(items.select("entity_key"), "entity_key", "left_semi").select(
            "entity_key", F.lit("*").alias("shop_id"), F.lit(run_date).cast("date").alias("obs_date"),
            F.lit(0).cast("long").alias("obs_seq"), F.col("best_price").alias("price"))
        log, _ = hist.extend_change_log(item_history.withColumn("shop_id", F.lit("*")), today)
        return refreshed, log.select("entity_key", "date", "price")
    if mode == "merge":
        of_best = history.join(best.select("entity_key", F.col("best_shop_id").alias("shop_id")),
                               ["entity_key", "shop_id"], "left_semi")
        return refreshed, hist.override_history(item_history, of_best, ["entity_key"])
    raise ValueError(f"unknown mode: {mode}")


def retain_priced(items: DataFrame, offers: DataFrame) -> DataFrame:
    """Items that any shop, available or not, has a positive price for."""
    return items.join(offers.filter(F.col("latest_price") > 0).select("entity_key"), "entity_key", "left_semi")


def build_listing_index(items: DataFrame, offers: DataFrame, history: DataFrame, shops: DataFrame,
                        exclude: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The narrow tables a listing needs: one row per item, one row per available priced offer.

    Items without an available priced offer are dropped; an item without a best image
    takes the first image in shop order.
    """
    stats = hist.summarize_offers(history, offers, exclude)
    priced = hist.without_shops(offers, exclude).filter(F.col("latest_price") > 0)
    offer_rows = priced.join(stats.drop("latest_price"), hist.SERIES, "left")
    ranked = priced.join(shops.select("shop_id", "ordinal"), "shop_id", "left")
    image = nonblank("image_url")
    first_image = ranked.groupBy("entity_key").agg(
        F.min_by(image, F.when(image.isNotNull(), F.col("ordinal"))).alias("first_image"))
    item_rows = (
        items.select("entity_key", "name", "model_no")
        .join(best_offer(offers, shops, exclude), "entity_key")
        .join(first_image, "entity_key")
        .select("entity_key", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("model_no", F.lit("")).alias("model_no"),
                F.coalesce(nonblank("best_image_url"), "first_image", F.lit("")).alias("image_url"),
                "best_shop_id", F.col("best_price").alias("latest_price"))
    )
    return item_rows, offer_rows.join(item_rows.select("entity_key"), "entity_key", "left_semi")


def nest_listing_index(item_rows: DataFrame, offer_rows: DataFrame) -> DataFrame:
    """Document form for a JSON sink: the offers of an item (at most one per shop) as a map."""
    body = F.struct(*[c for c in offer_rows.columns if c not in hist.SERIES])
    nested = offer_rows.groupBy("entity_key").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("shop_id", body)))).alias("offers_by_shop"))
    return item_rows.join(nested, "entity_key", "left")


def order_canonical(items: DataFrame, locale: str = "ja") -> DataFrame:
    """Price descending, then model number in the locale's collation (a distributed range sort)."""
    return items.orderBy(F.col("best_price").desc(), F.collate(F.col("model_no"), locale), F.col("entity_key"))


def offer_staleness(last_dates: DataFrame, days: int = 3) -> DataFrame:
    """Offers whose last change is `days` or more older than the item's newest one.

    Input has one row per offer, so a window partition holds at most one row per shop.
    """
    newest = F.max("last_date").over(Window.partitionBy("entity_key"))
    return last_dates.withColumn("days_behind", F.coalesce(F.datediff(newest, "last_date"), F.lit(0))).withColumn(
        "stale_since", F.when(F.col("days_behind") >= days, F.col("last_date")))
