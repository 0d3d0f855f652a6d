"""Views of the listing: best offers, one shop, or every offer on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.columns import nonblank
from offerlens.operators import history as hist
from offerlens.operators.offers import best_offer


def item_images(offers: DataFrame, shops: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """(entity_key, item_image): the best offer's image, else that of the first available shop with one; items without any have no row."""
    shown = hist.without_shops(offers, exclude).filter(F.col("image_url") != "").join(shops.select("shop_id", "ordinal"), "shop_id", "left")
    best = best_offer(offers, shops, exclude).select("entity_key", F.col("best_shop_id").alias("shop_id"), F.lit(True).alias("best"))
    order = F.struct(F.coalesce("best", F.lit(False)), -F.coalesce("ordinal", F.lit(2**31 - 1)))
    return shown.join(best, hist.SERIES, "left").groupBy("entity_key").agg(F.max_by("image_url", order).alias("item_image"))


def with_item_images(view_rows: DataFrame, images: DataFrame) -> DataFrame:
    """View rows whose offer has no image show the item's (see `item_images`)."""
    return view_rows.join(images, "entity_key", "left").withColumn("image_url", F.coalesce(nonblank("image_url"), "item_image", F.lit(""))).drop("item_image")


def shop_view(offers: DataFrame, shops: DataFrame, view: str = "best", exclude: DataFrame | None = None) -> DataFrame:
    """Active offer per item: (entity_key, shop_id, active_price, image_url), with the offer's own image.

    `view` is 'best' or a shop id; an unavailable shop has no active offers. `with_item_images` fills in missing images.
    """
    if view == "best":
        return best_offer(offers, shops, exclude).select(
            "entity_key", F.col("best_shop_id").alias("shop_id"), F.col("best_price").alias("active_price"),
            F.coalesce("best_image_url", F.lit("")).alias("image_url"))
    one = hist.without_shops(offers.filter(F.col("shop_id") == view), exclude)
    return one.select("entity_key", "shop_id", F.coalesce("latest_price", F.lit(0)).alias("active_price"),
                      F.coalesce("image_url", F.lit("")).alias("image_url"))


def view_history(history: DataFrame, view_rows: DataFrame, item_history: DataFrame | None = None) -> DataFrame:
    """History of each item's active offer; items without one fall back to their item-level history."""
    active = history.join(view_rows.select(*hist.SERIES), hist.SERIES, "left_semi").select(*hist.SERIES, "date", "price")
    if item_history is None:
        return active
    rest = item_history.join(view_rows.select("entity_key"), "entity_key", "left_anti")
    return active.unionByName(rest.select("entity_key", F.lit("*").alias("shop_id"), "date", "price"))


def view_trend(history: DataFrame, view_rows: DataFrame, item_history: DataFrame | None = None, days: int = 7) -> DataFrame:
    """Movements within a view: freshness date and prices are those of the view itself."""
    active = view_history(history, view_rows, item_history)
    prices = view_rows.select(*hist.SERIES, F.col("active_price").alias("latest_price"))
    return hist.summarize_offers(active, prices, None, days).withColumnRenamed("latest_price", "active_price")


def unmerge(items: DataFrame, offers: DataFrame) -> DataFrame:
    """One row per offer, with the source's own name; holdings keep using merged_key."""
    return items.join(offers.select(*hist.SERIES, "latest_price", "source_name", F.col("image_url").alias("offer_image")),
                      "entity_key").select(
        F.concat_ws("::", F.col("entity_key").cast("string"), "shop_id").alias("entity_key"),
        F.col("entity_key").alias("merged_key"),
        "shop_id",
        F.coalesce(nonblank("source_name"), "name").alias("name"),
        "model_no",
        F.coalesce(nonblank("offer_image"), "image_url", F.lit("")).alias("image_url"),
        F.coalesce("latest_price", F.lit(0)).alias("latest_price"),
    )


def attach_history(offer_rows: DataFrame, history: DataFrame, sources: DataFrame) -> DataFrame:
    """Listing offers with their full history in long form and source URL; rows without history stay, with null date."""
    return (
        offer_rows.join(sources.select(*hist.SERIES, "source_url"), hist.SERIES, "left")
        .withColumn("source_url", F.coalesce("source_url", F.lit("")))
        .join(history.select(*hist.SERIES, "date", "price"), hist.SERIES, "left")
    )


def movement_filter(name: str, high_price: int = 100_000, pct: float = 5.0) -> Column:
    """Predicate on active_price and the movement columns for a named movement list."""
    price = F.col("active_price")
    named = {
        "all": F.lit(True),
        "allTimeHigh": (price > 0) & (price >= F.col("max_price")),
        "surge": F.col("day_pct") >= pct,
        "crash": F.col("day_pct") <= -pct,
        "high": price >= high_price,
        "dailyUp": F.col("day_diff") > 0,
        "dailyDown": F.col("day_diff") < 0,
        "weeklyUp": F.col("week_diff") > 0,
        "weeklyDown": F.col("week_diff") < 0,
    }
    return named[name]


def owned_only(index: DataFrame, holdings: DataFrame) -> DataFrame:
    """Items some holding has a positive quantity of."""
    return index.join(holdings.filter(F.col("qty") > 0).select("entity_key"), "entity_key", "left_semi")


def favorites_only(index: DataFrame, favorites: DataFrame) -> DataFrame:
    return index.join(favorites.select("entity_key"), "entity_key", "left_semi")
