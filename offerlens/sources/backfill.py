"""Bulk load of old price rows of one shop: rows(date, name, model, price, seq), all text but seq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.columns import nonblank
from offerlens.functions.unicode import nfkc
from offerlens.operators import history as hist
from offerlens.operators import offers as off

MODEL_PREFIX = r"^型(?:番)?[:：\s]*"
DATE_FORMATS = ("yyyy/M/d", "yyyy-M-d", "yyyy/M/d H:m:s", "yyyy-M-d H:m:s")


def clean_model(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(c), MODEL_PREFIX, ""))


def backfill_key(name: Column, model: Column) -> Column:
    """Width-folded, space-free, lower-case model_name key."""
    return F.lower(F.regexp_replace(nfkc(F.concat_ws("_", clean_model(model), F.trim(name))), r"(?U)\s+", ""))


def parse_date(c: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in DATE_FORMATS]).cast("date")


def backfill_history(rows: DataFrame, meta: DataFrame, items: DataFrame, history: DataFrame, shop_id: str):
    """Returns (items, history, counters).

    Rows with a readable date, texts and a positive price count; of a key's rows of one date the last
    one does. Known keys keep their item; new items take name, model and image from
    meta(name, model, image_url), else from their newest row. Loaded prices override stored ones by date.
    """
    def keyed(df, *more):
        """Key per distinct (name, model), so that the Python function sees each spelling once."""
        keys = df.select("name", "model").distinct().withColumn("entity_key", backfill_key(F.col("name"), F.col("model")))
        return df.join(keys, ["name", "model"]).select("entity_key", F.trim("name").alias("name"), clean_model(F.col("model")).alias("model_no"), *more)

    price = F.floor(F.col("price").try_cast("double")).cast("long")
    usable = keyed(
        rows.filter((F.trim("name") != "") & (clean_model(F.col("model")) != "")),
        parse_date(F.col("date")).alias("date"), price.alias("price"), "seq",
    ).filter(F.col("date").isNotNull() & (F.col("price") > 0))
    loaded = usable.groupBy("entity_key", "date").agg(F.max_by("price", "seq").alias("price"))
    samples = usable.groupBy("entity_key").agg(F.max_by(F.struct("name", "model_no"), F.struct("date", "seq")).alias("sample"))
    known = keyed(meta, "image_url").groupBy("entity_key").agg(F.max(F.struct("name", "model_no", "image_url")).alias("m"))

    fresh = samples.join(items.select("entity_key"), "entity_key", "left_anti").join(known, "entity_key", "left").select(
        "entity_key", F.coalesce(nonblank("m.name"), "sample.name").alias("name"),
        F.coalesce(nonblank("m.model_no"), "sample.model_no").alias("model_no"), F.coalesce("m.image_url", F.lit("")).alias("image_url"))
    all_items = items.select("entity_key", "name", "model_no", "image_url").unionByName(fresh)
    log = hist.override_history(history, loaded.withColumn("shop_id", F.lit(shop_id)))
    counters = loaded.agg(F.count(F.lit(1)).alias("rows_imported")).withColumn(
        "items_created", fresh.agg(F.count(F.lit(1)).alias("n")).scalar())
    return all_items, log, counters


def renew_offers(items: DataFrame, offers: DataFrame, history: DataFrame, shop_id: str) -> DataFrame:
    """Offers after a load into a shop's history: its offer of each item has the newest logged price, and the item's image where it had none.

    Offers of other shops stay; columns the new offers lack are null.
    """
    newest = history.filter(F.col("shop_id") == shop_id).groupBy("entity_key").agg(F.max_by("price", "date").alias("newest_price"))
    held = offers.filter(F.col("shop_id") == shop_id).select("entity_key", F.col("image_url").alias("held_image"), *[c for c in offers.columns if c not in (*hist.SERIES, "latest_price", "image_url")])
    renewed = newest.join(held, "entity_key", "left").join(items.select("entity_key", F.col("image_url").alias("item_image")), "entity_key", "left").withColumns({
        "shop_id": F.lit(shop_id), "latest_price": F.col("newest_price"), "image_url": F.coalesce(nonblank("held_image"), "item_image", F.lit(""))})
    others = offers.join(renewed.select(*hist.SERIES), hist.SERIES, "left_anti")
    return others.unionByName(renewed.select(*offers.columns))


def finish_backfill(items: DataFrame, offers: DataFrame, history: DataFrame, shop_id: str, shops: DataFrame, exclude: DataFrame | None = None):
    """(items, offers) after a load: the shop's offers renewed, best offers chosen again, items without a priced offer dropped."""
    renewed = renew_offers(items, offers, history, shop_id)
    no_log = history.select("entity_key", "date", "price").limit(0)
    best, _ = off.refresh_best(items, renewed, history, no_log, shops, exclude, "merge")
    return off.retain_priced(best, renewed), renewed
