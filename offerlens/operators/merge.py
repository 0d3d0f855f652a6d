"""Record merging: state upserts, survivorship of merged records, re-keying."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.functions.columns import CODE_PATTERN, nonblank
from offerlens.functions.durable import written
from offerlens.functions.ordered import with_max_before
from offerlens.operators import history as hist
from offerlens.operators import offers as off
from offerlens.operators.identity import IdentityRules, resolve_each, resolve_identity


def upsert_observations(items: DataFrame, offers: DataFrame, history: DataFrame, batch: DataFrame):
    """State after a batch of listings; returns (items, offers, history, late observations).

    batch(entity_key, shop_id, obs_date, obs_seq, price, name, model_no, image_url). Stored
    non-empty texts stay; a new item takes its first non-empty listing texts; the last listing of
    (item, shop) gives the offer; whatever the batch does not mention stays as it is.
    """
    def first_text(c):
        return F.min_by(c, F.when(F.col(c) != "", F.col("obs_seq"))).alias(f"new_{c}")

    seen = batch.groupBy("entity_key").agg(*[first_text(c) for c in ("name", "model_no", "image_url")])
    merged_items = items.join(seen, "entity_key", "full").select(
        "entity_key", *[F.coalesce(nonblank(c), nonblank(f"new_{c}"), F.lit("")).alias(c) for c in ("name", "model_no", "image_url")])

    last = batch.groupBy(*hist.SERIES).agg(
        F.max_by("price", "obs_seq").alias("new_price"),
        F.max_by("name", "obs_seq").alias("new_source_name"),
        F.max_by("image_url", F.when(F.col("image_url") != "", F.col("obs_seq"))).alias("new_image"),
    )
    both = offers.join(last, hist.SERIES, "full")
    source_name = F.col("source_name") if "source_name" in offers.columns else F.lit(None).cast("string")
    merged_offers = both.select(
        *hist.SERIES, F.coalesce("new_price", "latest_price").alias("latest_price"),
        F.coalesce(nonblank("new_image"), "image_url", F.lit("")).alias("image_url"),
        F.coalesce("new_source_name", source_name).alias("source_name"))
    log, late = hist.extend_change_log(history, batch)
    return merged_items, merged_offers, log, late


def upsert_observations_of_any_age(items: DataFrame, offers: DataFrame, history: DataFrame, days: DataFrame, batch: DataFrame):
    """As `upsert_observations`, but with the day rows of the log (`history.day_rows`) as part of the state; returns (items, offers, history, days).

    Late observations are merged: the log equals that of all observations together. An offer keeps its fields if the
    series has a later day than the listing.
    """
    seen_until = days.groupBy(*hist.SERIES).agg(F.max("date").alias("_last_day"))
    current = batch.join(seen_until, hist.SERIES, "left").filter(F.col("_last_day").isNull() | (F.col("obs_date") >= F.col("_last_day"))).drop("_last_day")
    merged_items, _, _, _ = upsert_observations(items, offers, history, batch)
    _, merged_offers, _, _ = upsert_observations(items, offers, history, current)
    log, merged_days = hist.merge_late(history, days, batch)
    return merged_items, merged_offers, log, merged_days


@dataclass(frozen=True)
class Store:
    """The stored tables of a run.

    items(entity_key, canonical_id, name, model_no, image_url, ordinal), aliases(entity_key, alias_key),
    offers(entity_key, shop_id, latest_price, image_url, source_name), history(entity_key, shop_id, date, price)
    with the item-level history under shop_id '*'.
    """

    items: DataFrame
    aliases: DataFrame
    offers: DataFrame
    history: DataFrame


def precedence(df: DataFrame, keys: list[str], block: int = 100_000) -> DataFrame:
    """Adds `rank`: the order in which the records of a group override each other.

    Records are merged in `ordinal` order; a record at least as new (last_date) as everything
    before it goes on top, any other below all before it.
    """
    running = with_max_before(df, keys, "ordinal", "last_date", "_newest", block)
    on_top = F.col("_newest").isNull() | F.coalesce(F.col("last_date") >= F.col("_newest"), F.lit(False))
    return running.withColumn("rank", F.when(on_top, F.col("ordinal")).otherwise(-F.col("ordinal") - 1)).drop("_newest")


def merge_offers(offers: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One offer per (item, shop): each field from the newest record that has it (is not null).

    `offers` carries ordinal and last_date, and possibly `rank`, the order of precedence; without it the newest history comes
    first, ties to the later record. last_date and ordinal are those of the newest record. Aggregated before the shuffle.
    """
    keys = keys or hist.SERIES
    fields = [c for c in offers.columns if c not in (*keys, "rank")]
    newest = F.col("rank") if "rank" in offers.columns else F.struct(F.coalesce("last_date", F.lit("0001-01-01").cast("date")), "ordinal")
    whole = ("last_date", "ordinal")
    return offers.groupBy(*keys).agg(*[F.max_by(c, newest if c in whole else F.when(F.col(c).isNotNull(), newest)).alias(c) for c in fields])


def merge_items(items: DataFrame, code_pattern: str = CODE_PATTERN) -> DataFrame:
    """One item per entity_key by field-wise survivorship over records in ordinal order.

    Name: the first canonical record's, else the shortest; model: the first that is nothing but a
    code, else the first; canonical id and image: the first non-empty.
    """
    canonical = F.coalesce("canonical_id", F.lit("")) != ""
    name, model = nonblank("name"), nonblank("model_no")
    by_name = F.struct(~canonical, F.when(canonical, 0).otherwise(F.length("name")), "ordinal")
    by_model = F.struct(~F.coalesce(F.col("model_no").rlike(f"(?i)^(?:{code_pattern})$"), F.lit(False)), "ordinal")

    def first(c):
        return F.min_by(c, F.when(F.col(c) != "", F.col("ordinal")))

    return items.groupBy("entity_key").agg(
        first("canonical_id").alias("canonical_id"),
        F.coalesce(F.min_by("name", F.when(name.isNotNull(), by_name)), F.lit("")).alias("name"),
        F.coalesce(F.min_by("model_no", F.when(model.isNotNull(), by_model)), F.lit("")).alias("model_no"),
        F.coalesce(first("image_url"), F.lit("")).alias("image_url"),
        F.min("ordinal").alias("ordinal"),
    )


def merge_store(store: Store, key_map: DataFrame) -> Store:
    """All tables re-pointed by key_map(entity_key, new_key, ordinal) and merged per new key.

    Former keys and name_model texts become alias keys; these stay in long form, one row per
    alias, so that a key which very many records collapse into never builds one huge value.
    """
    def moved(df: DataFrame, *more: str) -> DataFrame:
        return df.join(key_map.select("entity_key", "new_key", *more), "entity_key")

    items = moved(store.items)
    former = items.select("new_key", F.explode(F.array("entity_key", F.concat_ws("_", "name", "model_no"))).alias("alias_key"))
    listed = moved(store.aliases).select("new_key", "alias_key")
    aliases = former.unionByName(listed).filter((F.col("alias_key") != "") & (F.col("alias_key") != F.col("new_key"))).distinct()

    item_level = moved(store.history.filter(F.col("shop_id") == "*"), "ordinal").select(
        F.col("new_key").alias("entity_key"), "shop_id", "date", "price", F.col("ordinal").alias("rank"))
    of_shops = store.history.filter(F.col("shop_id") != "*")
    ages = of_shops.groupBy(*hist.SERIES).agg(F.max("date").alias("last_date"))
    dated = moved(store.offers.drop("last_date").join(ages, hist.SERIES, "left"), "ordinal")
    # Read by the histories and by the offers: the order is found once.
    ranks = written(precedence(dated, ["new_key", "shop_id"]))
    per_shop = of_shops.join(ranks.select("entity_key", "shop_id", "new_key", "rank"), hist.SERIES).select(
        F.col("new_key").alias("entity_key"), "shop_id", "date", "price", "rank")
    return Store(
        merge_items(items.drop("entity_key").withColumnRenamed("new_key", "entity_key")),
        aliases.withColumnRenamed("new_key", "entity_key"),
        merge_offers(ranks.drop("entity_key").withColumnRenamed("new_key", "entity_key")).drop("ordinal"),
        hist.merge_ranked_histories(per_shop.unionByName(item_level), "rank"),
    )


def identity_key_map(items: DataFrame, rules: IdentityRules) -> DataFrame:
    """entity_key -> new_key recomputed from the item's name and model."""
    return resolve_each(items.select("entity_key", "name", "model_no", "ordinal"), rules).select(
        "entity_key", F.col("identity_key").alias("new_key"), "ordinal")


def with_default_offers(store: Store, shop_id: str) -> Store:
    """Items stored without any offer get one of the given shop, with the item's own price and history."""
    bare = written(store.items.join(store.offers.select("entity_key"), "entity_key", "left_anti"))
    price = F.coalesce("latest_price", F.lit(0)).cast("long") if "latest_price" in store.items.columns else F.lit(0).cast("long")
    made = bare.select("entity_key", F.lit(shop_id).alias("shop_id"), price.alias("latest_price"), "image_url")
    own = store.history.filter(F.col("shop_id") == "*").join(bare.select("entity_key"), "entity_key", "left_semi").withColumn("shop_id", F.lit(shop_id))
    return Store(store.items, store.aliases, store.offers.unionByName(made, allowMissingColumns=True), store.history.unionByName(own))


def rekey(store: Store, rules: IdentityRules, default_shop: str | None = None) -> Store:
    """Store under recomputed identity keys; items that now share a key are merged in item order."""
    if default_shop is not None:
        store = with_default_offers(store, default_shop)
    # The key map is read by every table of the store; names are parsed once.
    return merge_store(store, written(identity_key_map(store.items, rules)))


def _split(df: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with one of the keys, all others)."""
    return df.join(keys, "entity_key", "left_semi"), df.join(keys, "entity_key", "left_anti")


def rekey_changed(store: Store, rules: IdentityRules, touched: DataFrame | None = None, default_shop: str | None = None) -> Store:
    """Store under recomputed keys, of which only the items whose key changes are merged; offers without the by-product `last_date`.

    Every item's key is recomputed, or only that of touched(entity_key): items added or renamed since the last re-key. Those with another
    key, the touched ones and the items that already hold one of their new keys are merged as `rekey` does; all other rows pass as
    they are. So the result is that of `rekey` if the others come from an earlier re-key, which listed their texts among their aliases.
    The lists of keys are written tables: while they are below Spark's broadcast threshold, no row of another item is shuffled.
    """
    if default_shop is not None:
        store = with_default_offers(store, default_shop)
    if touched is None:
        found = identity_key_map(store.items, rules).filter("entity_key <> new_key")
    else:
        found = identity_key_map(_split(store.items, touched.select("entity_key"))[0], rules)
    moved = written(found)
    taken = moved.select(F.col("new_key").alias("entity_key"))
    holders = _split(store.items.select("entity_key", "ordinal"), taken)[0]
    stay = _split(holders, moved.select("entity_key"))[1].select("entity_key", F.col("entity_key").alias("new_key"), "ordinal")
    key_map = written(moved.unionByName(stay))
    keys = key_map.select("entity_key")
    (items, other_items), (aliases, other_aliases), (offers, other_offers), (history, other_history) = (
        _split(df, keys) for df in (store.items, store.aliases, store.offers.drop("last_date"), store.history))
    merged = merge_store(Store(items, aliases, offers, history), key_map)
    return Store(
        merged.items.unionByName(other_items.select(*merged.items.columns)),
        merged.aliases.unionByName(other_aliases.select(*merged.aliases.columns)),
        merged.offers.drop("last_date").unionByName(other_offers),
        merged.history.unionByName(other_history.select(*merged.history.columns)),
    )


def finish_store(store: Store, shops: DataFrame, exclude: DataFrame | None = None) -> Store:
    """Best offers recomputed (histories merged), items without any priced offer dropped. A sink orders the items (`order_canonical`).

    Items, offers and histories are read several times: they are written once instead of being merged again.
    """
    store = Store(written(store.items), store.aliases, written(store.offers), written(store.history))
    item_log = store.history.filter(F.col("shop_id") == "*").select("entity_key", "date", "price")
    of_shops = store.history.filter(F.col("shop_id") != "*")
    refreshed, log = off.refresh_best(store.items, store.offers, of_shops, item_log, shops, exclude, "merge")
    kept = off.retain_priced(refreshed, store.offers)
    history = of_shops.unionByName(log.withColumn("shop_id", F.lit("*"))).join(kept.select("entity_key"), "entity_key", "left_semi")
    return Store(kept, store.aliases, store.offers, history)


def migrate_keys(store: Store, alias_members: DataFrame, shops: DataFrame, rules: IdentityRules,
                 exclude: DataFrame | None = None, only_changed: bool = False) -> tuple[Store, DataFrame]:
    """Whole store re-keyed and finished, and alias members with recomputed source keys and a `changed` flag.

    `only_changed` re-keys by `rekey_changed`: for stores that an earlier re-key has made.
    """
    resolved = resolve_identity(alias_members, rules)
    members = resolved.withColumn("changed", ~F.col("source_key").eqNullSafe(F.col("identity_key"))).withColumn(
        "source_key", F.col("identity_key")).select(*alias_members.columns, "changed")
    return finish_store((rekey_changed if only_changed else rekey)(store, rules), shops, exclude), members
