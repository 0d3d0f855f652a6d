"""Holdings of many owners valued on the price history.

Tables: holdings(owner_id, entity_key, qty), favorites(owner_id, entity_key),
view rows (entity_key, active_price, ...) and view history (entity_key, date, price).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions.skew import spread_join
from offerlens.sources.text_files import write_csv


def canonical_keys(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """alias_key -> canonical_key for every key an item was ever stored under.

    items(entity_key, canonical_id, name, model_no, ordinal), aliases(entity_key, alias_key).
    A key claimed by several items goes to the one first in item order.
    """
    canonical = F.coalesce("canonical_id", F.col("entity_key"))
    own = items.select(canonical.alias("canonical_key"), "ordinal", F.explode(F.array(
        F.concat_ws("_", "name", "model_no"), F.col("entity_key"))).alias("alias_key"))
    listed = aliases.join(items.select("entity_key", canonical.alias("canonical_key"), "ordinal"), "entity_key").select(
        "canonical_key", "ordinal", "alias_key")
    return (
        own.unionByName(listed)
        .filter((F.col("alias_key") != "") & (F.col("alias_key") != F.col("canonical_key")))
        .groupBy("alias_key").agg(F.min_by("canonical_key", "ordinal").alias("canonical_key"))
    )


def migrate_holdings(holdings: DataFrame, favorites: DataFrame, key_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quantities and favourites moved from alias keys onto the canonical key."""
    aliased = key_map.select(F.col("alias_key").alias("entity_key"), "canonical_key")
    target = F.coalesce("canonical_key", "entity_key")
    moved = spread_join(holdings, aliased, ["entity_key"], "left").groupBy("owner_id", target.alias("entity_key")).agg(
        F.sum("qty").cast("long").alias("qty"))
    faved = spread_join(favorites, aliased, ["entity_key"], "left").select("owner_id", target.alias("entity_key")).distinct()
    return moved, faved


def valuation(holdings: DataFrame, view_rows: DataFrame) -> DataFrame:
    """Owned pieces and their present value per owner; items without active offer count with price 0."""
    priced = spread_join(holdings, view_rows.select("entity_key", "active_price"), ["entity_key"], "left")
    return priced.groupBy("owner_id").agg(
        F.sum("qty").cast("long").alias("pieces"),
        F.sum(F.col("qty") * F.coalesce("active_price", F.lit(0))).cast("long").alias("value"),
    )


def _value_moves(holdings: DataFrame, view_history: DataFrame) -> DataFrame:
    """(owner_id, date, move): by how much each owner's value changes on a date on which a price of theirs does.

    As-of prices are replaced by price steps: a step of an item moves the owner's value by qty * step from its date on.
    """
    steps = view_history.withColumn(
        "step", F.col("price") - F.coalesce(F.lag("price").over(Window.partitionBy("entity_key").orderBy("date")), F.lit(0)))
    return spread_join(holdings.filter(F.col("qty") > 0), steps.select("entity_key", "date", "step"), ["entity_key"]).groupBy(
        "owner_id", "date").agg(F.sum(F.col("qty") * F.col("step")).alias("move"))


def valuation_intervals(holdings: DataFrame, view_history: DataFrame) -> DataFrame:
    """(owner_id, from_date, to_date, value): the value of an owner's holdings from a date until just before another (null: until now).

    One row only where the value changes, so there are at most as many as price steps of owned items; before the first one the value is 0.
    """
    by_date = Window.partitionBy("owner_id").orderBy("date")
    moves = _value_moves(holdings, view_history).filter("move <> 0")
    return moves.select(
        "owner_id", F.col("date").alias("from_date"), F.lead("date").over(by_date).alias("to_date"),
        F.sum("move").over(by_date.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("value"))


def valuation_on(intervals: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(owner_id, date, ...) with `value` as of the date.

    Asked dates take part as rows among the owner's interval starts, in one pass over each owner in order of date.
    """
    extra = [c for c in asked.columns if c not in ("owner_id", "date")]
    starts = intervals.select("owner_id", F.col("from_date").alias("date"), F.struct("value").alias("known"), F.lit(None).cast(asked.select(F.struct("date", *extra)).schema[0].dataType).alias("asks"))
    asks = asked.select("owner_id", "date", F.lit(None).cast("struct<value:bigint>").alias("known"), F.struct("date", *extra).alias("asks"))
    upto = Window.partitionBy("owner_id").orderBy("date", F.col("asks").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = starts.unionByName(asks).withColumn("value", F.coalesce(F.last("known", ignorenulls=True).over(upto)["value"], F.lit(0)).cast("long"))
    return both.filter(F.col("asks").isNotNull()).select("owner_id", "date", *[F.col("asks")[c].alias(c) for c in extra], "value")


def valuation_series(holdings: DataFrame, view_history: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """Value of every owner's holdings at each date on which any item changed, as a chart draws it; of the given owners(owner_id) only, if given.

    The frame is owners times dates; `valuation_intervals` holds the same values in as many rows as there are changes.
    """
    held = holdings if owners is None else holdings.join(owners.select("owner_id").distinct(), "owner_id", "left_semi")
    # All dates of all items, in one value: as many elements as the calendar has days.
    calendar = view_history.select("date").distinct().agg(F.collect_set("date").alias("dates")).scalar()
    frame = held.select("owner_id").distinct().withColumn("date", F.explode(calendar))
    so_far = Window.partitionBy("owner_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return frame.join(_value_moves(held, view_history), ["owner_id", "date"], "left").select(
        "owner_id", "date", F.sum(F.coalesce("move", F.lit(0))).over(so_far).cast("long").alias("value"))


def valuation_at(holdings: DataFrame, view_history: DataFrame, view_rows: DataFrame, date) -> DataFrame:
    """Per owned item with a price on or before `date`: value then, now and the difference."""
    day = date if not isinstance(date, str) else F.lit(date).cast("date")
    then = view_history.filter(F.col("date") <= day).groupBy("entity_key").agg(F.max_by("price", "date").alias("then_price"))
    prices = then.join(view_rows.select("entity_key", "active_price"), "entity_key", "left")
    owned = spread_join(holdings.filter(F.col("qty") > 0), prices, ["entity_key"])
    then_value = F.col("qty") * F.col("then_price")
    now_value = F.col("qty") * F.coalesce("active_price", F.lit(0))
    return owned.select("owner_id", "entity_key", "qty", then_value.alias("then_value"), now_value.alias("now_value"),
                        (now_value - then_value).alias("diff"))


def valuation_at_totals(breakdown: DataFrame) -> DataFrame:
    return breakdown.groupBy("owner_id").agg(*[F.sum(c).cast("long").alias(c) for c in ("then_value", "now_value", "diff")])


def export_holdings(holdings: DataFrame, items: DataFrame, view_rows: DataFrame) -> DataFrame:
    """Rows of the holdings file: owned items with price, quantity and subtotal."""
    listed = items.select("entity_key", "name", "model_no").join(
        view_rows.select("entity_key", "active_price", "image_url"), "entity_key", "left")
    price = F.coalesce("active_price", F.lit(0))
    return spread_join(holdings.filter(F.col("qty") > 0), listed, ["entity_key"]).select(
        "owner_id", "name", "model_no", price.alias("price"), "qty", (price * F.col("qty")).alias("subtotal"),
        F.coalesce("image_url", F.lit("")).alias("image_url"))


def write_holdings_csv(rows: DataFrame, path: str) -> None:
    """Quoted CSV, quotes doubled; every file starts with a byte order mark and the header."""
    write_csv(rows, path)


def read_holdings_csv(spark, path: str) -> DataFrame:
    """Rows written by write_holdings_csv, all text, with `seq`: the order of file names, then of rows within a file.

    Quoted cells may hold line breaks, so a file is read by one task; large exports are many files.
    """
    schema = "owner_id string, name string, model_no string, price string, qty string, subtotal string, image_url string"
    raw = spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True)
    # A file is read in order by one task, so the ids rise within it; across files the name decides.
    return raw.withColumn("seq", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")))


def import_holdings(rows: DataFrame, key_map: DataFrame | None = None) -> DataFrame:
    """Holdings from file rows (owner_id, name, model_no, qty text, seq); a later row of a key wins.

    Quantities that do not start with a whole number, or with one beyond 64 bits, become 0; with a key map the legacy keys are migrated.
    """
    qty = F.coalesce(F.regexp_extract(F.trim("qty"), r"^[+-]?\d+", 0).try_cast("long"), F.lit(0))
    holdings = (
        rows.filter(F.col("name").isNotNull() & F.col("model_no").isNotNull() & F.col("qty").isNotNull())
        .groupBy("owner_id", F.concat_ws("_", F.trim("name"), F.trim("model_no")).alias("entity_key"))
        .agg(F.max_by(qty, "seq").alias("qty"))
    )
    if key_map is None:
        return holdings
    none = holdings.select("owner_id", "entity_key").limit(0)
    return migrate_holdings(holdings, none, key_map)[0]


def set_quantities(holdings: DataFrame, edits: DataFrame) -> DataFrame:
    """Last edit (owner_id, entity_key, qty, seq) per key replaces the quantity; negatives become 0."""
    last = edits.groupBy("owner_id", "entity_key").agg(
        F.greatest(F.lit(0), F.coalesce(F.max_by("qty", "seq"), F.lit(0))).cast("long").alias("new_qty"))
    return holdings.join(last, ["owner_id", "entity_key"], "full").select(
        "owner_id", "entity_key", F.coalesce("new_qty", "qty").alias("qty"))


def toggle_favorites(favorites: DataFrame, toggles: DataFrame) -> DataFrame:
    """Each toggle adds or removes: only an odd number of them changes membership."""
    presses = favorites.select("owner_id", "entity_key").distinct().unionByName(toggles.select("owner_id", "entity_key"))
    return presses.groupBy("owner_id", "entity_key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") % 2 == 1).drop("_n")
