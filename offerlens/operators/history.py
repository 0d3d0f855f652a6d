"""Price history: the change log and the movements read from it.

Tables: observations(entity_key, shop_id, obs_date, obs_seq, price) and
history(entity_key, shop_id, date, price), one row per price change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions.columns import percent_of

SERIES = ["entity_key", "shop_id"]


def daily_prices(observations: DataFrame) -> DataFrame:
    """Last, lowest and highest price per series and day (combined before the shuffle)."""
    return observations.groupBy(*SERIES, F.col("obs_date").alias("date")).agg(
        F.max_by("price", "obs_seq").alias("price"),
        F.min("price").alias("low"),
        F.max("price").alias("high"),
    )


def to_change_log(observations: DataFrame) -> DataFrame:
    """A day has an entry iff some price seen that day differs from the previous day's last price.

    This closed form equals replaying the observations one by one. After the daily
    aggregate a series has at most one row per calendar day, so the window stays small
    even if one series holds most observations.
    """
    previous = F.lag("price").over(Window.partitionBy(*SERIES).orderBy("date"))
    return (
        daily_prices(observations)
        .withColumn("previous", previous)
        .filter(F.col("previous").isNull() | (F.col("low") != F.col("previous")) | (F.col("high") != F.col("previous")))
        .select(*SERIES, "date", "price")
    )


def day_rows(observations: DataFrame) -> DataFrame:
    """(series, date, price, seq, low, high): what a log needs to know of a day; `merge_days` adds two such tables."""
    return observations.groupBy(*SERIES, F.col("obs_date").alias("date")).agg(
        F.max_by("price", "obs_seq").alias("price"), F.max("obs_seq").alias("seq"), F.min("price").alias("low"), F.max("price").alias("high"))


def merge_days(days: DataFrame) -> DataFrame:
    """One row per series and day of any number of day rows, in any order; a row given twice changes nothing."""
    return days.groupBy(*SERIES, "date").agg(
        F.max_by("price", "seq").alias("price"), F.max("seq").alias("seq"), F.min("low").alias("low"), F.max("high").alias("high"))


def log_patch(days: DataFrame, touched: DataFrame) -> DataFrame:
    """(series, date, price): log entries of the touched days and of the days right after them; a null price means no entry.

    `days` holds all days of the series concerned, after the change; touched(series, date).
    """
    marked = days.join(touched.select(*SERIES, "date").distinct().withColumn("changed", F.lit(True)), [*SERIES, "date"], "left")
    by_day = Window.partitionBy(*SERIES).orderBy("date")
    previous, after = F.lag("price").over(by_day), F.lag("changed").over(by_day)
    known = marked.withColumns({"previous": previous, "after": after})
    entry = F.col("previous").isNull() | (F.col("low") != F.col("previous")) | (F.col("high") != F.col("previous"))
    return known.filter(F.col("changed") | F.col("after")).select(*SERIES, "date", F.when(entry, F.col("price")).alias("price"))


def merge_late(history: DataFrame, days: DataFrame, late: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(change log, day rows) after observations of any age; equal to the log of all observations together.

    history and days are those of the observations so far. Only series with late observations are replayed.
    """
    rows = day_rows(late)
    merged = merge_days(days.unionByName(rows))
    concerned = merged.join(rows.select(*SERIES).distinct(), SERIES, "left_semi")
    patch = log_patch(concerned, rows)
    both = history.select(*SERIES, "date", "price", F.lit(0).alias("side")).unionByName(patch.select(*SERIES, "date", "price", F.lit(1).alias("side")))
    newest = F.max_by(F.struct("price"), "side").alias("newest")
    return both.groupBy(*SERIES, "date").agg(newest).select(*SERIES, "date", "newest.price").filter("price IS NOT NULL"), merged


def history_tails(history: DataFrame) -> DataFrame:
    """Last entry of every series."""
    return history.groupBy(*SERIES).agg(F.max("date").alias("date"), F.max_by("price", "date").alias("price"))


def log_changes(tails: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries to add or overwrite, late observations) for observations that follow a log with these tails.

    The stored tail takes part as an earlier observation of its own day, which makes the
    closed form continue where the log stopped. Observations before their series' tail are late.
    """
    known = tails.select(*SERIES, F.col("date").alias("tail_date"), F.col("price").alias("tail_price"))
    # One row per series and day before anything is joined, so that a hot series is as long as its calendar.
    days = observations.groupBy(*SERIES, F.col("obs_date").alias("date")).agg(F.max_by("price", "obs_seq").alias("price"), F.min("price").alias("low"), F.max("price").alias("high"))
    tagged = days.join(known, SERIES, "left")
    late_days = tagged.filter(F.col("date") < F.col("tail_date")).select(*SERIES, F.col("date").alias("obs_date"))
    late = observations.join(late_days, [*SERIES, "obs_date"], "left_semi").select(*observations.columns)

    by_day = Window.partitionBy(*SERIES).orderBy("date")
    changed = (
        tagged.filter(F.col("tail_date").isNull() | (F.col("date") >= F.col("tail_date")))
        .withColumn("previous", F.coalesce(F.lag("price").over(by_day), F.col("tail_price")))
        .filter(
            F.col("previous").isNull()
            | (F.col("date") == F.col("tail_date"))
            | (F.col("low") != F.col("previous"))
            | (F.col("high") != F.col("previous"))
        )
        .select(*SERIES, "date", "price")
    )
    return changed, late


def extend_change_log(history: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Change log after new observations, and the late ones among them."""
    changed, late = log_changes(history_tails(history), observations)
    return override_history(history, changed), late


def override_history(existing: DataFrame, incoming: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Union of two histories per date; where both have the date the incoming price holds."""
    keys = keys or SERIES
    both = existing.select(*keys, "date", "price", F.lit(0).alias("side")).unionByName(
        incoming.select(*keys, "date", "price", F.lit(1).alias("side"))
    )
    return merge_ranked_histories(both, "side", keys)


def merge_ranked_histories(history: DataFrame, rank: str, keys: list[str] | None = None) -> DataFrame:
    """N-way merge: per date the price of the highest rank; rows without date dropped, null price 0."""
    keys = keys or SERIES
    return (
        history.filter(F.col("date").isNotNull())
        .groupBy(*keys, "date")
        .agg(F.max_by(F.coalesce("price", F.lit(0)), rank).cast("long").alias("price"))
    )


def without_shops(df: DataFrame, exclude: DataFrame | None) -> DataFrame:
    """Rows whose shop is not in the (small) exclusion table."""
    return df if exclude is None else df.join(exclude.select("shop_id"), "shop_id", "left_anti")


def latest_date(history: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """One row: the newest date in any series of an available shop."""
    return without_shops(history, exclude).agg(F.max("date").alias("latest_date"))


def _with_previous(history: DataFrame) -> DataFrame:
    return history.withColumn("previous", F.lag("price").over(Window.partitionBy(*SERIES).orderBy("date")))


def _day_columns(latest: Column) -> list[Column]:
    shown = (F.max("date") == latest) & (F.count(F.lit(1)) >= 2)
    last, previous = F.max_by("price", "date"), F.max_by("previous", "date")
    return [
        F.when(shown, last - previous).otherwise(F.lit(0)).cast("long").alias("day_diff"),
        F.when(shown, percent_of(last - previous, previous)).otherwise(F.lit(0.0)).alias("day_pct"),
    ]


def _week_columns(latest: Column, days: int) -> list[Column]:
    edge = F.date_sub(latest, days)
    before = F.max_by(F.when(F.col("date") <= edge, F.col("price")), F.when(F.col("date") <= edge, F.col("date")))
    return [
        F.coalesce(before, F.min_by("price", "date")).alias("week_base"),
        (F.coalesce(F.max("date") > edge, F.lit(False)) & (F.count(F.lit(1)) >= 2)).alias("week_shown"),
    ]


def _range_columns() -> list[Column]:
    price = F.coalesce("price", F.lit(0)).cast("long")
    return [F.min(price).alias("min_price"), F.max(price).alias("max_price"), F.max("date").alias("last_date")]


def _week_result(df: DataFrame, offers: DataFrame) -> DataFrame:
    """Turns the weekly baseline into differences, using the offer's price where it has one."""
    current = F.coalesce(F.when(F.col("latest_price") != 0, F.col("latest_price")), F.col("last_price"), F.lit(0))
    diff = F.when(F.col("week_shown"), current - F.col("week_base")).otherwise(F.lit(0))
    return (
        df.join(offers.select(*SERIES, "latest_price"), SERIES, "left")
        .withColumn("week_diff", diff.cast("long"))
        .withColumn("week_pct", F.when(F.col("week_shown"), percent_of(F.col("week_diff"), F.col("week_base"))).otherwise(F.lit(0.0)))
        .drop("week_base", "week_shown", "last_price", "latest_price")
    )


def day_trend(history: DataFrame, latest: Column) -> DataFrame:
    """Difference of the last two log entries, shown only for series updated on the latest date."""
    return _with_previous(history).groupBy(*SERIES).agg(*_day_columns(latest))


def week_trend(history: DataFrame, offers: DataFrame, latest: Column, days: int = 7) -> DataFrame:
    """Current price against the last entry at least `days` old (else the first entry)."""
    base = history.groupBy(*SERIES).agg(*_week_columns(latest, days), F.max_by("price", "date").alias("last_price"))
    return _week_result(base, offers)


def price_range(history: DataFrame) -> DataFrame:
    """Lowest and highest logged price and the date of the last entry."""
    return history.groupBy(*SERIES).agg(*_range_columns())


def summarize_offers(history: DataFrame, offers: DataFrame, exclude: DataFrame | None = None, days: int = 7,
                     latest: Column | None = None) -> DataFrame:
    """All movements of every available offer; window and aggregate share one shuffle on the series.

    Offers without any history get zeros and a null last date.
    """
    history, offers = without_shops(history, exclude), without_shops(offers, exclude)
    latest = latest_date(history).scalar() if latest is None else latest
    stats = _with_previous(history).groupBy(*SERIES).agg(
        *_day_columns(latest), *_week_columns(latest, days), *_range_columns(),
        F.max_by("price", "date").alias("last_price"),
    )
    current = F.coalesce(F.when(F.col("latest_price") != 0, F.col("latest_price")), F.col("last_price"), F.lit(0))
    shown = F.coalesce("week_shown", F.lit(False))
    week = F.when(shown, current - F.col("week_base")).otherwise(F.lit(0)).cast("long")
    return offers.select(*SERIES, "latest_price").join(stats, SERIES, "left").select(
        *SERIES,
        "latest_price",
        F.coalesce("day_diff", F.lit(0)).alias("day_diff"),
        F.coalesce("day_pct", F.lit(0.0)).alias("day_pct"),
        week.alias("week_diff"),
        F.when(shown, percent_of(week, F.col("week_base"))).otherwise(F.lit(0.0)).alias("week_pct"),
        F.coalesce("min_price", F.lit(0)).alias("min_price"),
        F.coalesce("max_price", F.lit(0)).alias("max_price"),
        "last_date",
    )


def history_series(view_history: DataFrame, entity_key=None) -> DataFrame:
    """Ordered price series of one item, or of all items, in a chosen view."""
    chosen = view_history if entity_key is None else view_history.filter(F.col("entity_key") == F.lit(entity_key))
    return chosen.select("entity_key", "date", "price").orderBy("entity_key", "date")
