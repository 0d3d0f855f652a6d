"""Attribute filters, facets, series, sorting and paging of the listing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions.columns import bounded_code, nonblank
from offerlens.functions.durable import written
from offerlens.functions.unicode import nfkc

# Labels and marks with which the attribute dimension spells its contents.
COST_LABEL = "コスト"
BLOCKER_MARK = "【ブロッカー】"
UNLISTED_TYPE = "ドン!!"
ALTERNATE_ART = r"(?i)パラレル|コミパラ|スーパー\s*パラレル|スペシャル|別イラスト|絵違い|漫画背景|\bSP\b"
COLOR_ORDER = ("赤", "青", "緑", "紫", "黒", "黄")
TYPE_ORDER = ("LEADER", "CHARACTER", "EVENT", "STAGE")
RARITY_ORDER = ("L", "SEC", "SP", "SR", "R", "UC", "C", "P")


@dataclass(frozen=True)
class DetailFilter:
    """Values are alternatives within a group; all groups must hold. Empty groups do not filter."""

    colors: tuple[str, ...] = ()
    costs: tuple[str, ...] = ()
    powers: tuple[str, ...] = ()
    counters: tuple[str, ...] = ()
    attributes: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    rarities: tuple[str, ...] = ()
    blocks: tuple[str, ...] = ()
    # Any of 'blocker', 'trigger', 'vanilla', 'alternate'; every one given must hold.
    extras: tuple[str, ...] = ()
    series: str = ""
    min_price: float | None = None
    max_price: float | None = None


def number_key(c: Column) -> Column:
    return F.upper(F.trim(nfkc(F.coalesce(c, F.lit("")))))


def attach_details(items: DataFrame, details: DataFrame) -> DataFrame:
    """Items with a `details` struct: by exact model number if there is one, else by the code in model or name.

    details(card_number, ...) holds one row per number; unmatched items get a null struct.
    """
    numbered = details.withColumn("_number", number_key(F.col("card_number"))).filter(F.col("_number") != "")
    rows = numbered.groupBy("_number").agg(F.max(F.struct(*details.columns)).alias("_d"))
    model = number_key(F.col("model_no"))
    coded = items.withColumn("_exact", model).withColumn(
        "_coded", F.coalesce(bounded_code(F.col("_exact")), bounded_code(number_key(F.col("name")))))
    exact = rows.select(F.col("_number").alias("_exact"), F.col("_d").alias("_by_exact"))
    by_code = rows.select(F.col("_number").alias("_coded"), F.col("_d").alias("_by_code"))
    return (
        coded.join(exact, "_exact", "left").join(by_code, "_coded", "left")
        .withColumn("details", F.coalesce("_by_exact", "_by_code")).drop("_exact", "_coded", "_by_exact", "_by_code")
    )


def series_of(model_no: Column, name: Column, card_number: Column | None = None) -> Column:
    """Series prefix from the attached number, else the code in the model, else in the name; '' if none."""
    number = F.coalesce(bounded_code(model_no), bounded_code(name), F.lit(""))
    if card_number is not None:
        number = F.coalesce(nonblank(F.upper(F.trim(card_number))), number)
    return F.split_part(number, F.lit("-"), F.lit(1))


def series_filter(series: Column, button: str, exact: bool = False) -> Column:
    """Rows of a series button. The button's dash is dropped and the rest taken as a prefix, unless exact."""
    wanted = button.replace("-", "")
    return F.lit(True) if button == "all" else (series == wanted if exact else series.startswith(wanted))


def _number_or_zero(c: str) -> Column:
    value = F.col(c).cast("string")
    return F.when(value.isNull() | (value == "-"), "0").otherwise(value)


def detail_predicate(f: DetailFilter) -> Column:
    """Predicate on rows with name, model_no, active_price and details."""
    d = "details."
    text = {c: F.coalesce(F.col(d + c).cast("string"), F.lit("")) for c in ("card_type", "rarity", "block", "effect_text", "trigger")}
    tests: list[Column] = []
    if f.colors:
        tests.append(F.coalesce(F.arrays_overlap(F.col(d + "color"), F.array(*map(F.lit, f.colors))), F.lit(False)))
    if f.costs:
        tests.append((F.coalesce(F.col(d + "cost_type"), F.lit("")) == COST_LABEL) & _number_or_zero(d + "cost_value").isin(*f.costs))
    if f.powers:
        tests.append(_number_or_zero(d + "power").isin(*f.powers))
    if f.counters:
        tests.append(F.coalesce(F.col(d + "counter").cast("string"), F.lit("-")).isin(*f.counters))
    if f.attributes:
        parts = F.split(F.when(F.col(d + "attribute") != "-", F.col(d + "attribute")), "/")
        tests.append(F.coalesce(F.arrays_overlap(parts, F.array(*map(F.lit, f.attributes))), F.lit(False)))
    for values, column in ((f.types, "card_type"), (f.rarities, "rarity"), (f.blocks, "block")):
        if values:
            tests.append(text[column].isin(*values))
    if f.series:
        tests.append(series_of(F.col("model_no"), F.col("name"), F.col(d + "card_number")) == f.series)
    low, high = f.min_price, f.max_price
    if low is not None and high is not None and low > high:
        low, high = high, low
    if low is not None:
        tests.append(F.col("active_price") >= low)
    if high is not None:
        tests.append(F.col("active_price") <= high)
    extras = {
        "blocker": text["effect_text"].contains(BLOCKER_MARK),
        "trigger": ~text["trigger"].isin("", "-"),
        "vanilla": text["effect_text"].isin("", "-"),
        "alternate": F.coalesce(F.col("name"), F.lit("")).rlike(ALTERNATE_ART),
    }
    tests += [extras[e] for e in f.extras]
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def detail_filter(index: DataFrame, f: DetailFilter) -> DataFrame:
    return index.filter(detail_predicate(f))


def facet_values(index: DataFrame, colors=COLOR_ORDER, types=TYPE_ORDER, rarities=RARITY_ORDER) -> DataFrame:
    """(facet, value, label, position): the values to choose from, in display order, in one pass.

    Input has name, model_no, ordinal and details. Preferred values come first in their given order, the
    rest and the numeric facets in numeric order with '-' ahead.
    """
    d = "details."

    def text(c):
        return nonblank(F.col(d + c).cast("string"))

    def of(facet, values):
        return F.transform(values, lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value")))

    def zero_for_dash(c):
        return F.when(c == "-", "0").otherwise(c)

    series = nonblank(series_of(F.col("model_no"), F.col("name"), F.col(d + "card_number")))
    groups = F.concat(
        of("colors", F.coalesce(d + "color", F.array().cast("array<string>"))),
        of("costs", F.array(F.when(F.col(d + "cost_type") == COST_LABEL, zero_for_dash(F.col(d + "cost_value").cast("string"))))),
        of("powers", F.array(zero_for_dash(text("power")))),
        of("counters", F.array(text("counter"))),
        of("attributes", F.coalesce(F.filter(F.split(F.when(text("attribute") != "-", text("attribute")), "/"), lambda v: v != ""), F.array().cast("array<string>"))),
        of("types", F.array(F.when(text("card_type") != UNLISTED_TYPE, text("card_type")))),
        of("rarities", F.array(text("rarity"))),
        of("blocks", F.array(text("block"))),
        of("series", F.array(series)),
    )
    title = F.when(F.col("facet") == "series", F.concat_ws(" - ", "value", text("series_title"))).otherwise(F.col("value"))
    found = (
        index.select("ordinal", "details", F.explode(groups).alias("g")).select("ordinal", "details", "g.facet", "g.value")
        .filter(F.col("value").isNotNull()).withColumn("label", title)
        .groupBy("facet", "value").agg(F.min_by("label", "ordinal").alias("label"))
    )
    preferred = F.coalesce(*[
        F.when((F.col("facet") == facet) & (F.array_position(F.array(*map(F.lit, order)), F.col("value")) > 0),
               F.array_position(F.array(*map(F.lit, order)), F.col("value")))
        for facet, order in (("colors", colors), ("types", types), ("rarities", rarities)) if order], F.lit(2**31 - 1))
    number = F.when(F.col("value") == "-", F.lit(float("-inf"))).otherwise(F.col("value").try_cast("double"))
    head, digits = F.regexp_extract("value", r"^(\D*)", 1), F.regexp_extract("value", r"(\d+)", 1).try_cast("long")
    # One row per distinct facet value by now.
    order = Window.partitionBy("facet").orderBy(preferred, number.asc_nulls_last(), head, digits, "value")
    return found.withColumn("position", F.row_number().over(order))


SORTS = {
    "priceDesc": ("active_price", False), "priceAsc": ("active_price", True),
    "trendDesc": ("day_diff", False), "trendAsc": ("day_diff", True),
    "weeklyDesc": ("week_diff", False), "weeklyAsc": ("week_diff", True),
    "modelAsc": ("model_no", True),
}


def sort_order(mode: str) -> list[Column]:
    column, ascending = SORTS.get(mode, SORTS["modelAsc"])
    return [F.col(column).asc() if ascending else F.col(column).desc(), F.col("entity_key").asc()]


def sort_listing(df: DataFrame, mode: str) -> DataFrame:
    """Rows in one of the seven orders; ties by entity_key."""
    return df.orderBy(*sort_order(mode))


def page(df: DataFrame, mode: str, limit: int = 300) -> DataFrame:
    """First `limit` rows of an order with position and the total number of rows."""
    return Pages(df, mode, limit).first()


class Pages:
    """Pages of one order over rows that are computed once.

    The rows are written, so a page and the total come from a table and the input is read a single time. A page starts behind the last row of the
    one before (`page_key`): what earlier pages showed is filtered out before the top rows are picked, and nothing is sorted but a page.
    """

    def __init__(self, df: DataFrame, mode: str, limit: int = 300):
        self.rows, self.mode, self.limit = written(df), mode, limit

    def first(self) -> DataFrame:
        return self._numbered(self.rows, 0)

    def after(self, key: dict) -> DataFrame:
        """The page behind a row given by `page_key`."""
        column, ascending = SORTS.get(self.mode, SORTS["modelAsc"])
        value, entity, at = F.lit(key["value"]), F.lit(key["entity_key"]), F.col(column)
        # Nulls come first in an ascending order and last in a descending one, as Spark sorts them.
        if key["value"] is None:
            beyond = at.isNotNull() if ascending else F.lit(False)
            same = at.isNull()
        else:
            beyond = at > value if ascending else (at < value) | at.isNull()
            same = at == value
        return self._numbered(self.rows.filter(beyond | (same & (F.col("entity_key") > entity))), key["position"])

    def page_key(self, shown: DataFrame) -> dict | None:
        """Where a shown page ends: its last row's sort value, key and position; None if it is empty."""
        column, _ = SORTS.get(self.mode, SORTS["modelAsc"])
        last = shown.select(F.col(column).alias("value"), "entity_key", "position").orderBy(F.desc("position")).first()
        return None if last is None else last.asDict()

    def _numbered(self, rows: DataFrame, shown: int) -> DataFrame:
        # The top rows are picked per partition; only they are numbered in one task.
        top = rows.orderBy(*sort_order(self.mode)).limit(self.limit)
        numbered = top.withColumn("position", F.row_number().over(Window.orderBy(*sort_order(self.mode))) + shown)
        return numbered.withColumn("total", self.rows.agg(F.count(F.lit(1)).alias("n")).scalar())
