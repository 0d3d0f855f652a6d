"""The listing query end to end: cheap predicates first, then the text match, then one page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.operators import listing_filters as lf
from offerlens.operators.search import match_queries
from offerlens.operators.views import favorites_only, movement_filter, owned_only


def movement_index(item_rows: DataFrame, offer_rows: DataFrame) -> DataFrame:
    """Listing items with the movements of their best offer."""
    stats = offer_rows.select("entity_key", F.col("shop_id").alias("best_shop_id"), "day_diff", "day_pct", "week_diff", "week_pct", "min_price", "max_price", "last_date")
    return item_rows.withColumnRenamed("latest_price", "active_price").join(stats, ["entity_key", "best_shop_id"])


def narrow(index: DataFrame, movement: str = "all", series: str = "all", details: lf.DetailFilter | None = None,
           holdings: DataFrame | None = None, favorites: DataFrame | None = None, high_price: int = 100_000) -> DataFrame:
    """Rows passing every predicate but the text search; 'owned' and 'favorites' are movement names too."""
    rows = index.filter(F.col("active_price") > 0)
    if movement == "owned":
        rows = owned_only(rows, holdings)
    elif movement == "favorites":
        rows = favorites_only(rows, favorites)
    else:
        rows = rows.filter(movement_filter(movement, high_price))
    if series != "all":
        number = F.col("details.card_number") if "details" in index.columns else None
        rows = rows.filter(lf.series_filter(lf.series_of(F.col("model_no"), F.col("name"), number), series))
    return rows if details is None else lf.detail_filter(rows, details)


def query_listing(index: DataFrame, docs: DataFrame | None = None, tokens: DataFrame | None = None, queries: DataFrame | None = None,
                  mode: str = "AND", fuzzy: bool = False, sort: str = "priceDesc", limit: int = 300, **filters) -> DataFrame:
    """One page of the listing. Documents are only searched for items that pass the cheap predicates."""
    rows = narrow(index, **filters)
    if docs is not None:
        searched = docs.join(rows.select("entity_key"), "entity_key", "left_semi")
        hits = match_queries(searched, tokens, queries, mode, fuzzy)
        rows = rows.join(hits.select("entity_key"), "entity_key", "left_semi")
    return lf.page(rows, sort, limit)
