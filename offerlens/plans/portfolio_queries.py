"""Queries for the portfolio operators: order-book holdings valued on event-stream prices."""

from pyspark.sql import functions as F

from offerlens.operators import history, offers, portfolio, views
from offerlens.plans.history_queries import VIEW_BEST
from offerlens.plans.registry import query


def best_view(i):
    rows = views.shop_view(i.offers, i.shops, "best", offers.unavailable_shops(i.shops))
    return rows, views.view_history(history.to_change_log(i.obs), rows)


# Every fourth item is an alias of its neighbour: its key and its legacy name lead there.
KEY_MAP = """
keyed AS (SELECT CAST(entity_key AS VARCHAR) AS entity_key, name, model_no, entity_key AS ordinal, entity_key AS n FROM items),
held AS (SELECT owner_id, CASE WHEN entity_key % 4 = 0 THEN 'old-' || entity_key WHEN entity_key % 4 = 1 THEN 'Item ' || entity_key || '_' ||
           'OP' || lpad(CAST(entity_key % 37 AS VARCHAR), 2, '0') || '-' || lpad(CAST(entity_key % 1000 AS VARCHAR), 3, '0')
           ELSE CAST(entity_key AS VARCHAR) END AS entity_key, qty FROM holdings)
"""


def keyed_items(i):
    """Items under text keys; every fourth carries a canonical id, and each a former key 'old-<n>'."""
    text = F.col("entity_key").cast("string")
    items = i.items.select(
        text.alias("entity_key"), F.when(F.col("entity_key") % 4 == 3, F.concat(F.lit("canon-"), text)).alias("canonical_id"),
        "name", "model_no", F.col("entity_key").alias("ordinal"))
    return items, items.select("entity_key", F.concat(F.lit("old-"), "entity_key").alias("alias_key"))


def stored_key(c):
    """Key under which a holding was stored: a former key, a legacy name or the item's key."""
    text = F.col(c).cast("string")
    model = F.concat(F.lit("OP"), F.lpad((F.col(c) % 37).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col(c) % 1000).cast("string"), 3, "0"))
    return (F.when(F.col(c) % 4 == 0, F.concat(F.lit("old-"), text))
            .when(F.col(c) % 4 == 1, F.concat(F.lit("Item "), text, F.lit("_"), model)).otherwise(text))


@query("pf1_migrate_holdings", """
SELECT 'holding' AS kind, owner_id, CASE WHEN entity_key % 4 = 3 THEN 'canon-' || entity_key ELSE CAST(entity_key AS VARCHAR) END AS entity_key, CAST(sum(qty) AS BIGINT) AS qty
FROM holdings GROUP BY 1, 2, 3 UNION ALL
SELECT 'favorite', owner_id, CASE WHEN entity_key % 4 = 3 THEN 'canon-' || entity_key ELSE CAST(entity_key AS VARCHAR) END, 1 FROM favorites""")
def migrate_holdings(i):
    key_map = portfolio.canonical_keys(*keyed_items(i))
    h, f = portfolio.migrate_holdings(
        i.holdings.select("owner_id", stored_key("entity_key").alias("entity_key"), "qty"),
        i.favorites.select("owner_id", stored_key("entity_key").alias("entity_key")), key_map)
    return h.select(F.lit("holding").alias("kind"), "*").unionByName(f.select(F.lit("favorite").alias("kind"), "*", F.lit(1).cast("long").alias("qty")))


@query("pf2_valuation", VIEW_BEST + """
SELECT owner_id, CAST(sum(qty) AS BIGINT) AS pieces, CAST(sum(qty * coalesce(active_price, 0)) AS BIGINT) AS value
FROM holdings LEFT JOIN vr USING (entity_key) GROUP BY owner_id""")
def valuation(i):
    return portfolio.valuation(i.holdings, best_view(i)[0])


VIEW_HIST = VIEW_BEST + ", vh AS (SELECT h.entity_key, h.date, h.price FROM hist h JOIN vr USING (entity_key, shop_id))"


@query("pf3_valuation_series", VIEW_HIST + """,
grid AS (SELECT h.owner_id, h.entity_key, h.qty, d.date AS day FROM holdings h, (SELECT DISTINCT date FROM vh) d)
SELECT g.owner_id, g.day AS date, CAST(sum(g.qty * coalesce(v.price, 0)) AS BIGINT) AS value
FROM grid g ASOF LEFT JOIN vh v ON g.entity_key = v.entity_key AND g.day >= v.date GROUP BY 1, 2""")
def valuation_series(i):
    return portfolio.valuation_series(i.holdings, best_view(i)[1])


@query("pf3_valuation_intervals", VIEW_HIST + """,
grid AS (SELECT h.owner_id, h.entity_key, h.qty, d.date AS day FROM holdings h, (SELECT DISTINCT date FROM vh) d),
series AS (SELECT g.owner_id, g.day AS date, CAST(sum(g.qty * coalesce(v.price, 0)) AS BIGINT) AS value
  FROM grid g ASOF LEFT JOIN vh v ON g.entity_key = v.entity_key AND g.day >= v.date GROUP BY 1, 2),
changes AS (SELECT *, lag(value, 1, 0) OVER (PARTITION BY owner_id ORDER BY date) AS before FROM series)
SELECT owner_id, date AS from_date, lead(date) OVER (PARTITION BY owner_id ORDER BY date) AS to_date, value FROM changes WHERE value <> before""")
def valuation_intervals(i):
    return portfolio.valuation_intervals(i.holdings, best_view(i)[1])


@query("pf4_valuation_at", VIEW_HIST + """
SELECT h.owner_id, h.entity_key, h.qty, h.qty * v.price AS then_value, h.qty * vr.active_price AS now_value, h.qty * (vr.active_price - v.price) AS diff
FROM (SELECT *, DATE '2024-01-10' AS day FROM holdings) h ASOF JOIN vh v ON h.entity_key = v.entity_key AND h.day >= v.date JOIN vr ON vr.entity_key = h.entity_key""")
def valuation_at(i):
    rows, log = best_view(i)
    return portfolio.valuation_at(i.holdings, log, rows, "2024-01-10")


@query("pf4_valuation_at_totals", VIEW_HIST + """
SELECT h.owner_id, CAST(sum(h.qty * v.price) AS BIGINT) AS then_value, CAST(sum(h.qty * vr.active_price) AS BIGINT) AS now_value,
  CAST(sum(h.qty * (vr.active_price - v.price)) AS BIGINT) AS diff
FROM (SELECT *, DATE '2024-01-10' AS day FROM holdings) h ASOF JOIN vh v ON h.entity_key = v.entity_key AND h.day >= v.date JOIN vr ON vr.entity_key = h.entity_key
GROUP BY h.owner_id""")
def valuation_at_totals(i):
    rows, log = best_view(i)
    return portfolio.valuation_at_totals(portfolio.valuation_at(i.holdings, log, rows, "2024-01-10"))


@query("pf5_export_holdings", VIEW_BEST + """
SELECT h.owner_id, i.name, i.model_no, vr.active_price AS price, h.qty, vr.active_price * h.qty AS subtotal, vr.image_url
FROM holdings h JOIN items i USING (entity_key) JOIN vr USING (entity_key)""")
def export_holdings(i):
    return portfolio.export_holdings(i.holdings, i.items, best_view(i)[0])


@query("pf6_import_holdings", """
SELECT owner_id, CASE WHEN entity_key % 4 = 3 THEN 'canon-' || entity_key ELSE CAST(entity_key AS VARCHAR) END AS entity_key, qty
FROM (SELECT CAST(owner_id AS VARCHAR) AS owner_id, entity_key, CASE WHEN qty = 1 THEN 0 ELSE qty + 1 END AS qty FROM holdings)""")
def import_holdings(i):
    """File rows with legacy names; each key comes twice (the later row wins), some quantities are no numbers."""
    text = F.col("entity_key").cast("string")
    base = i.holdings.select(
        F.col("owner_id").cast("string").alias("owner_id"), F.concat(F.lit("Item "), text).alias("name"),
        F.concat(F.lit("OP"), F.lpad((F.col("entity_key") % 37).cast("string"), 2, "0"), F.lit("-"),
                 F.lpad((F.col("entity_key") % 1000).cast("string"), 3, "0")).alias("model_no"), "qty")
    first = base.withColumns({"qty": F.col("qty").cast("string"), "seq": F.lit(1)})
    second = base.withColumns({"qty": F.when(F.col("qty") == 1, "some").otherwise((F.col("qty") + 1).cast("string")), "seq": F.lit(2)})
    return portfolio.import_holdings(first.unionByName(second), portfolio.canonical_keys(*keyed_items(i)))


@query("pf7_set_quantities", """
WITH edits AS (SELECT o_custkey AS owner_id, o_orderkey % (SELECT max(user_id) + 1 FROM events) AS entity_key,
    max_by(CAST(floor(o_totalprice / 1000) AS BIGINT) % 9 - 2, o_orderkey) AS q FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
SELECT h.owner_id, h.entity_key, CASE WHEN e.q IS NULL THEN h.qty WHEN e.q < 0 THEN 0 ELSE e.q END AS qty
FROM holdings h LEFT JOIN edits e USING (owner_id, entity_key)""")
def set_quantities(i):
    users = i.events.agg((F.max("user_id") + 1).alias("n")).scalar()
    edits = i.orders.filter("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("owner_id"), (F.col("o_orderkey") % users).alias("entity_key"),
        (F.floor(F.col("o_totalprice") / 1000) % 9 - 2).alias("qty"), F.col("o_orderkey").alias("seq"))
    return portfolio.set_quantities(i.holdings, edits)


@query("pf7_toggle_favorites", """
WITH t AS (SELECT o_custkey AS owner_id, o_orderkey % (SELECT max(user_id) + 1 FROM events) AS entity_key, count(*) AS n
           FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2)
SELECT owner_id, entity_key FROM favorites f LEFT JOIN t USING (owner_id, entity_key) WHERE coalesce(n, 0) % 2 = 0
UNION ALL SELECT t.owner_id, t.entity_key FROM t WHERE n % 2 = 1 AND NOT EXISTS (
  SELECT 1 FROM favorites f WHERE f.owner_id = t.owner_id AND f.entity_key = t.entity_key)""")
def toggle_favorites(i):
    users = i.events.agg((F.max("user_id") + 1).alias("n")).scalar()
    toggles = i.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(
        F.col("o_custkey").alias("owner_id"), (F.col("o_orderkey") % users).alias("entity_key"))
    return portfolio.toggle_favorites(i.favorites, toggles)
