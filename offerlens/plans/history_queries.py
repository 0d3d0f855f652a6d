"""Queries for the history, offer and health operators, on the event-stream bindings."""

from pyspark.sql import functions as F

from offerlens.operators import health, history, offers, views
from offerlens.plans.registry import query

DISABLED = "('error')"


def _exclude(i):
    return offers.unavailable_shops(i.shops)


@query("h1_change_log", """
WITH days AS (SELECT entity_key, shop_id, date, lag(date) OVER (PARTITION BY entity_key, shop_id ORDER BY date) AS before FROM daily)
SELECT d.entity_key, d.shop_id, d.date, n.price
FROM days d JOIN daily n ON n.entity_key = d.entity_key AND n.shop_id = d.shop_id AND n.date = d.date
LEFT JOIN daily p ON p.entity_key = d.entity_key AND p.shop_id = d.shop_id AND p.date = d.before
WHERE d.before IS NULL OR EXISTS (SELECT 1 FROM obs o WHERE o.entity_key = d.entity_key AND o.shop_id = d.shop_id
                                  AND o.obs_date = d.date AND o.price <> p.price)""")
def change_log(i):
    return history.to_change_log(i.obs)


def _state(i):
    """State before the last day and the last day's listings as a batch."""
    earlier, names = i.earlier, i.items
    stored_offers = earlier.groupBy("entity_key", "shop_id").agg(
        F.max_by("price", "obs_seq").alias("latest_price"),
        F.concat(F.lit("old/"), F.col("entity_key").cast("string")).alias("image_url"))
    stored_items = names.join(earlier.select("entity_key").distinct(), "entity_key", "left_semi")
    batch = i.batch.select(
        "*", F.concat_ws(" ", F.lit("Seen"), F.col("entity_key").cast("string"), F.col("obs_seq").cast("string")).alias("name"),
        F.lit("").alias("model_no"),
        F.when(F.col("obs_seq") % 2 == 0, F.concat(F.lit("new/"), F.col("obs_seq").cast("string"))).otherwise("").alias("image_url"))
    return stored_items, stored_offers, history.to_change_log(earlier), batch


@query("h2_upsert_observations", """
WITH logged AS (SELECT entity_key, shop_id, count(*) AS entries, max(date) AS last_date FROM hist GROUP BY ALL),
seen AS (SELECT entity_key, shop_id, max_by(obs_seq, obs_seq) FILTER (obs_seq % 2 = 0) AS img FROM batch GROUP BY ALL),
first_seen AS (SELECT entity_key, min(obs_seq) AS s FROM batch GROUP BY ALL),
known AS (SELECT DISTINCT entity_key FROM earlier)
SELECT o.entity_key, o.shop_id, o.latest_price,
       CASE WHEN seen.img IS NOT NULL THEN 'new/' || seen.img WHEN st.entity_key IS NOT NULL THEN 'old/' || o.entity_key ELSE '' END AS image_url,
       CASE WHEN k.entity_key IS NOT NULL THEN i.name ELSE 'Seen ' || o.entity_key || ' ' || f.s END AS name,
       l.entries, l.last_date
FROM offers o JOIN items i USING (entity_key) JOIN logged l USING (entity_key, shop_id)
LEFT JOIN seen USING (entity_key, shop_id) LEFT JOIN first_seen f USING (entity_key)
LEFT JOIN stored st ON st.entity_key = o.entity_key AND st.shop_id = o.shop_id LEFT JOIN known k ON k.entity_key = o.entity_key""")
def upsert_observations(i):
    from offerlens.operators.merge import upsert_observations as upsert

    items, current, log, _ = upsert(*_state(i))
    logged = log.groupBy("entity_key", "shop_id").agg(F.count(F.lit(1)).alias("entries"), F.max("date").alias("last_date"))
    return current.join(items.select("entity_key", "name"), "entity_key").join(logged, ["entity_key", "shop_id"]).select(
        "entity_key", "shop_id", "latest_price", "image_url", "name", "entries", "last_date")


@query("h2_late_observations", """
SELECT h.entity_key, h.shop_id, h.date, h.price, o.latest_price FROM hist h JOIN offers o USING (entity_key, shop_id)""")
def late_observations(i):
    """State built in three batches whose days overlap: log and offers equal those of all observations together."""
    from offerlens.functions.durable import checkpointed
    from offerlens.operators.merge import upsert_observations_of_any_age as upsert

    part = F.pmod(F.xxhash64("obs_seq"), F.lit(3))
    listed = i.obs.select("*", F.lit("").alias("name"), F.lit("").alias("model_no"), F.lit("").alias("image_url"), part.alias("part"))
    first = listed.filter("part = 0")
    items = first.select("entity_key", "name", "model_no", "image_url").distinct()
    current = first.groupBy("entity_key", "shop_id").agg(F.max_by("price", "obs_seq").alias("latest_price"), F.lit("").alias("image_url"))
    log, days = history.to_change_log(first), history.day_rows(first)
    for number in (1, 2):
        items, current, log, days = upsert(items, current, log, days, listed.filter(F.col("part") == number).drop("part"))
        log, days = checkpointed(log), checkpointed(days)
    # The last listing of all: the one of the newest day, and of that day the last.
    newest = days.groupBy("entity_key", "shop_id").agg(F.max_by("price", "date").alias("latest_price"))
    return log.join(newest, ["entity_key", "shop_id"])


@query("h3_override_history", """
SELECT coalesce(d.entity_key, h.entity_key) AS entity_key, coalesce(d.shop_id, h.shop_id) AS shop_id,
       coalesce(d.date, h.date) AS date, coalesce(d.high, h.price) AS price
FROM hist h FULL JOIN (SELECT * FROM daily WHERE high > 200) d
  ON h.entity_key = d.entity_key AND h.shop_id = d.shop_id AND h.date = d.date""")
def override_history(i):
    """Incoming: each day's highest price, where above 200."""
    incoming = i.daily.filter("high > 200").select("entity_key", "shop_id", "date", F.col("high").alias("price"))
    return history.override_history(history.to_change_log(i.obs), incoming)


@query("h4_latest_date", f"SELECT max(date) AS latest_date FROM hist WHERE shop_id NOT IN {DISABLED}")
def latest_date(i):
    return history.latest_date(history.to_change_log(i.obs), _exclude(i))


TREND_CTES = f"""
WITH latest AS (SELECT max(date) AS d FROM hist WHERE shop_id NOT IN {DISABLED}),
numbered AS (SELECT h.*, row_number() OVER (PARTITION BY entity_key, shop_id ORDER BY date DESC) AS back,
                    count(*) OVER (PARTITION BY entity_key, shop_id) AS n FROM hist h WHERE shop_id NOT IN {DISABLED}),
day AS (SELECT a.entity_key, a.shop_id,
          CASE WHEN a.date = (SELECT d FROM latest) AND a.n >= 2 THEN a.price - b.price ELSE 0 END AS day_diff,
          CASE WHEN a.date = (SELECT d FROM latest) AND a.n >= 2 AND b.price > 0 THEN (a.price - b.price) / b.price * 100 ELSE 0.0 END AS day_pct
        FROM numbered a LEFT JOIN numbered b ON a.entity_key = b.entity_key AND a.shop_id = b.shop_id AND b.back = 2 WHERE a.back = 1),
edge AS (SELECT CAST(d - INTERVAL 7 DAY AS DATE) AS e FROM latest),
old AS (SELECT s.entity_key, s.shop_id, h.price FROM (SELECT DISTINCT entity_key, shop_id, (SELECT e FROM edge) AS e FROM numbered) s
        ASOF JOIN hist h ON s.entity_key = h.entity_key AND s.shop_id = h.shop_id AND s.e >= h.date),
ranges AS (SELECT entity_key, shop_id, min(price) AS min_price, max(price) AS max_price, max(date) AS last_date FROM hist GROUP BY ALL),
week AS (SELECT s.entity_key, s.shop_id, o.latest_price,
           CASE WHEN s.n >= 2 AND s.date > (SELECT e FROM edge) THEN o.latest_price - coalesce(old.price, f.price) END AS wd, coalesce(old.price, f.price) AS base
         FROM numbered s JOIN offers o USING (entity_key, shop_id) LEFT JOIN old USING (entity_key, shop_id)
         JOIN numbered f ON f.entity_key = s.entity_key AND f.shop_id = s.shop_id AND f.back = f.n WHERE s.back = 1)
"""


@query("h5_day_trend", TREND_CTES + "SELECT entity_key, shop_id, day_diff, round(day_pct, 6) AS day_pct FROM day")
def day_trend(i):
    log = history.without_shops(history.to_change_log(i.obs), _exclude(i))
    return history.day_trend(log, history.latest_date(log).scalar()).withColumn("day_pct", F.round("day_pct", 6))


@query("h6_week_trend", TREND_CTES + """SELECT entity_key, shop_id, coalesce(wd, 0) AS week_diff,
  round(coalesce(CASE WHEN base > 0 THEN wd / base * 100 END, 0.0), 6) AS week_pct FROM week""")
def week_trend(i):
    log = history.without_shops(history.to_change_log(i.obs), _exclude(i))
    return history.week_trend(log, i.offers, history.latest_date(log).scalar()).withColumn("week_pct", F.round("week_pct", 6))


@query("h7_price_range", "SELECT entity_key, shop_id, min(price) AS min_price, max(price) AS max_price, max(date) AS last_date FROM hist GROUP BY ALL")
def price_range(i):
    return history.price_range(history.to_change_log(i.obs))


SUMMARY = """SELECT d.entity_key, d.shop_id, w.latest_price, d.day_diff, round(d.day_pct, 6) AS day_pct, coalesce(w.wd, 0) AS week_diff,
  round(coalesce(CASE WHEN w.base > 0 THEN w.wd / w.base * 100 END, 0.0), 6) AS week_pct, r.min_price, r.max_price, r.last_date
FROM day d JOIN week w USING (entity_key, shop_id) JOIN ranges r USING (entity_key, shop_id)"""


def rounded(df):
    return df.withColumns({"day_pct": F.round("day_pct", 6), "week_pct": F.round("week_pct", 6)})


@query("h8_summarize_offers", TREND_CTES + SUMMARY)
def summarize_offers(i):
    return rounded(history.summarize_offers(history.to_change_log(i.obs), i.offers, _exclude(i)))


BEST_CTES = f"""
WITH ranked AS (SELECT o.*, row_number() OVER (PARTITION BY entity_key ORDER BY latest_price DESC, ordinal) AS rn
                FROM offers o JOIN shops s USING (shop_id) WHERE s.enabled AND latest_price > 0),
best AS (SELECT entity_key, shop_id AS best_shop_id, latest_price AS best_price, image_url AS best_image_url FROM ranked WHERE rn = 1)
"""


@query("h9_view_trend", """
WITH vh AS (SELECT h.* FROM hist h WHERE shop_id = 'signup'),
latest AS (SELECT max(date) AS d FROM vh),
numbered AS (SELECT h.*, row_number() OVER (PARTITION BY entity_key ORDER BY date DESC) AS back, count(*) OVER (PARTITION BY entity_key) AS n FROM vh h),
x AS (SELECT a.entity_key, a.shop_id, o.latest_price AS active_price,
        CASE WHEN a.date = (SELECT d FROM latest) AND a.n >= 2 THEN a.price - b.price ELSE 0 END AS day_diff, b.price AS bp,
        CASE WHEN a.n >= 2 AND a.date > (SELECT d - INTERVAL 7 DAY FROM latest) THEN o.latest_price - coalesce(
           (SELECT max_by(h.price, h.date) FROM vh h WHERE h.entity_key = a.entity_key AND h.date <= (SELECT d - INTERVAL 7 DAY FROM latest)),
           (SELECT min_by(h.price, h.date) FROM vh h WHERE h.entity_key = a.entity_key)) ELSE 0 END AS week_diff, a.date AS last_date
      FROM numbered a LEFT JOIN numbered b ON a.entity_key = b.entity_key AND b.back = 2
      JOIN offers o ON o.entity_key = a.entity_key AND o.shop_id = a.shop_id WHERE a.back = 1),
r AS (SELECT entity_key, min(price) AS min_price, max(price) AS max_price FROM vh GROUP BY ALL)
SELECT x.entity_key, x.shop_id, active_price, day_diff, round(CASE WHEN day_diff <> 0 AND bp > 0 THEN day_diff / bp * 100 ELSE 0.0 END, 6) AS day_pct,
       week_diff, min_price, max_price, last_date FROM x JOIN r USING (entity_key)""")
def view_trend(i):
    rows = views.shop_view(i.offers, i.shops, "signup", _exclude(i))
    return rounded(views.view_trend(history.to_change_log(i.obs), rows)).drop("week_pct")


@query("h10_history_series", BEST_CTES + """
SELECT h.entity_key, h.date, h.price FROM hist h JOIN best b ON h.entity_key = b.entity_key AND h.shop_id = b.best_shop_id""")
def history_series(i):
    rows = views.shop_view(i.offers, i.shops, "best", _exclude(i))
    return history.history_series(views.view_history(history.to_change_log(i.obs), rows))


@query("off1_best_offer", BEST_CTES + "SELECT * FROM best")
def best_offer(i):
    return offers.best_offer(i.offers, i.shops, _exclude(i))


@query("off2_refresh_best_merge", BEST_CTES + """
SELECT i.entity_key, i.date, coalesce(h.price, i.price) AS price, coalesce(b.best_price, 0) AS best_price
FROM item_hist i LEFT JOIN best b USING (entity_key) LEFT JOIN hist h ON h.entity_key = b.entity_key AND h.shop_id = b.best_shop_id AND h.date = i.date
UNION ALL
SELECT h.entity_key, h.date, h.price, b.best_price FROM best b JOIN hist h ON h.entity_key = b.entity_key AND h.shop_id = b.best_shop_id
WHERE NOT EXISTS (SELECT 1 FROM item_hist i WHERE i.entity_key = h.entity_key AND i.date = h.date)""")
def refresh_best_merge(i):
    items, log = offers.refresh_best(i.items, i.offers, history.to_change_log(i.obs), i.item_hist, i.shops, _exclude(i), "merge")
    return log.join(items.select("entity_key", "best_price"), "entity_key")


@query("off2_refresh_best_append", BEST_CTES + """,
tail AS (SELECT entity_key, max(date) AS date, max_by(price, date) AS price FROM item_hist GROUP BY ALL),
today AS (SELECT b.entity_key, b.best_price, b.best_shop_id, t.date AS tail_date, t.price AS tail_price FROM best b JOIN tail t USING (entity_key))
SELECT i.entity_key, i.date, CASE WHEN i.date = d.last_day AND t.tail_date = i.date THEN t.best_price ELSE i.price END AS price, t.best_shop_id
FROM item_hist i JOIN today t USING (entity_key) CROSS JOIN last_day d
UNION ALL
SELECT t.entity_key, d.last_day, t.best_price, t.best_shop_id FROM today t CROSS JOIN last_day d
WHERE t.tail_date < d.last_day AND t.tail_price <> t.best_price""")
def refresh_best_append(i):
    items, log = offers.refresh_best(i.items, i.offers, history.to_change_log(i.obs), i.item_hist, i.shops, _exclude(i),
                                     "append", i.last_day.scalar())
    return log.join(items.select("entity_key", "best_shop_id"), "entity_key")


REPORT = """
report AS (SELECT s.shop_id, s.shop_name, coalesce(f.n, 0) AS fetched, coalesce(p.n, 0) AS previous,
             CASE WHEN s.shop_id = 'signup' THEN 'paused' WHEN s.shop_id = 'view' THEN 'error' ELSE 'active' END AS status
           FROM shops s LEFT JOIN (SELECT shop_id, count(*) AS n FROM batch GROUP BY 1) f USING (shop_id)
           LEFT JOIN (SELECT shop_id, count(DISTINCT entity_key) AS n FROM earlier GROUP BY 1) p USING (shop_id) WHERE s.enabled),
health AS (SELECT shop_id, shop_name, CASE WHEN status = 'active' THEN fetched ELSE 0 END AS fetched, previous, status,
             CASE status WHEN 'error' THEN false WHEN 'paused' THEN true ELSE NOT (previous >= 20 AND fetched < previous * 0.5) END AS healthy,
             CASE WHEN status = 'error' THEN 'HTTP 503' END AS error, CASE WHEN status = 'paused' THEN 'buying suspended' ELSE '' END AS message FROM report)
"""


def _report(i):
    """Run report of the last day: one shop paused, one failed, the others fetched."""
    outcomes = i.shops.select(
        "shop_id", F.when(F.col("shop_id") == "view", "HTTP 503").alias("error"), (F.col("shop_id") == "signup").alias("paused"),
        F.when(F.col("shop_id") == "signup", "buying suspended").otherwise("").alias("message"))
    return health.source_health(i.shops, i.batch, i.stored, outcomes)


@query("off3_unavailable_shops", f"""
WITH {REPORT} SELECT shop_id FROM shops WHERE NOT enabled
UNION SELECT shop_id FROM health WHERE status = 'paused' OR (NOT healthy AND fetched = 0)""")
def unavailable_shops(i):
    return offers.unavailable_shops(i.shops, _report(i))


@query("off4_retain_priced", """
SELECT i.* FROM items i WHERE EXISTS (SELECT 1 FROM hist h WHERE h.entity_key = i.entity_key AND h.price > 400
  AND h.date = (SELECT max(date) FROM hist g WHERE g.entity_key = h.entity_key AND g.shop_id = h.shop_id))""")
def retain_priced(i):
    """Offers up to 400 count as having no price here."""
    thin = i.offers.withColumn("latest_price", F.when(F.col("latest_price") > 400, F.col("latest_price")).otherwise(0))
    return offers.retain_priced(i.items, thin)


def listing(i, report=None):
    return offers.build_listing_index(i.items, i.offers, history.to_change_log(i.obs), i.shops, offers.unavailable_shops(i.shops, report))


LISTING_CTES = TREND_CTES + f""",
summary AS ({SUMMARY}),
ranked AS (SELECT o.*, row_number() OVER (PARTITION BY entity_key ORDER BY latest_price DESC, ordinal) AS rn, ordinal
           FROM offers o JOIN shops s USING (shop_id) WHERE s.enabled AND latest_price > 0),
listing AS (SELECT r.entity_key, i.name, i.model_no,
     coalesce(nullif(r.image_url, ''), (SELECT min_by(q.image_url, q.ordinal) FROM ranked q WHERE q.entity_key = r.entity_key AND q.image_url <> ''), '') AS image_url,
     r.shop_id AS best_shop_id, r.latest_price FROM ranked r JOIN items i USING (entity_key) WHERE rn = 1)
"""


@query("off5_build_listing_index", LISTING_CTES + """
SELECT l.entity_key, l.name, l.model_no, l.image_url AS item_image, l.best_shop_id, l.latest_price AS best_price, s.shop_id, s.latest_price,
       s.day_diff, s.day_pct, s.week_diff, s.week_pct, s.min_price, s.max_price, s.last_date
FROM listing l JOIN summary s USING (entity_key)""")
def build_listing_index(i):
    item_rows, offer_rows = listing(i)
    head = item_rows.select("entity_key", "name", "model_no", F.col("image_url").alias("item_image"), "best_shop_id",
                            F.col("latest_price").alias("best_price"))
    return rounded(head.join(offer_rows.drop("image_url", "source_name", "source_url"), "entity_key"))


@query("off6_order_canonical", BEST_CTES + "SELECT entity_key, model_no, best_price FROM best JOIN items USING (entity_key)")
def order_canonical(i):
    best = offers.best_offer(i.offers, i.shops, _exclude(i)).join(i.items, "entity_key")
    return offers.order_canonical(best.select("entity_key", "model_no", "best_price"))


@query("off7_offer_staleness", """
WITH last AS (SELECT entity_key, shop_id, max(date) AS last_date FROM hist GROUP BY ALL),
newest AS (SELECT entity_key, max(date) AS newest FROM hist GROUP BY ALL)
SELECT l.entity_key, l.shop_id, l.last_date, CAST(n.newest - l.last_date AS INTEGER) AS days_behind,
       CASE WHEN n.newest - l.last_date >= 3 THEN l.last_date END AS stale_since FROM last l JOIN newest n USING (entity_key)""")
def offer_staleness(i):
    tails = history.history_tails(history.to_change_log(i.obs))
    return offers.offer_staleness(tails.select("entity_key", "shop_id", F.col("date").alias("last_date")))


@query("hl1_source_health", f"WITH {REPORT} SELECT * FROM health")
def source_health(i):
    return _report(i)


@query("hl2_run_gate", f"""WITH {REPORT} SELECT count(*) FILTER (status <> 'error') AS answered, CAST(sum(fetched) AS BIGINT) AS listings,
  count(*) FILTER (status <> 'error') > 0 AND sum(fetched) > 0 AS may_write FROM health""")
def run_gate(i):
    return health.run_gate(_report(i))


@query("hl3_health_summary", f"""WITH {REPORT} SELECT shop_id, CASE WHEN status = 'paused' THEN 'PAUSED' WHEN healthy THEN 'OK' ELSE 'NG' END AS label, fetched,
  CASE WHEN status = 'paused' THEN message WHEN error IS NOT NULL THEN 'fetch failed: ' || error ELSE 'previously ' || previous END AS note,
  NOT healthy AS needs_attention,
  CASE WHEN status = 'paused' THEN 'PAUSED' WHEN healthy THEN 'OK' ELSE 'NG' END || ' ' || shop_id || ': ' || fetched || ' (' ||
  CASE WHEN status = 'paused' THEN message WHEN error IS NOT NULL THEN 'fetch failed: ' || error ELSE 'previously ' || previous END || ')' AS line FROM health""")
def health_summary(i):
    return health.health_summary(_report(i))


VIEW_BEST = BEST_CTES + ", vr AS (SELECT entity_key, best_shop_id AS shop_id, best_price AS active_price, best_image_url AS image_url FROM best)"


@query("view1_shop_view", VIEW_BEST + """
SELECT 'best' AS view, * FROM vr UNION ALL
SELECT 'view', entity_key, shop_id, latest_price, image_url FROM offers WHERE shop_id = 'view' UNION ALL
SELECT 'error', entity_key, shop_id, latest_price, image_url FROM offers WHERE shop_id = 'error' AND false""")
def shop_view(i):
    parts = [views.shop_view(i.offers, i.shops, v, _exclude(i)).select(F.lit(v).alias("view"), "*") for v in ("best", "view", "error")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("view1_image_fallback", """
WITH shown AS (SELECT o.entity_key, o.shop_id, o.latest_price, s.ordinal, CASE WHEN o.latest_price % 3 = 0 THEN '' ELSE o.image_url END AS image_url FROM offers o JOIN shops s USING (shop_id) WHERE s.enabled),
best AS (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY latest_price DESC, ordinal) AS place FROM shown WHERE latest_price > 0),
pictured AS (SELECT s.entity_key, s.image_url, row_number() OVER (PARTITION BY s.entity_key ORDER BY CASE WHEN b.place = 1 THEN 0 ELSE 1 END, s.ordinal) AS place
  FROM shown s LEFT JOIN best b ON b.entity_key = s.entity_key AND b.shop_id = s.shop_id WHERE s.image_url <> '')
SELECT b.entity_key, b.shop_id, b.latest_price AS active_price, coalesce(nullif(b.image_url, ''), p.image_url, '') AS image_url
FROM best b LEFT JOIN pictured p ON p.entity_key = b.entity_key AND p.place = 1 WHERE b.place = 1""")
def image_fallback(i):
    """Offers whose price is a multiple of three have no image."""
    bare = i.offers.withColumn("image_url", F.when(F.col("latest_price") % 3 == 0, "").otherwise(F.col("image_url")))
    off = i.shops.filter(~F.col("enabled")).select("shop_id")
    return views.with_item_images(views.shop_view(bare, i.shops, "best", off), views.item_images(bare, i.shops, off))


@query("view2_unmerge", """SELECT CAST(o.entity_key AS VARCHAR) || '::' || shop_id AS entity_key, o.entity_key AS merged_key, shop_id, source_name AS name, model_no,
  o.image_url, latest_price FROM offers o JOIN items i USING (entity_key)""")
def unmerge(i):
    return views.unmerge(i.items, i.offers)


@query("view3_attach_history", """SELECT o.entity_key, o.shop_id, o.latest_price, o.source_url, h.date, h.price
FROM offers o JOIN shops s USING (shop_id) LEFT JOIN hist h ON h.entity_key = o.entity_key AND h.shop_id = o.shop_id WHERE s.enabled""")
def attach_history(i):
    _, offer_rows = listing(i)
    rows = offer_rows.select("entity_key", "shop_id", "latest_price")
    return views.attach_history(rows, history.to_change_log(i.obs), i.offers)
