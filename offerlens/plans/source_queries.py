"""Queries for the sources and sinks: the stored pages, and price lists rendered from the part table."""

import uuid

from pyspark.sql import functions as F

from offerlens.functions.durable import shared_folder
from offerlens.plans.history_queries import LISTING_CTES, listing
from offerlens.plans.registry import query
from offerlens.sources import backfill, details, json_maps, pages, payloads, snapshots

LINKS = pages.PageGrammar(
    block=r'<li><a href="[^"]*">.*?</a></li>', name=(r"<a [^>]*>(.*?)</a>",), image=(r'href="([^"]*)"',), required=("name",))


def raw_pages(i):
    return i.pages.select(F.col("page_id").alias("source_id"), "url", F.col("html").alias("body"))


@query("src1_extract_links", """
WITH b AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<li><a href="[^"]*">.*?</a></li>')) AS block,
             generate_subscripts(regexp_extract_all(html, '<li><a href="[^"]*">.*?</a></li>'), 1) - 1 AS position FROM pages),
c AS (SELECT *, trim(replace(regexp_replace(regexp_extract(block, '<a [^>]*>(.*?)</a>', 1), '<[^>]*>', '', 'g'), '&amp;', '&')) AS name,
        regexp_extract(block, 'href="([^"]*)"', 1) AS href FROM b)
SELECT page_id AS source_id, position, name, CASE WHEN href = '' THEN '' WHEN starts_with(href, '/') THEN regexp_extract(url, '^https?://[^/?#]+') || href
  WHEN regexp_matches(href, '^https?:') THEN href ELSE 'relative' END AS link FROM c WHERE name <> ''""")
def extract_links(i):
    return pages.extract_listings(raw_pages(i), LINKS).select(
        "source_id", F.col("position").cast("long").alias("position"), "name", F.col("image_url").alias("link"))


TABLE_GRAMMAR = pages.PageGrammar(
    block=r'<div class="row">[\s\S]*?</span></div>', name=(r'<div class="n">([\s\S]*?)</div>',), model=(r'<div class="m">([\s\S]*?)</div>',),
    price=(r'<span class="price">([\d,]+)</span>',), image=(r'<img[^>]+src="([^"]+)"',))
ITEM_GRAMMAR = pages.PageGrammar(
    block=r'(?i)<li\b[^>]*class="[^"]*\boffer\b[^"]*"[^>]*>[\s\S]*?</li>', name=(r'<b>([\s\S]*?)</b>', r'alt="([^"]*)"'),
    price=(r'<i>([\s\S]*?)</i>',), image=(r'src="([^"]*)"',))


def _code(c):
    return F.concat(F.lit("OP"), F.lpad((F.floor(F.col(c) / 1000) % 100).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col(c) % 1000).cast("string"), 3, "0"))


def price_pages(i):
    """Rendered price lists of 20 parts a page; even pages use the table layout, odd ones list items."""
    price = F.round("p_retailprice").cast("long")
    number = F.format_string("%,d", price)
    key = F.col("p_partkey").cast("string")
    row = F.concat(F.lit('<div class="row"><img src="/img/'), key, F.lit('.png"><div class="n"> <b>'), F.col("p_name"), F.lit(" &amp;\n co</b></div>"),
                   F.lit('<div class="m">型番：'), F.regexp_replace(_code("p_partkey"), "-", "–"), F.lit('</div><span class="price">'),
                   F.when(F.col("p_size") == 7, "0").otherwise(number), F.lit("</span></div>\n"))
    li = F.concat(F.lit('<LI class="x offer y"><img src="img/'), key, F.lit('.png" alt="'), F.col("p_name"), F.lit(" "), _code("p_partkey"), F.lit('">'),
                  F.when(F.col("p_size") > 25, F.concat(F.lit("<b>"), F.col("p_name"), F.lit("&nbsp;"), _code("p_partkey"), F.lit("</b>"))).otherwise(""),
                  F.lit("<i>"), F.when(F.col("p_size") == 7, "ask").otherwise(number), F.lit(" 円</i></li>"))
    page = F.floor(F.col("p_partkey") / 20)
    return (
        i.part.groupBy(page.alias("source_id"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.when(page % 2 == 0, row).otherwise(li).alias("h")))),
                                      lambda x: x["h"]), "").alias("body"))
        .withColumn("url", F.concat(F.lit("https://shop.example/lists/"), F.col("source_id").cast("string"))))


@query("src1_extract_listings", """
SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS source_id, CASE WHEN floor(p_partkey / 20) % 2 = 0 THEN p_name || ' & co'
    ELSE p_name || ' ' || code END AS name, code AS model_no, CAST(round(p_retailprice) AS BIGINT) AS price,
  CASE WHEN floor(p_partkey / 20) % 2 = 0 THEN 'https://shop.example/img/' ELSE 'https://shop.example/lists/img/' END || p_partkey || '.png' AS image_url
FROM (SELECT *, 'OP' || lpad(CAST(CAST(floor(p_partkey / 1000) AS BIGINT) % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') AS code FROM part)
WHERE p_size <> 7""")
def extract_listings(i):
    made = price_pages(i)
    both = pages.extract_listings(made, TABLE_GRAMMAR).unionByName(pages.extract_listings(made, ITEM_GRAMMAR))
    return both.select("source_id", "name", "model_no", "price", "image_url")


PAUSE = "(?:ist|the|les) [a-z]*th[a-z]*"


@query("src2_source_status", f"""
SELECT page_id AS source_id, url, CASE WHEN p THEN 'paused' ELSE 'active' END AS status, CASE WHEN p THEN 'source reports a pause' ELSE '' END AS message
FROM (SELECT *, regexp_matches(regexp_replace(replace(replace(regexp_replace(regexp_replace(html, '[\\x00-\\x1f\\x7f]', ' ', 'g'), '<[^>]*>', '', 'g'),
  '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'), '{PAUSE}') AS p FROM pages)""")
def source_status(i):
    return pages.source_status(raw_pages(i), PAUSE)


def paged_payloads(i):
    """API pages of 20 parts, 50 pages a source; every part is repeated two pages on with a new price."""
    page_no = F.floor(F.col("p_partkey") / 20)
    twice = i.part.select("*", page_no.alias("n"), F.lit(0).alias("again")).unionByName(i.part.select("*", (page_no + 2).alias("n"), F.lit(1).alias("again")))
    source, page = F.floor(F.col("n") / 50), (F.col("n") % 50 + 1).cast("int")
    record = F.struct(
        F.when(F.col("p_size") != 13, F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("<b>"), "p_name", F.lit("</b>")).alias("name"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("extra_difference"), F.col("p_brand").alias("model_number"),
        F.when(F.col("p_size") == 7, 0).otherwise(F.round("p_retailprice") + F.col("again")).alias("amount"), F.lit("R").alias("rarity"),
        F.concat(F.lit("o/"), F.col("p_partkey").cast("string")).alias("original_image_source"),
        F.struct(F.when(F.col("p_size") > 25, F.concat(F.lit("c/"), F.col("p_partkey").cast("string"))).alias("image_source")).alias("ocha_product"))
    grouped = twice.groupBy(source.alias("source_id"), page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("again", "p_partkey", record.alias("r")))).alias("rs"))
    body = F.to_json(F.struct((F.col("source_id") * 50 + F.col("page") != 33).alias("result"), F.lit(50).alias("last_page"), F.transform("rs", lambda x: x["r"]).alias("records")))
    broken = F.when(F.col("source_id") * 50 + F.col("page") == 44, F.concat(body, F.lit("}"))).otherwise(body)
    return grouped.select("source_id", "page", F.when(F.col("page") == 22, F.regexp_replace(body, '"last_page":50', '"last_page":"x9"')).otherwise(broken).alias("body"))


PAGED = """
twice AS (SELECT *, CAST(floor(p_partkey / 20) AS BIGINT) AS n, 0 AS again FROM part UNION ALL SELECT *, CAST(floor(p_partkey / 20) AS BIGINT) + 2, 1 FROM part),
paged AS (SELECT *, CAST(floor(n / 50) AS BIGINT) AS source_id, CAST(n % 50 + 1 AS INTEGER) AS page, n + 1 AS page_all FROM twice),
valid AS (SELECT * FROM paged WHERE page_all NOT IN (33, 44) AND page <> 22)
"""


@query("src3_ingest_paged_json", f"""WITH {PAGED},
ids AS (SELECT *, CASE WHEN p_size = 13 THEN 'null' || n || '/' || again || '/' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS rid FROM valid),
lasts AS (SELECT *, row_number() OVER (PARTITION BY source_id, rid ORDER BY page DESC, again DESC) AS rn FROM ids)
SELECT source_id, p_name || CASE WHEN p_size % 2 = 0 THEN '(' || p_type || ')' ELSE '' END AS name, p_brand AS model_no,
  CASE WHEN p_size > 25 THEN 'c/' ELSE 'o/' END || p_partkey AS image_url, round(p_retailprice) + again AS price, 'R' AS rarity
FROM lasts WHERE rn = 1 AND p_size <> 7""")
def ingest_paged_json(i):
    """Some pages of the fixture are broken on purpose; src3_payload_violations reports them."""
    return payloads.ingest_paged_json(paged_payloads(i), on_violation="skip").drop("record_id")


@query("src3_payload_violations", f"""WITH {PAGED}
SELECT DISTINCT source_id, page, CASE page_all WHEN 44 THEN 'invalid JSON' WHEN 33 THEN 'invalid response' ELSE 'invalid last_page: x9' END AS violation
FROM paged WHERE page_all IN (33, 44) OR page = 22""")
def payload_violations(i):
    return payloads.payload_violations(paged_payloads(i))


def _backfill(i):
    """Old price rows per part, up to three a day; flag R rows of quantity-poor days carry unreadable dates."""
    lots = i.lots.join(i.part.select(F.col("p_partkey").alias("entity_key"), "p_name"), "entity_key")
    rows = lots.select(
        F.when((F.col("shop_id") == "R") & (F.col("price") % 10 == 0), "soon").otherwise(F.date_format("date", "yyyy/MM/dd")).alias("date"),
        F.concat(F.col("p_name"), F.lit("  ")).alias("name"), F.concat(F.lit("型番：M-"), F.col("entity_key").cast("string")).alias("model"),
        F.when(F.col("price") % 7 == 0, "-1").otherwise(F.col("price").cast("string")).alias("price"), F.ascii("shop_id").alias("seq"))
    meta = i.part.filter("p_size > 40").select(F.col("p_name").alias("name"), F.concat(F.lit("M-"), F.col("p_partkey").cast("string")).alias("model"),
                                               F.concat(F.lit("img/"), F.col("p_partkey").cast("string")).alias("image_url"))
    key = F.concat(F.lit("m-"), F.col("p_partkey").cast("string"), F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("")))
    items = i.part.filter("p_size <= 10").select(key.alias("entity_key"), F.lit("Known").alias("name"), F.lit("K").alias("model_no"), F.lit("k").alias("image_url"))
    stored = items.select("entity_key", F.lit("old").alias("shop_id"), F.lit("1999-01-01").cast("date").alias("date"), F.lit(5).cast("long").alias("price"))
    return backfill.backfill_history(rows, meta, items, stored, "old")


BACKFILL = """
used AS (SELECT l.entity_key AS pk, date, max_by(price, ascii(shop_id)) AS price FROM lots l WHERE price % 7 <> 0 AND NOT (shop_id = 'R' AND price % 10 = 0) GROUP BY ALL),
named AS (SELECT p_partkey AS pk, 'm-' || p_partkey || '_' || replace(p_name, ' ', '') AS k, p_name, p_size FROM part),
merged AS (SELECT k AS entity_key, date, price FROM used JOIN named USING (pk) UNION ALL SELECT k, DATE '1999-01-01', 5 FROM named WHERE p_size <= 10
  AND NOT EXISTS (SELECT 1 FROM used u WHERE u.pk = named.pk AND u.date = DATE '1999-01-01')),
made AS (SELECT k AS entity_key, CASE WHEN p_size <= 10 THEN 'Known' ELSE p_name END AS name, CASE WHEN p_size <= 10 THEN 'k' WHEN p_size > 40 THEN 'img/' || pk ELSE '' END AS image_url
  FROM named WHERE p_size <= 10 OR pk IN (SELECT pk FROM used))
"""


@query("src4_backfill_history", f"WITH {BACKFILL} SELECT m.entity_key, date, price, name, image_url FROM merged m JOIN made USING (entity_key)")
def backfill_history(i):
    items, log, _ = _backfill(i)
    return log.join(items.select("entity_key", "name", "image_url"), "entity_key").drop("shop_id")


@query("src4_finish_backfill", f"""WITH {BACKFILL},
newest AS (SELECT entity_key, max_by(price, date) AS price FROM merged GROUP BY 1),
other AS (SELECT k AS entity_key, p_size * 100 AS price FROM named WHERE p_size <= 10)
SELECT m.entity_key, CASE WHEN o.price > n.price THEN 'else' ELSE 'old' END AS best_shop_id, CAST(greatest(coalesce(o.price, 0), n.price) AS BIGINT) AS best_price,
  CASE WHEN o.price > n.price THEN 'else/img' WHEN m.name = 'Known' THEN 'own/img' ELSE m.image_url END AS best_image_url
FROM made m JOIN newest n USING (entity_key) LEFT JOIN other o USING (entity_key)""")
def finish_backfill(i):
    """The small parts had an offer of the loaded shop with an image, and one of another shop."""
    items, log, _ = _backfill(i)
    small = i.part.filter("p_size <= 10").select(F.concat(F.lit("m-"), F.col("p_partkey").cast("string"), F.lit("_"), F.replace("p_name", F.lit(" "), F.lit(""))).alias("entity_key"), "p_size")
    row = lambda shop, price, image: small.select("entity_key", F.lit(shop).alias("shop_id"), price.cast("long").alias("latest_price"), F.lit(image).alias("image_url"))
    stored = row("old", F.lit(1), "own/img").unionByName(row("else", F.col("p_size") * 100, "else/img"))
    shops = i.spark.sql("SELECT * FROM VALUES ('old', 0, true), ('else', 1, true) AS t(shop_id, ordinal, enabled)")
    return backfill.finish_backfill(items, stored, log, "old", shops)[0].select("entity_key", "best_shop_id", "best_price", "best_image_url")


@query("src4_backfill_counters", f"WITH {BACKFILL} SELECT (SELECT count(*) FROM used) AS rows_imported, (SELECT count(*) FROM made WHERE name <> 'Known') AS items_created")
def backfill_counters(i):
    return _backfill(i)[2]


@query("src5_load_details", "SELECT p_partkey, p_name FROM part WHERE p_size % 5 <> 0")
def load_details(i):
    rows = i.part.withColumn("card_number", F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.col("p_partkey").cast("string")))
    return details.load_details(rows).select("p_partkey", "p_name")


@query("src6_write_snapshot", LISTING_CTES + "SELECT entity_key, name, image_url, best_shop_id, latest_price, DATE '2024-01-30' AS run_date FROM listing")
def write_snapshot(i):
    path = f"{shared_folder(i.spark)}/snapshot-{uuid.uuid4().hex}"
    snapshots.write_snapshot(listing(i)[0].drop("model_no"), path, "2024-01-30", cluster_by=["entity_key"])
    return i.spark.read.parquet(path)


@query("src7_read_json_map", """SELECT event_id, 'u' || user_id AS variant_key, 'p' || regexp_extract(props, '(\\d+)', 1) AS price_key,
  CASE WHEN event_id % 3 = 1 THEN 'manual' END AS confirmed_by FROM events""")
def read_json_map(i):
    """The props documents in three shapes: bare map of texts, map of objects, and wrapped in mappings."""
    number, user = F.get_json_object("props", "$.k"), F.col("user_id").cast("string")
    text = F.format_string('{"u%s": "p%s"}', user, number)
    bodies = i.events.select("event_id", F.when(F.col("event_id") % 3 == 0, text)
                             .when(F.col("event_id") % 3 == 1, F.format_string('{"u%s": {"priceKey": "p%s", "confirmedBy": "manual"}}', user, number))
                             .otherwise(F.format_string('{"format": "map", "version": 1, "mappings": %s}', text)).alias("body"))
    entries = json_maps.explode_json_map(bodies)
    value = F.col("map_value")
    return entries.select("event_id", F.col("map_key").alias("variant_key"), json_maps.value_field(value, "priceKey").alias("price_key"),
                          F.when(value.startswith("{"), F.get_json_object(value, "$.confirmedBy")).alias("confirmed_by"))
