"""Queries for identity and record merging, on part listings as three shops spell them.

The oracles know each part's code and tags from the columns the names were made of, so they do
not parse any name.
"""

from pyspark.sql import functions as F

from offerlens.functions.durable import written
from offerlens.operators import identity, merge
from offerlens.operators.identity import IdentityRules, TagInteraction, TokenRule
from offerlens.plans.registry import query

RULES = IdentityRules(
    tokens=(
        TokenRule(r"(?i)parallel\s*foil", ("parallel", "foil")),
        TokenRule(r"(?i)unopened", ("unopened",)),
        TokenRule(r"(?i)opened", ("opened",)),
        TokenRule(r"(?i)parallel", ("parallel",)),
        TokenRule(r"(?i)^serial$", ("serial",)),
    ),
    interactions=(TagInteraction(if_all=("parallel",), drop=("foil",)),),
    rarity_pattern="(?i)^(?:r|sr|uc|c)$",
    noise_patterns=(r"^20\d{2}$",),
    trailing_phrases=("unopened", "opened"),
    model_prefix=r"(?i)^no[:.\s]*",
)


@query("id1_resolve_identity", """
SELECT l.p_partkey, l.shop_id, l.code AS model_code, l.p_name AS base_name, i.identity_key,
  array_to_string(list_sort(list_filter([l.vtag, l.adj], lambda t: t <> '')), '+') AS tags
FROM listings l JOIN identities i USING (p_partkey)""")
def resolve_identity(i):
    return identity.resolve_identity(i.listings.select("p_partkey", "shop_id", "name", "model_no"), RULES).select(
        "p_partkey", "shop_id", "model_code", "base_name", "identity_key", F.array_join("tags", "+").alias("tags"))


@query("id2_apply_tag_interactions", """
WITH t0 AS (SELECT p_partkey, [adj, split_part(p_name, ' ', 2), lower(p_type), 'size' || p_size % 10] AS t FROM parts),
t1 AS (SELECT p_partkey, list_filter(t, lambda x: x <> 'economy') AS t FROM t0),
t2 AS (SELECT p_partkey, CASE WHEN list_contains(t, 'hot') AND list_contains(t, 'gear') THEN list_append(list_filter(t, lambda x: x NOT IN ('hot', 'gear')), 'engine') ELSE t END AS t FROM t1),
t3 AS (SELECT p_partkey, CASE WHEN list_contains(t, 'promo') OR list_contains(t, 'large') THEN list_filter(t, lambda x: x <> 'red') ELSE t END AS t FROM t2),
t4 AS (SELECT p_partkey, CASE WHEN list_contains(t, 'blue') THEN list_filter(t, lambda x: NOT regexp_matches(x, '^size[0-4]$')) ELSE t END AS t FROM t3)
SELECT p_partkey, array_to_string(list_sort(list_distinct(t)), '+') AS tags FROM t4""")
def tag_interactions(i):
    rules = (TagInteraction(drop=("economy",)), TagInteraction(if_all=("hot", "gear"), add=("engine",), drop=("hot", "gear")),
             TagInteraction(if_any=("promo", "large"), drop=("red",)), TagInteraction(if_all=("blue",), drop_pattern="^size[0-4]$"))
    tags = F.array("adj", F.split_part("p_name", F.lit(" "), F.lit(2)), F.lower("p_type"), F.concat(F.lit("size"), (F.col("p_size") % 10).cast("string")))
    return i.parts.select("p_partkey", F.array_join(identity.apply_tag_interactions(F.array_distinct(tags), rules), "+").alias("tags"))


def stored(i):
    """A store with one item per listing under its old key, one offer each, and two former alias keys."""
    key = F.concat(F.lit("k"), F.col("p_partkey").cast("string"), "shop_id")
    listings = i.listings.withColumn("entity_key", key)
    items = listings.select(
        "entity_key", F.when((F.col("p_partkey") % 50 == 0) & (F.col("shop_id") == "N"), F.concat(F.lit("canon"), F.col("p_partkey").cast("string"))).alias("canonical_id"),
        "name", "model_no", F.when(F.col("shop_id") == "R", "").otherwise(F.concat(F.lit("img/"), "entity_key")).alias("image_url"), "ordinal", "latest_price")
    aliases = items.select("entity_key", F.concat(F.lit("was-"), "entity_key").alias("alias_key"))
    offers = listings.select("entity_key", "shop_id", "latest_price", F.concat(F.lit("img/"), "entity_key").alias("image_url"), F.col("name").alias("source_name"))
    shop_log = i.lots.select(F.concat(F.lit("k"), F.col("entity_key").cast("string"), "shop_id").alias("entity_key"), "shop_id", "date", "price")
    item_log = shop_log.filter("shop_id <> 'N'").withColumn("shop_id", F.lit("*"))
    return merge.Store(items, aliases, offers, shop_log.unionByName(item_log))


# Merge order of the old items of a new key: the running newest date decides.
MERGED = """
recs AS (SELECT *, max(last_date) OVER (PARTITION BY identity_key, shop_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM old),
ranked AS (SELECT *, CASE WHEN before IS NULL OR last_date >= before THEN ordinal ELSE -ordinal - 1 END AS rank FROM recs),
shop_log AS (SELECT identity_key AS entity_key, r.shop_id, date, max_by(l.price, rank) AS price FROM lots l JOIN ranked r ON l.entity_key = r.p_partkey AND l.shop_id = r.shop_id GROUP BY ALL),
item_log AS (SELECT identity_key AS entity_key, date, max_by(l.price, ordinal) AS price FROM lots l JOIN ranked r ON l.entity_key = r.p_partkey AND l.shop_id = r.shop_id
             WHERE l.shop_id <> 'N' GROUP BY ALL),
new_offers AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY identity_key, shop_id ORDER BY last_date DESC, ordinal DESC) AS rn FROM old) WHERE rn = 1),
named AS (SELECT identity_key, name FROM (SELECT *, row_number() OVER (PARTITION BY identity_key ORDER BY
    CASE WHEN p_partkey % 50 = 0 AND shop_id = 'N' THEN 0 ELSE 1 + length(name) END, ordinal) AS rn FROM old) WHERE rn = 1),
models AS (SELECT identity_key, model_no FROM (SELECT *, row_number() OVER (PARTITION BY identity_key ORDER BY
    CASE WHEN model_no = code THEN 0 ELSE 1 END, ordinal) AS rn FROM old) WHERE rn = 1),
pics AS (SELECT identity_key, 'img/' || min_by(old_key, ordinal) AS image_url FROM old WHERE shop_id <> 'R' GROUP BY 1),
canon AS (SELECT identity_key, 'canon' || min_by(p_partkey, ordinal) AS canonical_id FROM old WHERE p_partkey % 50 = 0 AND shop_id = 'N' GROUP BY 1),
new_items AS (SELECT n.identity_key AS entity_key, c.canonical_id, n.name, m.model_no, coalesce(p.image_url, '') AS image_url
  FROM named n JOIN models m USING (identity_key) LEFT JOIN pics p USING (identity_key) LEFT JOIN canon c USING (identity_key)),
new_aliases AS (SELECT identity_key AS entity_key, unnest([old_key, 'was-' || old_key, name || '_' || model_no]) AS alias_key FROM old)
"""
STORED = """
old AS (SELECT l.*, i.identity_key, 'k' || l.p_partkey || l.shop_id AS old_key FROM listings l JOIN identities i USING (p_partkey)),""" + MERGED
# Listings of every tenth part are new; of the others the first one of each identity is stored under its key.
PARTLY_STORED = """
firsts AS (SELECT i.identity_key, min(l.ordinal) AS ordinal FROM listings l JOIN identities i USING (p_partkey) WHERE p_partkey % 10 <> 0 GROUP BY 1),
old AS (SELECT l.*, i.identity_key, CASE WHEN f.ordinal IS NULL THEN 'k' || l.p_partkey || l.shop_id ELSE i.identity_key END AS old_key
  FROM listings l JOIN identities i USING (p_partkey) LEFT JOIN firsts f ON f.identity_key = i.identity_key AND f.ordinal = l.ordinal WHERE f.ordinal IS NOT NULL OR l.p_partkey % 10 = 0),""" + MERGED


@query("id3_rekey", f"""WITH {STORED}
SELECT o.identity_key AS entity_key, o.shop_id, o.latest_price, 'img/' || o.old_key AS image_url, o.name AS source_name, n.name, n.model_no, n.canonical_id,
  (SELECT count(*) FROM shop_log s WHERE s.entity_key = o.identity_key AND s.shop_id = o.shop_id) AS entries,
  (SELECT count(DISTINCT alias_key) FROM new_aliases a WHERE a.entity_key = o.identity_key) AS n_aliases
FROM new_offers o JOIN new_items n ON n.entity_key = o.identity_key""")
def rekey(i):
    s = merge.rekey(stored(i), RULES)
    entries = s.history.groupBy("entity_key", "shop_id").agg(F.count(F.lit(1)).alias("entries"))
    n_aliases = s.aliases.groupBy("entity_key").agg(F.count(F.lit(1)).alias("n_aliases"))
    return (s.offers.drop("last_date").join(s.items.select("entity_key", "name", "model_no", "canonical_id"), "entity_key")
            .join(entries, ["entity_key", "shop_id"]).join(n_aliases, "entity_key"))


REKEYED = """
SELECT o.identity_key AS entity_key, o.shop_id, o.latest_price, 'img/' || o.old_key AS image_url, o.name AS source_name, n.name, n.model_no, n.canonical_id,
  (SELECT count(*) FROM shop_log s WHERE s.entity_key = o.identity_key AND s.shop_id = o.shop_id) AS entries,
  (SELECT CAST(sum(price) AS BIGINT) FROM item_log s WHERE s.entity_key = o.identity_key) AS logged,
  (SELECT count(DISTINCT alias_key) FROM new_aliases a WHERE a.entity_key = o.identity_key AND a.alias_key <> a.entity_key) AS n_aliases
FROM new_offers o JOIN new_items n ON n.entity_key = o.identity_key"""


def partly_rekeyed(i):
    """A store of which nine tenths of the parts already have their keys, with one listing each, and the keys of the others."""
    known = i.listings.join(i.identities.select("p_partkey", "identity_key"), "p_partkey")
    firsts = known.filter("p_partkey % 10 <> 0").groupBy("identity_key").agg(F.min("ordinal").alias("ordinal")).withColumn("first", F.lit(True))
    placed = known.join(firsts, ["identity_key", "ordinal"], "left").filter("first OR p_partkey % 10 = 0")
    listings = placed.withColumn("entity_key", F.when(F.col("first"), F.col("identity_key")).otherwise(F.concat(F.lit("k"), F.col("p_partkey").cast("string"), "shop_id")))
    image = F.concat(F.lit("img/"), "entity_key")
    items = listings.select(
        "entity_key", F.when((F.col("p_partkey") % 50 == 0) & (F.col("shop_id") == "N"), F.concat(F.lit("canon"), F.col("p_partkey").cast("string"))).alias("canonical_id"),
        "name", "model_no", F.when(F.col("shop_id") == "R", "").otherwise(image).alias("image_url"), "ordinal")
    spelled = listings.filter("first").select("entity_key", F.concat_ws("_", "name", "model_no").alias("alias_key"))
    aliases = items.select("entity_key", F.concat(F.lit("was-"), "entity_key").alias("alias_key")).unionByName(spelled)
    offers = listings.select("entity_key", "shop_id", "latest_price", image.alias("image_url"), F.col("name").alias("source_name"))
    shop_log = i.lots.withColumnRenamed("entity_key", "p_partkey").join(listings.select("p_partkey", "shop_id", "entity_key"), ["p_partkey", "shop_id"]).select("entity_key", "shop_id", "date", "price")
    item_log = shop_log.filter("shop_id <> 'N'").withColumn("shop_id", F.lit("*"))
    store = merge.Store(*map(written, (items, aliases, offers, shop_log.unionByName(item_log))))
    return store, listings.filter("first IS NULL").select("entity_key")


def _rekeyed(s):
    shop = F.col("shop_id") != "*"
    entries = s.history.filter(shop).groupBy("entity_key", "shop_id").agg(F.count(F.lit(1)).alias("entries"))
    logged = s.history.filter(~shop).groupBy("entity_key").agg(F.sum("price").alias("logged"))
    n_aliases = s.aliases.groupBy("entity_key").agg(F.count(F.lit(1)).alias("n_aliases"))
    return (s.offers.drop("last_date").join(s.items.select("entity_key", "name", "model_no", "canonical_id"), "entity_key")
            .join(entries, ["entity_key", "shop_id"], "left").join(logged, "entity_key", "left").join(n_aliases, "entity_key", "left"))


@query("id3_rekey_changed", f"WITH {PARTLY_STORED} {REKEYED}")
def rekey_changed(i):
    """Every key recomputed, only the items of new keys merged."""
    return _rekeyed(merge.rekey_changed(partly_rekeyed(i)[0], RULES))


@query("id7_rekey_touched", f"WITH {PARTLY_STORED} {REKEYED}")
def rekey_touched(i):
    """The keys of new items recomputed, those of the others trusted."""
    store, new = partly_rekeyed(i)
    return _rekeyed(merge.rekey_changed(store, RULES, new))


@query("id3_default_offers", f"""WITH {STORED}
SELECT identity_key AS entity_key, CASE shop_id WHEN 'R' THEN 'D' ELSE shop_id END AS shop_id, latest_price, CASE shop_id WHEN 'R' THEN '' ELSE 'img/' || old_key END AS image_url,
  CASE shop_id WHEN 'R' THEN NULL ELSE name END AS source_name,
  (SELECT count(*) FROM shop_log s WHERE s.entity_key = o.identity_key AND s.shop_id = o.shop_id) AS entries
FROM new_offers o""")
def default_offers(i):
    """Items of shop R are stored without offer and shop history: they get one of shop D with the item's price and history."""
    s = stored(i)
    bare = merge.Store(s.items.filter("entity_key IS NOT NULL"), s.aliases, s.offers.filter("shop_id <> 'R'"), s.history.filter("shop_id <> 'R'"))
    out = merge.rekey(bare, RULES, default_shop="D")
    entries = out.history.groupBy("entity_key", "shop_id").agg(F.count(F.lit(1)).alias("entries"))
    return out.offers.drop("last_date").join(entries, ["entity_key", "shop_id"])


@query("id4_merge_histories", f"WITH {STORED} SELECT entity_key, shop_id, date, price FROM shop_log UNION ALL SELECT entity_key, '*', date, price FROM item_log")
def merge_histories(i):
    return merge.rekey(stored(i), RULES).history


def _keyed_offers(i):
    return i.listings.join(i.identities.select("p_partkey", F.col("identity_key").alias("entity_key")), "p_partkey").select(
        "entity_key", "shop_id", "latest_price", F.col("name").alias("source_name"), "last_date", "ordinal")


@query("id5_merge_offers", f"WITH {STORED} SELECT identity_key AS entity_key, shop_id, latest_price, name AS source_name, last_date, ordinal FROM new_offers")
def merge_offers(i):
    return merge.merge_offers(_keyed_offers(i))


@query("id6_merge_items", f"WITH {STORED} SELECT * FROM new_items")
def merge_items(i):
    s = stored(i)
    keys = i.listings.select(F.concat(F.lit("k"), F.col("p_partkey").cast("string"), "shop_id").alias("entity_key"), "p_partkey").join(
        i.identities.select("p_partkey", "identity_key"), "p_partkey")
    moved = s.items.join(keys, "entity_key").drop("entity_key", "p_partkey").withColumnRenamed("identity_key", "entity_key")
    return merge.merge_items(moved).drop("ordinal")


@query("id7_migrate_keys", f"""WITH {STORED},
best AS (SELECT identity_key AS entity_key, max_by(shop_id, latest_price * 10 - ascii(shop_id) % 10 / 10.0) AS shop_id FROM new_offers GROUP BY 1),
b AS (SELECT o.* FROM (SELECT *, row_number() OVER (PARTITION BY identity_key ORDER BY latest_price DESC, shop_id) AS rk FROM new_offers) o WHERE rk = 1),
logs AS (SELECT coalesce(s.entity_key, i.entity_key) AS entity_key, coalesce(s.date, i.date) AS date, coalesce(s.price, i.price) AS price
  FROM (SELECT s.* FROM shop_log s JOIN b ON b.identity_key = s.entity_key AND b.shop_id = s.shop_id) s FULL JOIN item_log i ON s.entity_key = i.entity_key AND s.date = i.date)
SELECT n.entity_key, n.name, n.model_no, b.shop_id AS best_shop_id, b.latest_price AS best_price, count(*) AS entries, CAST(sum(l.price) AS BIGINT) AS logged
FROM new_items n JOIN b ON b.identity_key = n.entity_key JOIN logs l ON l.entity_key = n.entity_key GROUP BY ALL""")
def migrate_keys(i):
    s = stored(i)
    store, _ = merge.migrate_keys(s, s.items.select(F.lit("c").alias("canonical_id"), F.lit("A").alias("shop_id"), F.col("entity_key").alias("source_key"), "name", "model_no"),
                                  i.lot_shops, RULES)
    log = store.history.filter("shop_id = '*'").groupBy("entity_key").agg(F.count(F.lit(1)).alias("entries"), F.sum("price").alias("logged"))
    return store.items.select("entity_key", "name", "model_no", "best_shop_id", "best_price").join(log, "entity_key")


@query("id7_migrate_alias_members", f"""WITH {STORED}
SELECT 'c' AS canonical_id, shop_id, identity_key AS source_key, name, model_no, p_size > 25 AS changed FROM old""")
def migrate_alias_members(i):
    """Members of larger parts still carry their old key."""
    old = F.concat(F.lit("k"), F.col("p_partkey").cast("string"), "shop_id")
    members = i.listings.join(i.identities.select("p_partkey", "identity_key"), "p_partkey").select(
        F.lit("c").alias("canonical_id"), "shop_id", F.when(F.col("p_size") > 25, old).otherwise(F.col("identity_key")).alias("source_key"), "name", "model_no")
    return merge.migrate_keys(stored(i), members, i.lot_shops, RULES)[1]
