"""Queries for the variant catalog and collection matching: parts of a code are its variants and its priced items."""

from pyspark.sql import functions as F

from offerlens.functions.durable import checkpointed, written
from offerlens.operators import catalog as cat
from offerlens.operators import collection as col
from offerlens.plans.identity_queries import RULES
from offerlens.plans.registry import query

RESTRICTED = ("opened", "unopened")


def text(c):
    return F.col(c).cast("string")


def official(i):
    cards = i.parts.groupBy("code").agg(F.min("p_partkey").alias("ordinal")).select(
        F.lower("code").alias("card_number"), F.concat(F.lit("Card "), "code").alias("card_name"), F.lit("pack").alias("get_info"), "ordinal")
    manifest = i.parts.select(
        F.col("code").alias("number"), (F.col("p_partkey") % 6).alias("position"),
        F.when(F.col("p_size") % 3 == 0, None).when(F.col("p_size") % 10 == 0, (F.col("p_partkey") % 6 + 1000).cast("string")).otherwise((F.col("p_partkey") % 6).cast("string")).alias("variant_index"),
        F.col("vtag").alias("label"), F.when(F.col("p_size") > 45, "box set").alias("get_info"), F.lit("").alias("source"),
        F.concat(F.lit("http://img/"), text("p_partkey"), F.lit(".webp?v=1")).alias("source_url"), F.lit("").alias("path"), F.lit("").alias("fallback_path"), F.lit("").alias("card_name"),
        F.when(F.col("p_size") % 8 == 0, F.concat(F.lit("h"), text("p_partkey"))).alias("dhash"))
    hashes = i.parts.filter("p_size % 4 = 0").select(F.concat(F.lit("http://img/"), text("p_partkey"), F.lit(".webp?v=1")).alias("url"), F.concat(F.lit("h"), text("p_partkey")).alias("signature"))
    return cat.official_variants(cards, manifest, hashes, RULES, min_cards=10)


OFFICIAL = """
idx AS (SELECT *, CASE WHEN p_size % 3 <> 0 AND p_size % 10 = 0 THEN 1000 + p_partkey % 6 ELSE p_partkey % 6 END AS ix FROM parts),
official AS (SELECT *, code || CASE WHEN ix >= 1000 THEN '_r' || (ix - 1000) WHEN ix > 0 THEN '_p' || ix ELSE '' END AS variant_id,
    CASE WHEN ix >= 1000 THEN 'alternate-rarity' WHEN ix > 0 THEN 'alternate-art' ELSE 'normal' END AS vtype,
    CASE WHEN p_size % 4 = 0 THEN 'h' || p_partkey END AS hash,
    CASE WHEN ix = 0 THEN [] ELSE list_sort(list_filter([vtag, CASE WHEN p_size > 45 THEN 'boxset' ELSE '' END], lambda t: t <> '')) END AS expected FROM idx)
"""


@query("cat1_official_variants", f"""WITH {OFFICIAL}
SELECT code || '::' || variant_id AS variant_key, code AS card_number, 'Card ' || code AS card_name, variant_id, vtype AS variant_type, CAST(ix AS INTEGER) AS variant_index,
  CASE WHEN vtag <> '' THEN vtag WHEN ix = 0 THEN '通常' ELSE '別イラスト' END AS label, CASE WHEN p_size > 45 THEN 'box set' ELSE 'pack' END AS get_info, hash AS image_hash, array_to_string(expected, '+') AS tags
FROM official""")
def official_variants(i):
    return official(i).select("variant_key", "card_number", "card_name", "variant_id", "variant_type", "variant_index", "label", "get_info", "image_hash",
                              F.array_join("identity_tags", "+").alias("tags"))


def provisional_rows(i):
    """Provisional rows of the larger parts, some of them of numbers without official variants; images overlap in chains."""
    n = F.col("p_partkey")
    return i.parts.filter("p_size > 20").select(
        F.when(F.col("p_size") > 40, F.concat(F.lit("PRB99-"), F.substring("code", 6, 3))).otherwise(F.col("code")).alias("card_number"), n.alias("seq"), F.col("p_name").alias("card_name"),
        F.when(F.col("p_size") % 5 == 0, "").otherwise(F.concat(F.lit("p/img"), (n - n % 2).cast("string"), F.lit(".png"))).alias("image_path"),
        F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("http://img/"), n.cast("string"), F.lit(".webp"))).otherwise(F.concat(F.lit("http://new/c"), ((n + 1) % 4).cast("string"), F.lit(".jpg?x=1"))).alias("image_url"),
        F.when(F.col("p_size") % 2 == 0, "Series").alias("series_title"), F.lit("").alias("get_info"))


@query("cat2_provisional_variants", f"""WITH RECURSIVE {OFFICIAL},
prov AS (SELECT CASE WHEN p_size > 40 THEN 'PRB99-' || substr(code, 6, 3) ELSE code END AS number, p_partkey AS seq, p_size,
    CASE WHEN p_size % 5 <> 0 THEN 'p/img' || (p_partkey - p_partkey % 2) || '.png' END AS image_path,
    CASE WHEN p_size % 7 = 0 THEN 'http://img/' || p_partkey || '.webp' ELSE 'http://new/c' || ((p_partkey + 1) % 4) || '.jpg?x=1' END AS image_url FROM parts WHERE p_size > 20),
img AS (SELECT *, list_filter([CASE WHEN p_size % 7 = 0 THEN CAST(seq AS VARCHAR) ELSE 'c' || ((seq + 1) % 4) END, CASE WHEN p_size % 5 <> 0 THEN 'img' || (seq - seq % 2) END], lambda t: t IS NOT NULL) AS ids,
    row_number() OVER (PARTITION BY number ORDER BY seq) AS rn FROM prov),
shown AS (SELECT code, list(CAST(p_partkey AS VARCHAR)) AS ids FROM parts GROUP BY code),
walk AS (
  SELECT n.number, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, false AS ok, coalesce(s.ids, []) AS taken FROM (SELECT DISTINCT number FROM prov) n LEFT JOIN shown s ON s.code = n.number
  UNION ALL
  SELECT w.number, i.rn, CAST(i.seq AS BIGINT), NOT list_has_any(w.taken, i.ids), CASE WHEN list_has_any(w.taken, i.ids) THEN w.taken ELSE list_concat(w.taken, i.ids) END
  FROM walk w JOIN img i ON i.number = w.number AND i.rn = w.rn + 1),
accepted AS (SELECT number, seq, row_number() OVER (PARTITION BY number ORDER BY seq) AS nth FROM walk WHERE ok),
free AS (SELECT c.code, k, row_number() OVER (PARTITION BY c.code ORDER BY k) AS nth FROM (SELECT DISTINCT code, unnest(range(1, 40)) AS k FROM parts) c
   WHERE NOT EXISTS (SELECT 1 FROM official o WHERE o.code = c.code AND o.ix = c.k)),
placed AS (SELECT a.number, a.seq, CASE WHEN s.code IS NULL THEN a.nth - 1 ELSE f.k END AS ix FROM accepted a LEFT JOIN shown s ON s.code = a.number LEFT JOIN free f ON f.code = a.number AND f.nth = a.nth)
SELECT number || '::' || number || CASE WHEN ix > 0 THEN '_p' || ix ELSE '' END AS variant_key, number AS card_number, number || CASE WHEN ix > 0 THEN '_p' || ix ELSE '' END AS variant_id,
  CAST(ix AS INTEGER) AS variant_index, CASE WHEN p_size % 2 = 0 THEN '{cat.PROVISIONAL_PREFIX}Series' ELSE '{cat.PROVISIONAL_LABEL}' END AS label, image_url AS source_url, coalesce(image_path, image_url) AS path
FROM placed JOIN img USING (number, seq)""")
def provisional_variants(i):
    """Rows are taken in order, each only if none of its images was taken before: a walk per number in the oracle, rounds here."""
    made = cat.provisional_variants(official(i), provisional_rows(i), i.img_vectors.select("url", F.lit("s").alias("signature")), RULES)
    return made.select("variant_key", "card_number", "variant_id", "variant_index", "label", "source_url", "path")


@query("cat3_catalog_summary", """SELECT (SELECT count(*) FROM parts) AS cards, (SELECT count(DISTINCT code) FROM parts) AS manifest_cards,
  (SELECT count(*) FROM parts WHERE p_size > 20) AS provisional_cards, '2024-01-30 06:10:00' AS generated_at, true AS synced""")
def catalog_summary(i):
    made = cat.catalog_summary(i.parts, i.parts.select(F.col("code").alias("number")), provisional_rows(i), "2024-01-30 06:10:00")
    return made.select("cards", "manifest_cards", "provisional_cards", F.col("generated_at").cast("string").alias("generated_at"), F.col("synced_at").isNotNull().alias("synced"))


@query("cat3_catalog_snapshot", f"""WITH {OFFICIAL},
prov AS (SELECT code, p_partkey, row_number() OVER (PARTITION BY code ORDER BY p_partkey) AS rn FROM parts),
free AS (SELECT c.code, k, row_number() OVER (PARTITION BY c.code ORDER BY k) AS rn FROM (SELECT DISTINCT code, unnest(range(1, 20)) AS k FROM parts) c
   WHERE NOT EXISTS (SELECT 1 FROM official o WHERE o.code = c.code AND o.ix = c.k))
SELECT code || '::' || variant_id AS variant_key, CAST(ix AS INTEGER) AS variant_index, false AS provisional FROM official
UNION ALL SELECT p.code || '::' || p.code || '_p' || f.k, CAST(f.k AS INTEGER), true FROM prov p JOIN free f ON f.code = p.code AND f.rn = p.rn""")
def catalog_snapshot(i):
    """Official variants and provisional ones with images of their own on the free indexes."""
    rows = i.parts.select(
        F.col("code").alias("card_number"), F.col("p_partkey").alias("seq"), F.lit("x").alias("card_name"), F.concat(F.lit("solo/q"), text("p_partkey")).alias("image_path"),
        F.lit("").alias("image_url"), F.lit("").alias("series_title"), F.lit("").alias("get_info"))
    off = written(official(i))
    no_hashes = i.img_vectors.select("url", F.lit("").alias("signature"))
    return cat.catalog_snapshot(off, cat.provisional_variants(off, rows, no_hashes, RULES)).select("variant_key", "variant_index", "provisional")


def priced(i):
    """Priced items: one per part, with the images shops show and the hashes of some of them."""
    items = i.parts.select(
        F.concat(F.lit("k"), text("p_partkey")).alias("entity_key"), F.when(F.col("p_size") == 50, F.concat(F.lit("canon"), text("p_partkey"))).alias("canonical_id"),
        F.concat("p_name", F.when(F.col("vtag") != "", F.concat(F.lit(" ["), "vtag", F.lit("]"))).when((F.col("p_partkey") % 6 == 1) & (F.col("p_size") > 25), " [fullart]").otherwise("")).alias("name"),
        F.col("code").alias("model_no"), F.lit("").alias("image_url"), F.col("p_partkey").alias("ordinal"))
    shown = F.concat(F.lit("http://shop/x/"), text("p_partkey"), F.lit(".PNG?z"))
    offers = i.listings.select(F.concat(F.lit("k"), text("p_partkey")).alias("entity_key"), F.when(F.col("p_size") % 2 == 0, shown).otherwise(
        F.concat(F.lit("http://shop/"), "shop_id", text("p_partkey"), F.lit(".jpg"))).alias("image_url"))
    # Two neighbours share the hash of the even one.
    hashes = i.parts.filter("p_size % 4 = 0").select(shown.alias("url"), F.concat(F.lit("h"), (F.col("p_partkey") - F.when(F.col("p_size") > 30, F.col("p_partkey") % 2).otherwise(0)).cast("string")).alias("signature"))
    return cat.price_index(items, offers, hashes, RULES)


PRICED = """
entries AS (SELECT p_partkey AS entry_id, code, CASE WHEN p_size = 50 THEN 'canon' ELSE 'k' END || p_partkey AS price_key, p_size,
    CASE WHEN vtag <> '' THEN [vtag] WHEN p_partkey % 6 = 1 AND p_size > 25 THEN ['fullart'] ELSE [] END AS tags,
    CASE WHEN p_size % 2 = 0 THEN CAST(p_partkey AS VARCHAR) END AS image, CASE WHEN p_size % 4 = 0 THEN 'h' || (p_partkey - CASE WHEN p_size > 30 THEN p_partkey % 2 ELSE 0 END) END AS h
  FROM parts)
"""
ALLOWED = """(len(list_filter(e.tags, lambda t: t IN ('opened', 'unopened') AND NOT list_contains(v.expected, t))) = 0 AND CASE WHEN v.vtype = 'normal' THEN len(e.tags) = 0 ELSE len(e.tags) > 0 END)"""


@query("cat4_price_index", f"""WITH {PRICED}
SELECT price_key, code AS card_number, array_to_string(tags, '+') AS tag_sig, CAST(CASE WHEN p_size % 2 = 0 THEN 1 ELSE coalesce(n, 0) END AS BIGINT) AS images, h AS hash
FROM entries LEFT JOIN (SELECT p_partkey, count(*) AS n FROM listings GROUP BY 1) l ON l.p_partkey = entry_id""")
def price_index(i):
    entries, images, hashes = priced(i)
    n = images.groupBy("entry_id").agg(F.count(F.lit(1)).alias("images"))
    return entries.join(n, "entry_id", "left").join(hashes, "entry_id", "left").select(
        "price_key", "card_number", "tag_sig", F.coalesce("images", F.lit(0)).alias("images"), "hash")


# Steps of a variant over all entries of its number.
MAPPED = f"""
vx AS (SELECT v.code || '::' || v.variant_id AS variant_key, v.code, v.variant_id, v.vtype, v.expected, v.hash,
    count(*) FILTER (e.h = v.hash AND {ALLOWED}) AS n1, min(price_key) FILTER (e.h = v.hash AND {ALLOWED}) AS k1,
    count(*) FILTER (e.image = CAST(v.p_partkey AS VARCHAR) AND {ALLOWED}) AS n2, min(price_key) FILTER (e.image = CAST(v.p_partkey AS VARCHAR) AND {ALLOWED}) AS k2,
    count(*) FILTER (v.vtype = 'normal' AND len(e.tags) = 0) AS n3, min(price_key) FILTER (len(e.tags) = 0) AS k3,
    count(*) FILTER (len(v.expected) > 0 AND e.tags = v.expected) AS n4, min(price_key) FILTER (e.tags = v.expected) AS k4,
    count(*) AS n5, count(*) FILTER (v.vtype = 'normal' AND {ALLOWED}) AS a5, min(price_key) AS k5
  FROM official v JOIN entries e ON e.code = v.code GROUP BY ALL),
mapped AS (SELECT variant_key, code AS card_number, variant_id, CASE WHEN n1 = 1 THEN k1 WHEN n2 = 1 THEN k2 WHEN n3 = 1 THEN k3 WHEN n4 = 1 THEN k4 WHEN n5 = 1 AND a5 = 1 THEN k5 END AS price_key,
    CASE WHEN n1 = 1 THEN 'image-hash' WHEN n2 = 1 THEN 'image-path' WHEN n3 = 1 THEN 'normal-variant-tags' WHEN n4 = 1 THEN 'variant-tags' WHEN n5 = 1 AND a5 = 1 THEN 'unique-card-number' END AS method FROM vx)
"""


@query("cat5_variant_mappings", f"WITH {OFFICIAL}, {PRICED}, {MAPPED} SELECT * FROM mapped WHERE price_key IS NOT NULL")
def variant_mappings(i):
    return cat.variant_mappings(official(i), priced(i), RESTRICTED).drop("confirmed_by")


def payloads(i):
    """A collection file per 50 parts; every seventh file breaks one rule of the format."""
    k = F.col("p_size") % 7
    variant = F.concat("code", F.when(k == 0, "").when(k == 6, "_p77").otherwise(F.concat(F.lit("_p"), k.cast("string"))))
    file = F.floor(F.col("p_partkey") / 50)
    bad = (file % 7 == 3) & (F.col("p_partkey") % 50 == 20)
    item = F.struct(
        F.concat(F.lit("  "), F.lower("code")).alias("cardNumber"), F.concat(F.lit('The "'), "p_name", F.lit('"')).alias("cardName"), variant.alias("variantId"),
        F.when(bad, "other").when(F.col("p_size") % 2 == 0, F.concat_ws("::", F.col("code"), variant)).alias("id"), (F.col("p_size") % 4).alias("count"))
    files = i.parts.groupBy(file.alias("payload_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("x")))), lambda r: r["x"]).alias("items"))
    version = F.when(F.col("payload_id") % 7 == 5, 2).otherwise(1)
    return files.select("payload_id", F.to_json(F.struct(F.lit("card-collection").alias("format"), version.alias("version"), "items")).alias("body"))


PAYLOADS = """
listed AS (SELECT p_partkey, CAST(floor(p_partkey / 50) AS BIGINT) AS payload_id, CAST(p_partkey % 50 AS INTEGER) AS position, code, p_name, p_size % 4 AS cnt,
    code || CASE p_size % 7 WHEN 0 THEN '' WHEN 6 THEN '_p77' ELSE '_p' || p_size % 7 END AS variant_id, CASE p_size % 7 WHEN 0 THEN 'normal' ELSE 'alternate-art' END AS vtype FROM parts),
files AS (SELECT payload_id, count(*) AS n FROM listed GROUP BY 1),
good AS (SELECT * FROM listed WHERE payload_id % 7 <> 5 AND NOT (payload_id % 7 = 3 AND payload_id IN (SELECT payload_id FROM listed WHERE position = 20)))
"""


@query("col1_collection_violations", f"""WITH {PAYLOADS} SELECT payload_id, CAST(NULL AS INTEGER) AS position, 'version too new' AS violation FROM files WHERE payload_id % 7 = 5
UNION ALL SELECT payload_id, 20, 'id does not fit cardNumber and variantId' FROM listed WHERE payload_id % 7 = 3 AND position = 20""")
def collection_violations(i):
    return col.collection_violations(payloads(i))


@query("col1_validate_collection", f"""WITH {PAYLOADS} SELECT payload_id, position, code || '::' || variant_id AS id, code AS card_number, 'The "' || p_name || '"' AS card_name, variant_id, vtype AS variant_type,
  CAST(cnt AS BIGINT) AS count FROM good""")
def validate_collection(i):
    return col.collection_items(payloads(i))


def results(i):
    catalog, index = official(i), priced(i)
    generated = checkpointed(cat.variant_mappings(catalog, index, RESTRICTED).filter("method <> 'image-path'").select("variant_key", "price_key", "confirmed_by"))
    manual = i.parts.filter("p_partkey % 6 = 0 AND p_size <= 25").select(
        F.concat("code", F.lit("::"), "code", F.lit("_p77")).alias("variant_key"), F.concat(F.lit("k"), text("p_partkey")).alias("price_key"), F.lit(None).cast("string").alias("confirmed_by"))
    return col.match_collection(col.collection_items(payloads(i)), index, catalog, manual, generated, RESTRICTED), index


MATCHED = f"""
held AS (SELECT g.*, g.code || '::' || g.variant_id AS id FROM good g WHERE cnt > 0),
cx AS (SELECT h.payload_id, h.position, h.id, h.code, h.variant_id, h.vtype, h.cnt, coalesce(any_value(o.expected), []) AS expected, any_value(o.hash) AS hash FROM held h
   LEFT JOIN (SELECT code || '::' || variant_id AS id, max_by(expected, coalesce(hash, '')) AS expected, max(hash) AS hash FROM official GROUP BY 1) o ON o.id = h.id GROUP BY ALL),
cy AS (SELECT v.*, count(e.entry_id) AS n, count(*) FILTER (e.h = v.hash AND {ALLOWED}) AS nh, min(price_key) FILTER (e.h = v.hash AND {ALLOWED}) AS kh,
    count(*) FILTER ((v.vtype = 'normal' OR len(v.expected) > 0) AND list_sort(e.tags) = list_sort(v.expected)) AS nt, min(price_key) FILTER (e.tags = v.expected) AS kt
  FROM cx v LEFT JOIN entries e ON e.code = v.code GROUP BY ALL),
cz AS (SELECT y.*, man.price_key AS km, gen.price_key AS kg FROM cy y
   LEFT JOIN (SELECT code || '::' || code || '_p77' AS id, 'k' || p_partkey AS price_key FROM parts WHERE p_partkey % 6 = 0 AND p_size <= 25) man ON man.id = y.id
   LEFT JOIN (SELECT variant_key AS id, max(price_key) AS price_key FROM mapped WHERE price_key IS NOT NULL AND method <> 'image-path' GROUP BY 1) gen ON gen.id = y.id),
res AS (SELECT *, CASE WHEN km IS NOT NULL OR kg IS NOT NULL OR nh = 1 THEN 'matched' WHEN nh > 1 THEN 'ambiguous' WHEN nt = 1 THEN 'matched' WHEN nt > 1 THEN 'ambiguous' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status,
    CASE WHEN km IS NOT NULL THEN 'manual-alias' WHEN kg IS NOT NULL THEN 'generated-map' WHEN nh = 1 THEN 'image-hash' WHEN nh > 1 THEN 'image-hash-multiple' WHEN nt = 1 THEN 'variant-tags'
      WHEN nt > 1 THEN 'variant-tags-multiple' WHEN n > 1 THEN 'card-number-multiple' WHEN n = 1 THEN 'variant-unconfirmed' ELSE 'card-number-not-found' END AS why,
    coalesce(km, kg, CASE WHEN nh = 1 THEN kh WHEN nh > 1 THEN NULL WHEN nt = 1 THEN kt END) AS price_key FROM cz)
"""
ALL = f"WITH {OFFICIAL}, {PRICED}, {MAPPED}, {PAYLOADS}, {MATCHED}"


@query("col2_match_collection", f"{ALL} SELECT payload_id, position, id, CAST(cnt AS BIGINT) AS count, status, why, price_key FROM res")
def match_collection(i):
    return results(i)[0].select("payload_id", "position", "id", "count", "status", F.coalesce("method", "reason").alias("why"), "price_key")


@query("col3_collection_summary", f"""{ALL} SELECT CAST(sum(cnt) AS BIGINT) AS total_cards, count(*) AS total_kinds, count(*) FILTER (status = 'matched') AS matched_kinds,
  CAST(sum(cnt) FILTER (status = 'matched') AS BIGINT) AS matched_cards, count(*) FILTER (status = 'ambiguous') AS ambiguous_kinds, count(*) FILTER (status = 'unmatched') AS unmatched_kinds FROM res""")
def collection_summary(i):
    return col.collection_summary(results(i)[0])


@query("col3_matches_by_key", f"{ALL} SELECT payload_id, price_key, CAST(sum(cnt) AS BIGINT) AS count, count(*) AS kinds FROM res WHERE status = 'matched' GROUP BY ALL")
def matches_by_key(i):
    return col.matches_by_key(results(i)[0])


def _apply(i, mode):
    matches = i.orders.groupBy(F.col("o_custkey").alias("owner_id"), (F.col("o_orderkey") % 97).alias("entity_key")).agg((F.count(F.lit(1)) * 2 - 1).alias("count"))
    return col.apply_matches(i.holdings, matches, mode)


for _mode, _value in (("replace-matched", "m.c"), ("add", "coalesce(h.qty, 0) + m.c")):
    query(f"col4_apply_matches_{_mode.split('-')[0]}", f"""
WITH m AS (SELECT o_custkey AS owner_id, o_orderkey % 97 AS entity_key, count(*) * 2 - 1 AS c FROM orders GROUP BY 1, 2)
SELECT coalesce(h.owner_id, m.owner_id) AS owner_id, coalesce(h.entity_key, m.entity_key) AS entity_key, CASE WHEN m.c IS NULL THEN h.qty ELSE {_value} END AS qty
FROM holdings h FULL JOIN m ON h.owner_id = m.owner_id AND h.entity_key = m.entity_key""")(lambda i, mode=_mode: _apply(i, mode))


@query("col5_unresolved_export", f"""{ALL},
cand AS (SELECT v.payload_id, v.position, string_agg(e.price_key, '|' ORDER BY e.entry_id) AS candidate_keys FROM res v JOIN entries e ON e.code = v.code
  WHERE CASE v.why WHEN 'image-hash-multiple' THEN e.h = v.hash AND {ALLOWED} WHEN 'variant-tags-multiple' THEN e.tags = v.expected ELSE true END GROUP BY 1, 2)
SELECT r.payload_id, r.position, r.code AS card_number, r.variant_id, r.vtype AS variant_type, CAST(r.cnt AS BIGINT) AS count, r.status, r.why AS reason, coalesce(candidate_keys, '') AS candidate_keys
FROM res r LEFT JOIN cand USING (payload_id, position) WHERE r.status <> 'matched'""")
def unresolved_export(i):
    found, index = results(i)
    return col.unresolved_export(found, index, RESTRICTED).drop("card_name")


@query("col5_unresolved_file", f"""{ALL},
cand AS (SELECT v.payload_id, v.position, string_agg(e.price_key, '|' ORDER BY e.entry_id) AS candidate_keys FROM res v JOIN entries e ON e.code = v.code
  WHERE CASE v.why WHEN 'image-hash-multiple' THEN e.h = v.hash AND {ALLOWED} WHEN 'variant-tags-multiple' THEN e.tags = v.expected ELSE true END GROUP BY 1, 2)
SELECT '"' || r.code || '","The ' || repeat(chr(34), 2) || l.p_name || repeat(chr(34), 3) || ',"' || r.variant_id || '","' || r.vtype || '","' || r.cnt || '","' || r.status || '","' || r.why || '","' || coalesce(candidate_keys, '') || '"' AS line
FROM res r LEFT JOIN cand USING (payload_id, position) JOIN listed l USING (payload_id, position) WHERE r.status <> 'matched'""")
def unresolved_file(i):
    found, index = results(i)
    return col.unresolved_lines(col.unresolved_pieces(found, index, RESTRICTED), "|")
