"""Queries for candidates, gates and alias groups, on part listings with one item per shop."""

from pyspark.sql import functions as F

from offerlens.functions.durable import written
from offerlens.operators import aliases as al
from offerlens.operators import merge
from offerlens.operators import resolution as er
from offerlens.plans.identity_queries import RULES
from offerlens.plans.registry import query

HARD = "^(?:parallel|serial)$"
SHOP_ORDER = ("R", "A")


def er_tables(i):
    """items, aliases and offers: parts of some sizes carry one former key with a serial tag, others two that disagree."""
    e = i.er
    items = e.select(F.col("source_key").alias("entity_key"), "canonical_id", F.lit("unnamed").alias("name"), "model_no", F.lit("").alias("image_url"), "ordinal")
    offers = e.select(F.col("source_key").alias("entity_key"), "shop_id", "latest_price", F.col("er_name").alias("source_name"), F.col("img").alias("image_url"))
    one = e.filter("p_size % 10 = 0").select(F.col("source_key").alias("entity_key"), F.concat(F.upper("code"), F.lit("@Serial+x")).alias("alias_key"))
    two = e.filter("p_size % 10 = 1").select(F.col("source_key").alias("entity_key"), F.explode(F.array(
        F.concat("code", F.lit("@serial")), F.concat("code", F.lit("@parallel+y")), F.lit("zz-000@parallel"))).alias("alias_key"))
    return items, one.unionByName(two), offers


def records(i):
    items, aliases, offers = er_tables(i)
    return er.candidate_records(items, aliases, offers, i.lot_shops, RULES, HARD)


def signatures(i):
    return i.img_vectors.select("url", er.gradient_signature(F.transform("embedding", lambda x: x.cast("double"))).alias("signature"))


def blocks(i):
    return er.with_comparisons(er.review_records(records(i)), signatures(i))


def candidates(i):
    return er.build_candidates(records(i), signatures(i), SHOP_ORDER)


def written_candidates(i, found=None):
    """The candidates as the later jobs read them: from a written table."""
    return written(er.build_candidates(records(i) if found is None else found, signatures(i), SHOP_ORDER))


def with_candidates(i):
    """(candidates, records) where both are read: the names are parsed once."""
    found = written(records(i))
    return written_candidates(i, found), found


ER = """
recs AS (SELECT source_key, shop_id, code AS model_code, er_name, latest_price, img, ordinal, p_partkey, vtag, soft, p_size, model_no,
    lower(code) || '@' || array_to_string(list_sort(list_filter([vtag, soft], lambda t: t <> '')), '+') AS identity_key,
    CASE WHEN p_size % 10 = 0 THEN 'serial' WHEN vtag IN ('parallel', 'serial') THEN vtag END AS hard FROM er WHERE canonical_id IS NULL),
tagged AS (SELECT *, coalesce(hard, 'base') AS signature, array_to_string(list_sort(list_distinct(list_filter(
    [hard, soft, CASE WHEN vtag IN ('opened', 'unopened') THEN vtag END], lambda t: t IS NOT NULL))), '+') AS tags FROM recs),
qual AS (SELECT model_code, signature FROM tagged GROUP BY ALL HAVING count(DISTINCT identity_key) >= 2 AND count(DISTINCT source_key) >= 2 AND count(DISTINCT shop_id) >= 2),
top AS (SELECT * FROM (SELECT t.*, row_number() OVER (PARTITION BY model_code, signature ORDER BY latest_price DESC, ordinal) AS pos FROM tagged t JOIN qual USING (model_code, signature)) x WHERE pos <= 8),
sig AS (SELECT url, list_transform(range(1, 64), lambda k: embedding[k] > embedding[k + 1]) AS bits FROM img_vectors),
full_top AS (SELECT t.*, s.bits, list_distinct(regexp_extract_all(regexp_replace(lower(er_name), '[()\\[\\]:\\s_-]+', '', 'g'), '.{1,2}')) AS ch FROM top t LEFT JOIN sig s ON s.url = t.img),
pairs AS (SELECT a.model_code, a.signature, len(list_intersect(a.ch, b.ch)) / len(list_distinct(list_concat(a.ch, b.ch))) AS sim,
    CASE WHEN a.shop_id <> b.shop_id AND a.bits IS NOT NULL AND b.bits IS NOT NULL THEN floor((1 - len(list_filter(list_zip(a.bits, b.bits), lambda z: z[1] <> z[2])) / 64.0) * 100 + 0.5) END AS img_score
  FROM full_top a JOIN full_top b ON a.model_code = b.model_code AND a.signature = b.signature AND a.pos < b.pos),
paired AS (SELECT model_code, signature, min(sim) AS name_score, CAST(min(img_score) AS BIGINT) AS image_min, CAST(max(img_score) AS BIGINT) AS image_max,
    CAST(floor(median(img_score) + 0.5) AS BIGINT) AS image_median, count(img_score) AS image_pairs FROM pairs GROUP BY ALL),
sums AS (SELECT model_code, signature, min(latest_price) FILTER (latest_price > 0) AS lo, max(latest_price) AS hi, count(DISTINCT shop_id) AS shops, count(bits) AS hashed, count(*) AS total,
    count(DISTINCT CASE WHEN vtag IN ('opened', 'unopened') THEN vtag END) > 1 AS conflict FROM full_top GROUP BY ALL),
dup AS (SELECT model_code, signature, string_agg(shop_id || ' x' || n, ', ' ORDER BY shop_id) AS dups FROM (SELECT model_code, signature, shop_id, count(*) AS n FROM full_top GROUP BY ALL HAVING count(*) > 1) x GROUP BY ALL),
facts AS (SELECT s.*, p.* EXCLUDE (model_code, signature), dups, round(hi / lo, 1) AS ratio,
    CAST(floor(least(100.0, 40 + least(shops, 3) * 10 + name_score * 25 + 5 / (hi / lo)) + 0.5) AS BIGINT) AS score FROM sums s JOIN paired p USING (model_code, signature) LEFT JOIN dup USING (model_code, signature)),
risk AS (SELECT *, lo >= 500 AND ratio >= 5 AS wide, dups IS NOT NULL AND ratio >= 3 AS dupwide, lo < 100 AND hi >= 1000 AS tiny, coalesce(image_max >= 90 AND image_min <= 70, false) AS mixed FROM facts),
judged AS (SELECT *, CASE WHEN conflict OR wide OR dupwide THEN 'high' WHEN dups IS NOT NULL OR mixed OR tiny THEN 'medium' ELSE 'low' END AS risk_level,
    concat_ws('; ', CASE WHEN conflict THEN 'opened and unopened mixed' END, 'several items of one shop: ' || dups, CASE WHEN wide OR dupwide THEN 'price ratio ' || ratio END,
      CASE WHEN tiny THEN 'stopped or placeholder price' END, CASE WHEN mixed THEN 'image similarities far apart' END, CASE WHEN image_pairs = 0 THEN 'no images to compare between shops' END) AS warnings FROM risk),
gated AS (SELECT *, 'candidate_' || model_code || '_' || signature AS candidate_id, upper(model_code || '_' || signature) AS canonical_id,
    concat_ws('; ', CASE WHEN conflict THEN 'opened and unopened mixed' END, CASE WHEN risk_level <> 'low' THEN 'risk level ' || risk_level END, CASE WHEN warnings <> '' THEN 'has warnings' END,
      CASE WHEN shops < 3 THEN 'fewer than 3 shops' END, CASE WHEN ratio > 2 THEN 'prices too far apart or not comparable' END,
      CASE WHEN image_pairs = 0 THEN 'no images to compare between shops' WHEN image_min < 80 THEN 'image similarity below 80' END) AS reasons FROM judged)
"""


# The same facts from every record of a block instead of the review list.
WHOLE = ER.replace("WHERE pos <= 8", "")


@query("er1_candidate_records", f"WITH {ER} SELECT source_key, identity_key, shop_id, er_name AS name, model_code, signature, tags, latest_price, img AS image_url FROM tagged")
def candidate_records(i):
    return records(i).select("source_key", "identity_key", "shop_id", "name", "model_code", "signature", F.array_join("tags", "+").alias("tags"), "latest_price", "image_url")


@query("er2_hard_signature", """SELECT p_partkey, CASE WHEN vtag IN ('parallel', 'serial') THEN CASE WHEN p_size > 40 THEN 'parallel+serial' ELSE vtag END
  WHEN p_size > 40 THEN 'parallel+serial' ELSE 'base' END AS signature FROM parts""")
def hard_signature(i):
    tags = F.array_sort(F.array_compact(F.array(F.when(F.col("vtag") != "", F.col("vtag")), "adj", F.when(F.col("p_size") > 40, "parallel"), F.when(F.col("p_size") > 40, "serial"))))
    return i.parts.select("p_partkey", er.hard_signature(F.array_distinct(tags), HARD).alias("signature"))


@query("er3_candidate_blocks", f"WITH {ER} SELECT * FROM qual")
def candidate_blocks(i):
    return er.candidate_blocks(records(i))


@query("er4_top_k_per_block", f"WITH {ER} SELECT model_code, signature, source_key, CAST(pos AS BIGINT) AS position, latest_price FROM top")
def top_k_per_block(i):
    return er.review_records(records(i)).select("model_code", "signature", "source_key", F.col("position").cast("long").alias("position"), "latest_price")


@query("er5_pairwise_name_similarity", f"WITH {ER} SELECT model_code, signature, round(name_score, 6) AS name_score FROM paired")
def pairwise_name_similarity(i):
    return blocks(i).select("model_code", "signature", F.round("name_score", 6).alias("name_score"))


@query("er6_hamming_similarity_stats", f"WITH {ER} SELECT model_code, signature, image_min, image_median, image_max, image_pairs, hashed, total FROM facts")
def hamming_similarity_stats(i):
    b = er.with_image_stats(blocks(i))
    return b.select("model_code", "signature", "image_min", "image_median", "image_max", F.col("image_pairs").cast("long").alias("image_pairs"),
                    F.col("hashed_records").cast("long").alias("hashed"), F.col("total_records").cast("long").alias("total"))


@query("er7_price_spread", f"WITH {ER} SELECT model_code, signature, lo AS min_price, hi AS max_price, ratio AS price_ratio FROM facts")
def price_spread(i):
    return er.with_price_stats(blocks(i)).select("model_code", "signature", "min_price", "max_price", "price_ratio")


@query("er8_candidate_score", f"WITH {ER} SELECT model_code, signature, shops, score FROM facts")
def candidate_score(i):
    return er.with_score(er.with_price_stats(blocks(i))).select("model_code", "signature", F.col("shops").cast("long").alias("shops"), "score")


@query("er9_review_risk", f"WITH {ER} SELECT candidate_id, risk_level, warnings, conflict FROM gated")
def review_risk(i):
    return candidates(i).select("candidate_id", "risk_level", F.array_join("warnings", "; ").alias("warnings"), F.col("condition_conflict").alias("conflict"))


@query("er10_build_candidates", f"""WITH {ER},
names AS (SELECT model_code, signature, er_name FROM (SELECT *, row_number() OVER (PARTITION BY model_code, signature ORDER BY CASE shop_id WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END, length(er_name), pos) AS rn FROM top) x WHERE rn = 1),
keys AS (SELECT model_code, signature, string_agg(source_key, '|' ORDER BY pos) AS keys FROM top GROUP BY ALL)
SELECT candidate_id, canonical_id, er_name AS canonical_name, score, CAST(floor(name_score * 100 + 0.5) AS BIGINT) AS name_score, image_max, hi AS max_price, risk_level, keys
FROM gated JOIN names USING (model_code, signature) JOIN keys USING (model_code, signature)""")
def build_candidates(i):
    return er.order_candidates(candidates(i)).select("candidate_id", "canonical_id", "canonical_name", "score", "name_score", "image_max", "max_price", "risk_level",
                                                     F.array_join("records.source_key", "|").alias("keys"))


@query("er11_safety_gate", f"WITH {ER} SELECT candidate_id, reasons, reasons = '' AS safe FROM gated")
def safety_gate(i):
    return er.safety_gate(candidates(i)).select("candidate_id", F.array_join("reasons", "; ").alias("reasons"), "safe")


@query("er12_deferral_report", f"""WITH {ER},
open AS (SELECT *, CASE WHEN reasons = '' THEN 'safe but outside this review batch' ELSE reasons END AS why FROM gated WHERE candidate_id NOT IN (SELECT candidate_id FROM reviewed))
SELECT 'candidate' AS kind, candidate_id AS subject, why AS detail, 1 AS n FROM open
UNION ALL SELECT 'reason', reason, '', count(*) FROM (SELECT unnest(str_split(why, '; ')) AS reason FROM open) x GROUP BY reason
UNION ALL SELECT 'summary', 'total', '', count(*) FROM gated UNION ALL SELECT 'summary', 'accepted', '', count(*) FROM gated WHERE candidate_id IN (SELECT candidate_id FROM reviewed)
UNION ALL SELECT 'summary', 'deferred', '', count(*) FROM open""")
def deferral_report(i):
    deferred, counts, total = al.deferral_report(written_candidates(i), i.reviewed)
    row = lambda kind, subject, detail, n: [F.lit(kind).alias("kind"), subject.alias("subject"), detail.alias("detail"), n.cast("long").alias("n")]
    return (
        deferred.select(*row("candidate", F.col("candidate_id"), F.array_join("reasons", "; "), F.lit(1)))
        .unionByName(counts.select(*row("reason", F.col("reason"), F.lit(""), F.col("n"))))
        .unionByName(total.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("n")) for c in ("total", "accepted", "deferred")])).alias("x"))
                     .select(*row("summary", F.col("x.c"), F.lit(""), F.col("x.n")))))


def stored_groups(i):
    """Alias groups before the batch: two older batches over part codes, two listings each."""
    g = i.parts.filter("vtag = ''").select(
        F.concat("code", F.when(F.col("p_size") > 25, "_SERIAL").otherwise("_BASE"), F.when(F.col("p_partkey") % 6 == 1, "_B").otherwise("")).alias("canonical_id"),
        F.col("p_name").alias("canonical_name"), F.col("code").alias("model_no"), F.when(F.col("p_size") > 40, "manual").otherwise("now").alias("batch"),
        F.lit(None).cast("string").alias("candidate_id"), F.col("p_partkey").alias("position"))
    m = g.select("canonical_id", F.posexplode(F.array(F.lit("A"), F.lit("N"))).alias("position", "shop_id"), F.concat(F.lit("k"), F.col("position").cast("string"), F.lit("A")).alias("source_key"),
                 F.col("canonical_name").alias("name"), "model_no")
    return g, m


BASE_GROUPS = """
old_groups AS (SELECT code || CASE WHEN p_size > 25 THEN '_SERIAL' ELSE '_BASE' END || CASE WHEN p_partkey % 6 = 1 THEN '_B' ELSE '' END AS canonical_id, p_name AS canonical_name,
   code AS model_no, CASE WHEN p_size > 40 THEN 'manual' ELSE 'now' END AS batch, p_partkey AS position FROM parts WHERE vtag = ''),
old_members AS (SELECT canonical_id, batch, unnest(['A', 'N']) AS shop_id, 'k' || position || 'A' AS source_key FROM old_groups)
"""


@query("er13_alias_groups_from", f"""WITH {ER}, {BASE_GROUPS}
SELECT canonical_id, shop_id, source_key FROM old_members WHERE batch <> 'now'
UNION ALL SELECT g.canonical_id, t.shop_id, t.source_key FROM gated g JOIN reviewed USING (candidate_id) JOIN top t USING (model_code, signature)""")
def alias_groups_from(i):
    return al.alias_groups_from(written_candidates(i), i.reviewed, *stored_groups(i), "now")[1].select("canonical_id", "shop_id", "source_key")


@query("er13_whole_block_groups", f"""WITH {ER}, {BASE_GROUPS}
SELECT canonical_id, shop_id, source_key FROM old_members WHERE batch <> 'now'
UNION ALL SELECT g.canonical_id, t.shop_id, t.source_key FROM gated g JOIN reviewed USING (candidate_id) JOIN tagged t USING (model_code, signature)""")
def whole_block_groups(i):
    made, found = with_candidates(i)
    return al.alias_groups_from(made, i.reviewed, *stored_groups(i), "now", found)[1].select("canonical_id", "shop_id", "source_key")


@query("er7_block_facts", f"""WITH {ER}
SELECT model_code, signature, CAST(sum(n) AS BIGINT) AS block_records, count(*) AS block_shops, min(lo) AS block_min_price, max(hi) AS block_max_price, count(*) FILTER (n > 1) AS block_duplicate_shops
FROM (SELECT model_code, signature, shop_id, count(*) AS n, min(latest_price) FILTER (latest_price > 0) AS lo, max(latest_price) FILTER (latest_price > 0) AS hi FROM tagged JOIN qual USING (model_code, signature) GROUP BY ALL) x
GROUP BY model_code, signature""")
def block_facts(i):
    return er.block_facts(records(i))


@query("er8_whole_block_score", f"""WITH {WHOLE}
SELECT candidate_id, round(name_score, 6) AS name_score, score, shops, total AS total_records, lo AS min_price, hi AS max_price, risk_level, conflict FROM gated""")
def whole_block_score(i):
    """Name score, score and risk of every candidate block from all its records."""
    whole = er.whole_block_candidates(*with_candidates(i), signatures(i))
    return whole.select("candidate_id", F.round("block_name_score", 6).alias("name_score"), "score", F.col("shops").cast("long").alias("shops"), F.col("total_records").cast("long").alias("total_records"),
                        "min_price", "max_price", "risk_level", F.col("condition_conflict").alias("conflict"))


@query("er6_whole_block_images", f"WITH {WHOLE} SELECT candidate_id, image_min, image_max FROM gated WHERE image_pairs > 0")
def whole_block_images(i):
    """Image extremes of every candidate block from all its records."""
    return er.whole_block_candidates(*with_candidates(i), signatures(i)).filter("image_pairs > 0").select("candidate_id", "image_min", "image_max")


@query("er13_gated_groups", f"""WITH {WHOLE}, {BASE_GROUPS}
SELECT canonical_id, shop_id, source_key FROM old_members WHERE batch <> 'now'
UNION ALL SELECT g.canonical_id, t.shop_id, t.source_key FROM gated g JOIN reviewed USING (candidate_id) JOIN tagged t USING (model_code, signature) WHERE g.reasons = ''""")
def gated_groups(i):
    """Groups of the reviewed blocks that the gate, over all their records, finds safe."""
    made, found = with_candidates(i)
    return al.alias_groups_from(made, i.reviewed, *stored_groups(i), "now", found, signatures(i))[1].select("canonical_id", "shop_id", "source_key")


@query("er13_review_violations", f"""WITH {ER}, {BASE_GROUPS}
SELECT 'missing candidate' AS kind, candidate_id AS subject FROM reviewed WHERE candidate_id NOT IN (SELECT candidate_id FROM gated)
UNION ALL SELECT 'unsafe candidate', candidate_id FROM gated JOIN reviewed USING (candidate_id) WHERE reasons <> ''
UNION ALL SELECT 'canonical id in use', canonical_id FROM gated JOIN reviewed USING (candidate_id) WHERE canonical_id IN (SELECT canonical_id FROM old_groups WHERE batch <> 'now')""")
def review_violations(i):
    return al.review_violations(written_candidates(i), i.reviewed, stored_groups(i)[0], "now")


@query("er14_validate_alias_groups", f"""WITH {ER}, {BASE_GROUPS},
groups2 AS (SELECT canonical_id, batch FROM old_groups WHERE batch <> 'now' UNION ALL SELECT canonical_id, 'now' FROM gated JOIN reviewed USING (candidate_id)),
members2 AS (SELECT canonical_id, shop_id, source_key FROM old_members WHERE batch <> 'now' UNION ALL SELECT canonical_id, 'A', source_key FROM gated JOIN reviewed USING (candidate_id) JOIN top USING (model_code, signature))
SELECT 'duplicate canonical id' AS kind, canonical_id AS subject FROM groups2 GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'source key in several groups', shop_id || ' ' || source_key FROM members2 GROUP BY shop_id, source_key HAVING count(DISTINCT canonical_id) > 1
UNION ALL SELECT 'fewer than two stored items', g.canonical_id FROM groups2 g WHERE
  (SELECT count(DISTINCT m.source_key) FROM members2 m JOIN er e ON e.source_key = m.source_key WHERE m.canonical_id = g.canonical_id) < 2""")
def validate_alias_groups(i):
    """The groups after the batch, with every member assigned to shop A, against all stored items."""
    groups, members = al.alias_groups_from(written_candidates(i), i.reviewed, *stored_groups(i), "now")
    kept = members.join(groups.filter("batch = 'now'").select(F.col("canonical_id")), "canonical_id", "left_semi").withColumn("shop_id", F.lit("A"))
    others = members.join(groups.filter("batch = 'now'").select(F.col("canonical_id")), "canonical_id", "left_anti")
    return al.validate_alias_groups(groups, kept.unionByName(others), er_tables(i)[0])


@query("er15_merge_alias_groups", """
WITH existing AS (SELECT code AS canonical_id, CASE WHEN p_size > 20 THEN 'c' || p_partkey END AS candidate_id, p_partkey AS position FROM parts WHERE vtag = 'parallel'),
incoming AS (SELECT CASE WHEN p_size > 45 THEN NULL WHEN p_size > 35 THEN 'new' || p_partkey ELSE code END AS canonical_id,
    CASE WHEN p_size <= 30 THEN 'c' || (p_partkey - 1) END AS candidate_id, p_partkey AS position, p_size % 4 AS n_members FROM parts WHERE vtag = 'serial'),
valid AS (SELECT * FROM incoming WHERE canonical_id IS NOT NULL AND n_members >= 2),
placed AS (SELECT v.*, coalesce(a.position, b.position) AS target FROM valid v LEFT JOIN existing a ON a.candidate_id = v.candidate_id LEFT JOIN existing b ON b.canonical_id = v.canonical_id)
SELECT coalesce(target, position + 1099511627776) AS slot, canonical_id, candidate_id, position, CAST(n_members AS BIGINT) AS n_members FROM placed
UNION ALL SELECT position, canonical_id, candidate_id, position, 2 FROM existing WHERE position NOT IN (SELECT target FROM placed WHERE target IS NOT NULL)""")
def merge_alias_groups(i):
    """Existing groups per code, incoming ones that meet them by candidate id or canonical id or are new."""
    existing = i.parts.filter("vtag = 'parallel'").select(
        F.col("code").alias("canonical_id"), F.when(F.col("p_size") > 20, F.concat(F.lit("c"), F.col("p_partkey").cast("string"))).alias("candidate_id"),
        F.col("p_partkey").alias("position"), F.lit(2).cast("long").alias("n_members"))
    incoming = i.parts.filter("vtag = 'serial'").select(
        F.when(F.col("p_size") > 45, None).when(F.col("p_size") > 35, F.concat(F.lit("new"), F.col("p_partkey").cast("string"))).otherwise(F.col("code")).alias("canonical_id"),
        F.when(F.col("p_size") <= 30, F.concat(F.lit("c"), (F.col("p_partkey") - 1).cast("string"))).alias("candidate_id"),
        F.col("p_partkey").alias("position"), (F.col("p_size") % 4).cast("long").alias("n_members"))
    return al.merge_alias_groups(existing, incoming).select("slot", "canonical_id", "candidate_id", "position", "n_members")


def alias_store(i):
    """One item per listing; the R listings of serial parts are stored under their identity key, and the first
    A listing of a larger code already carries the group's canonical id."""
    e = i.er.withColumn("entity_key", F.when((F.col("vtag") == "serial") & (F.col("shop_id") == "R"), F.concat(
        F.lower("code"), F.lit("@"), F.array_join(F.array_sort(F.array("adj", F.lit("serial"))), "+"))).otherwise(F.col("source_key")))
    held = (F.col("shop_id") == "A") & (F.col("p_partkey") % 6 == 0) & (F.col("p_size") > 30)
    items = e.select("entity_key", F.when(held, F.concat("code", F.lit("_SERIAL"))).alias("canonical_id"), F.lit("unnamed").alias("name"),
                     F.when(F.col("shop_id") == "N", F.col("code")).otherwise(F.col("model_no")).alias("model_no"), F.lit("").alias("image_url"), "ordinal")
    aliases = e.select("entity_key", F.concat(F.lit("was-"), "source_key").alias("alias_key"))
    offers = e.select("entity_key", "shop_id", "latest_price", F.col("er_name").alias("source_name"), F.col("img").alias("image_url"))
    log = i.lots.select(F.col("entity_key").alias("p_partkey"), "shop_id", "date", "price").join(e.select("p_partkey", "shop_id", "entity_key"), ["p_partkey", "shop_id"]).select(
        "entity_key", "shop_id", "date", "price")
    groups = i.parts.filter("vtag = 'serial' AND p_size <= 40").select(
        F.concat("code", F.lit("_SERIAL")).alias("canonical_id"), F.when(F.col("p_size") > 20, F.concat(F.lit("Serial "), "p_name")).alias("canonical_name"), F.col("code").alias("model_no"),
        F.lit("b").alias("batch"), F.lit("c").alias("candidate_id"), F.col("p_partkey").alias("position"))
    members = e.filter("vtag = 'serial'").join(groups.select(F.col("position").alias("p_partkey"), F.col("canonical_id").alias("group_id")), "p_partkey").select(
        F.col("group_id").alias("canonical_id"), F.when(F.col("shop_id") == "A", 0).when(F.col("shop_id") == "N", 1).otherwise(2).alias("position"), "shop_id",
        F.when(F.col("shop_id") == "A", F.col("source_key")).otherwise("gone").alias("source_key"), F.col("er_name").alias("name"), "model_no")
    return merge.Store(items, aliases, offers, written(log)), groups, members


@query("er16_apply_aliases", """
WITH heads AS (SELECT p_partkey, p_name, code, code || '_SERIAL' AS gid, CASE WHEN p_size > 20 THEN 'Serial ' || p_name ELSE 'unnamed' END AS name FROM parts WHERE vtag = 'serial' AND p_size <= 40),
e AS (SELECT er.*, CASE WHEN shop_id = 'A' AND p_partkey % 6 = 0 AND p_size > 30 THEN code || '_SERIAL' END AS holds FROM er),
taken AS (SELECT h.gid, h.name, h.code, e.p_partkey, e.shop_id, e.latest_price, e.last_date, e.source_key, CASE WHEN e.holds = h.gid THEN 0 ELSE 1 END AS place, e.ordinal
          FROM heads h JOIN e ON e.p_partkey = h.p_partkey OR e.holds = h.gid OR (e.shop_id = 'N' AND e.code = h.code AND e.p_name = h.p_name)),
two AS (SELECT gid FROM taken GROUP BY 1 HAVING count(*) >= 2),
final AS (SELECT t.* FROM taken t JOIN two USING (gid)),
offers2 AS (SELECT gid AS entity_key, name, code AS model_no, shop_id, max_by(latest_price, (last_date - DATE '1990-01-01') * 1000000000 + place * 100000000 + ordinal) AS latest_price FROM final GROUP BY ALL
  UNION ALL SELECT CASE WHEN vtag = 'serial' AND shop_id = 'R' THEN lower(code) || '@' || least(adj, 'serial') || '+' || greatest(adj, 'serial') ELSE source_key END, 'unnamed', CASE WHEN shop_id = 'N' THEN code ELSE model_no END, shop_id, latest_price FROM e
    WHERE source_key NOT IN (SELECT source_key FROM final)),
logs AS (SELECT gid AS entity_key, f.shop_id, l.date FROM final f JOIN lots l ON l.entity_key = f.p_partkey AND l.shop_id = f.shop_id GROUP BY ALL),
sizes AS (SELECT entity_key, shop_id, count(*) AS entries FROM logs GROUP BY ALL)
SELECT o.entity_key, o.name, o.model_no, o.shop_id, o.latest_price, max(o.latest_price) OVER (PARTITION BY o.entity_key) AS best_price, s.entries
FROM offers2 o LEFT JOIN sizes s USING (entity_key, shop_id)""")
def apply_aliases(i):
    store, groups, members = alias_store(i)
    out = al.apply_aliases(store, groups, members, i.lot_shops, RULES)
    ids = groups.select(F.col("canonical_id").alias("entity_key"))
    entries = out.history.join(ids, "entity_key", "left_semi").groupBy("entity_key", "shop_id").agg(F.count(F.lit(1)).alias("entries"))
    return out.offers.join(out.items.select("entity_key", "name", "model_no", "best_price"), "entity_key").join(entries, ["entity_key", "shop_id"], "left").select(
        "entity_key", "name", "model_no", "shop_id", "latest_price", "best_price", "entries")


@query("er17_signature_job", """
WITH bits AS (SELECT url, list_concat(list_transform(range(1, 64), lambda k: CASE WHEN embedding[k] > embedding[k + 1] THEN 1 ELSE 0 END), [0]) AS b FROM img_vectors WHERE priority % 5 <> 0)
SELECT url, array_to_string(list_transform(range(16), lambda d: substr('0123456789abcdef', 8 * b[4*d+1] + 4 * b[4*d+2] + 2 * b[4*d+3] + b[4*d+4] + 1, 1)), '') AS signature FROM bits""")
def signature_job(i):
    """Every image not in the cache; the images of every fifth size are cached."""
    vectors = i.img_vectors.select("url", "priority", F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    cache = i.img_vectors.filter("priority % 5 = 0").select("url")
    return er.signature_job(vectors, cache).select("url", "signature")
