"""Cross-shop candidates for the same product: blocking, similarity, score, risk and safety gate.

A candidate is a review list: the k best-priced records of a block and their comparison, at most
k * (k - 1) / 2 pairs, formed inside one row without a join. What concerns the whole block (`block_facts`) and the
members of an accepted alias group (`alias_groups_from` with `records`) come from all its records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions.columns import nonblank, round_half_up
from offerlens.functions.durable import written
from offerlens.functions.skew import spread_join
from offerlens.functions.unicode import nfkc
from offerlens.operators import history as hist
from offerlens.operators.identity import IdentityRules, resolve_each

BLOCK = ["model_code", "signature"]
NAME_SIGNS = r"(?U)[「」『』【】()\[\]（）・:：\s_-]+"


def hard_signature(tags: Column, hard_pattern: str) -> Column:
    """Blocking key part: the tags that may never differ, joined, or 'base'."""
    return F.coalesce(nonblank(F.array_join(F.filter(tags, lambda t: t.rlike(hard_pattern)), "+")), F.lit("base"))


def recovered_hard_tags(aliases: DataFrame, hard_pattern: str) -> DataFrame:
    """(entity_key, code, recovered): hard tags on which all of an item's alias keys with that code agree."""
    key = F.lower("alias_key")
    tags = F.filter(F.split(F.regexp_extract(key, r"^[^@]*@(.*)$", 1), r"\+"), lambda t: t.rlike(hard_pattern))
    tagged = aliases.filter(F.col("alias_key").contains("@")).select(
        "entity_key", F.split_part(key, F.lit("@"), F.lit(1)).alias("code"), F.array_join(F.array_sort(tags), "+").alias("sig"))
    return (
        tagged.filter(F.col("sig") != "").groupBy("entity_key", "code").agg(F.min("sig").alias("low"), F.max("sig").alias("high"))
        .filter(F.col("low") == F.col("high")).select("entity_key", "code", F.split("low", r"\+").alias("recovered"))
    )


def candidate_records(items: DataFrame, aliases: DataFrame, offers: DataFrame, shops: DataFrame, rules: IdentityRules,
                      hard_pattern: str, exclude: DataFrame | None = None) -> DataFrame:
    """One record per available offer of every item that is not canonical yet and whose name has a code."""
    open_items = items.filter(F.coalesce("canonical_id", F.lit("")) == "").select(
        F.col("entity_key"), F.col("name").alias("item_name"), "model_no", F.col("image_url").alias("item_image"), "ordinal")
    offered = hist.without_shops(offers, exclude).join(shops.select("shop_id", "shop_name", F.col("ordinal").alias("shop_ordinal")), "shop_id", "left").select(
        "entity_key", "shop_id", F.coalesce(nonblank("shop_name"), "shop_id").alias("shop_name"), "shop_ordinal", "source_name",
        F.coalesce("latest_price", F.lit(0)).alias("latest_price"), F.col("image_url").alias("offer_image"))
    named = open_items.join(offered, "entity_key").withColumn("name", F.coalesce(nonblank("source_name"), "item_name"))
    parsed = resolve_each(named, rules).filter(F.col("model_code") != "").withColumn("code", F.lower("model_code"))
    found = parsed.join(recovered_hard_tags(aliases, hard_pattern), ["entity_key", "code"], "left")
    soft = F.filter("tags", lambda t: ~t.rlike(hard_pattern))
    tags = F.when(F.col("recovered").isNotNull(), F.array_sort(F.array_union(soft, F.col("recovered")))).otherwise(F.col("tags"))
    return found.withColumn("tags", tags).select(
        F.col("entity_key").alias("source_key"), "identity_key", "shop_id", "shop_name", "name", "model_no", "model_code", "tags",
        hard_signature(F.col("tags"), hard_pattern).alias("signature"), "latest_price",
        F.coalesce(nonblank("offer_image"), "item_image", F.lit("")).alias("image_url"), "ordinal", "shop_ordinal")


def candidate_blocks(records: DataFrame) -> DataFrame:
    """Blocks spanning at least two identities, two items and two shops.

    "At least two" is minimum <> maximum, which combines before the shuffle and keeps no sets.
    """
    names = ("identity_key", "source_key", "shop_id")
    spans = records.groupBy(*BLOCK).agg(*[f(c).alias(f"{n}_{c}") for c in names for n, f in (("lo", F.min), ("hi", F.max))])
    for c in names:
        spans = spans.filter(F.col(f"lo_{c}") != F.col(f"hi_{c}"))
    return spans.select(*BLOCK)


def top_k_per_block(records: DataFrame, k: int = 8) -> DataFrame:
    """The k highest-priced records of each block, numbered; each task keeps k per block before the shuffle."""
    order = Window.partitionBy(*BLOCK).orderBy(F.col("latest_price").desc(), "ordinal", "shop_ordinal")
    return records.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def review_records(records: DataFrame, k: int = 8) -> DataFrame:
    """Records to review: the top k of every qualifying block.

    The records are read twice, so they are written once instead of parsing all names again; the blocks take three columns of them.
    Blocks qualify as a whole, so the k best are kept first: each task keeps k per block, and only these are shuffled, already by block for the join.
    """
    records = written(records)
    return top_k_per_block(records, k).join(candidate_blocks(records), BLOCK, "left_semi")


def block_facts(records: DataFrame) -> DataFrame:
    """Whole-block facts of every qualifying block, from all its records: how many there are, of how many shops, their lowest and
    highest positive price, and the shops with several records. Combined per (block, shop) before the shuffle."""
    price = F.when(F.col("latest_price") > 0, F.col("latest_price"))
    shops = records.groupBy(*BLOCK, "shop_id").agg(F.count(F.lit(1)).alias("n"), F.min(price).alias("low"), F.max(price).alias("high"))
    return shops.join(candidate_blocks(records), BLOCK, "left_semi").groupBy(*BLOCK).agg(
        F.sum("n").alias("block_records"), F.count(F.lit(1)).alias("block_shops"), F.min("low").alias("block_min_price"), F.max("high").alias("block_max_price"),
        F.count_if(F.col("n") > 1).alias("block_duplicate_shops"))


def name_chunks(name: Column) -> Column:
    """Distinct non-overlapping two-character chunks of the name without brackets, spaces and dashes."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.lower(nfkc(name)), NAME_SIGNS, ""), F.lit("(.{1,2})")))


def _pairs(records: Column, k: int, value) -> Column:
    """value(x, y) over all pairs of a record array of at most k elements."""
    return F.flatten(F.transform(records, lambda x, i: F.transform(F.slice(records, i + 2, k), lambda y: value(x, y))))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two distinct arrays, 0 if one is empty."""
    # The transform binds the number of common elements, which is all that needs comparing.
    share = F.transform(F.array(F.size(F.array_intersect(a, b))), lambda n: n / (F.size(a) + F.size(b) - n))[0]
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(share)


def hamming_similarity(a: Column, b: Column) -> Column:
    """Share of equal bits of two hex strings of the same length, else null."""
    words = F.sequence(F.lit(0), F.floor((F.length(a) - 1) / 8).cast("int"))

    def word(hex_text, n):
        return F.conv(F.substring(hex_text, n * 8 + 1, F.lit(8)), 16, 10).cast("long")

    distance = F.aggregate(words, F.lit(0), lambda total, n: total + F.bit_count(word(a, n).bitwiseXOR(word(b, n))))
    return F.when((F.length(a) > 0) & (F.length(a) == F.length(b)), 1 - distance / (F.length(a) * 4))


def with_comparisons(reviewed: DataFrame, signatures: DataFrame, k: int = 8) -> DataFrame:
    """One row per block: its records (at most k, best price first) and the pairwise scores."""
    known = signatures.filter(F.coalesce("signature", F.lit("")) != "").groupBy("url").agg(F.max("signature").alias("dhash"))
    rows = reviewed.withColumn("chunks", name_chunks(F.col("name"))).join(
        known.withColumnRenamed("url", "image_url"), "image_url", "left")
    fields = ["position", "shop_id", "shop_name", "source_key", "identity_key", "name", "model_no", "tags", "latest_price", "image_url", "chunks", "dhash"]
    # At most k records per group: the arrays are bounded.
    blocks = rows.groupBy(*BLOCK).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("records"))
    images = _pairs(F.col("records"), k, lambda x, y: F.when(
        (x["shop_id"] != y["shop_id"]), round_half_up(hamming_similarity(x["dhash"], y["dhash"]) * 100)))
    return blocks.withColumns({
        "name_score": F.coalesce(F.array_min(_pairs(F.col("records"), k, lambda x, y: overlap(x["chunks"], y["chunks"]))), F.lit(1.0)),
        "image_scores": F.array_sort(F.array_compact(images)),
    })


def with_image_stats(blocks: DataFrame) -> DataFrame:
    """Spread of the cross-shop image similarities (percent)."""
    s, n = F.col("image_scores"), F.size("image_scores")
    middle = F.floor(n / 2).cast("int")
    median = F.when(n % 2 == 1, F.try_element_at(s, middle + 1)).otherwise(
        round_half_up((F.try_element_at(s, F.greatest(middle, F.lit(1))) + F.try_element_at(s, middle + 1)) / 2))
    return blocks.withColumns({
        "image_max": F.array_max(s), "image_median": F.when(n > 0, median), "image_min": F.array_min(s), "image_pairs": n,
        "hashed_records": F.size(F.filter("records", lambda r: r["dhash"].isNotNull())), "total_records": F.size("records"),
    })


def with_price_stats(blocks: DataFrame) -> DataFrame:
    """Lowest and highest positive price, their ratio exact and to one place."""
    prices = F.filter(F.transform("records", lambda r: r["latest_price"]), lambda p: p > 0)
    low, high = F.coalesce(F.array_min(prices), F.lit(0)), F.coalesce(F.array_max(prices), F.lit(0))
    return blocks.withColumns({"min_price": low, "max_price": high}).withColumn(
        "exact_ratio", F.when(F.col("min_price") > 0, F.col("max_price") / F.col("min_price"))).withColumn(
        "price_ratio", F.round("exact_ratio", 1))


def with_score(blocks: DataFrame) -> DataFrame:
    """Review priority from shops, the weakest name pair and price closeness; images play no part."""
    shops = F.size(F.array_distinct(F.transform("records", lambda r: r["shop_id"])))
    closeness = F.coalesce(1 / F.col("exact_ratio"), F.lit(0.0))
    raw = 40 + F.least(shops, F.lit(3)) * 10 + F.col("name_score") * 25 + closeness * 5
    return blocks.withColumns({"shops": shops, "score": round_half_up(F.least(F.lit(100.0), raw))})


CONDITION_TAGS = ("opened", "unopened")


def with_risk(blocks: DataFrame, condition_tags: tuple[str, ...] = CONDITION_TAGS, **prices) -> DataFrame:
    """Warnings and risk level of a block; price limits (see `with_risk_level`) are parameters of the market."""
    shop_ids = F.transform("records", lambda r: r["shop_id"])
    counted = F.transform(F.array_sort(F.array_distinct(shop_ids)), lambda s: F.struct(
        s.alias("shop_id"), F.size(F.filter("records", lambda r: r["shop_id"] == s)).alias("n")))
    conditions = F.array_intersect(F.flatten(F.transform("records", lambda r: r["tags"])), F.array(*map(F.lit, condition_tags)))
    return with_risk_level(blocks.withColumns({"duplicate_shops": F.filter(counted, lambda x: x["n"] > 1), "condition_conflict": F.size(conditions) > 1}), **prices)


def with_risk_level(blocks: DataFrame, tiny_price: int = 100, real_price: int = 1000, spread_price: int = 500) -> DataFrame:
    """Warnings and risk level from duplicate shops, condition conflict, prices and image extremes."""
    facts = blocks.withColumns({
        "mixed_images": F.coalesce((F.col("image_max") >= 90) & (F.col("image_min") <= 70), F.lit(False)),
        "tiny_price": (F.col("min_price") > 0) & (F.col("min_price") < tiny_price) & (F.col("max_price") >= real_price),
        "wide_spread": (F.col("min_price") >= spread_price) & F.coalesce(F.col("price_ratio") >= 5, F.lit(False)),
    })
    duplicates = F.size("duplicate_shops") > 0
    duplicate_spread = duplicates & F.coalesce(F.col("price_ratio") >= 3, F.lit(False))
    listed = F.array_join(F.transform("duplicate_shops", lambda x: F.concat_ws(" x", x["shop_id"], x["n"].cast("string"))), ", ")
    warnings = F.array_compact(F.array(
        F.when(F.col("condition_conflict"), "opened and unopened mixed"),
        F.when(duplicates, F.concat(F.lit("several items of one shop: "), listed)),
        F.when(F.col("wide_spread") | duplicate_spread, F.concat(F.lit("price ratio "), F.col("price_ratio").cast("string"))),
        F.when(F.col("tiny_price"), "stopped or placeholder price"),
        F.when(F.col("mixed_images"), "image similarities far apart"),
        F.when(F.col("image_pairs") == 0, "no images to compare between shops"),
    ))
    level = F.when(F.col("condition_conflict") | F.col("wide_spread") | duplicate_spread, "high").when(
        duplicates | F.col("mixed_images") | F.col("tiny_price"), "medium").otherwise("low")
    return facts.withColumns({"warnings": warnings, "risk_level": level}).drop("mixed_images", "tiny_price", "wide_spread")


def build_candidates(records: DataFrame, signatures: DataFrame, shop_order: tuple[str, ...] = (), k: int = 8, **risk) -> DataFrame:
    """Alias candidates: one row per qualifying block with records, statistics, score and risk.

    The representative name is that of the shop first in `shop_order` (shops not named
    come before all), then the shortest.
    """
    blocks = with_risk(with_score(with_price_stats(with_image_stats(with_comparisons(review_records(records, k), signatures, k)))), **risk)
    order = F.array(*map(F.lit, shop_order)) if shop_order else F.array().cast("array<string>")
    by_rank = F.array_min(F.transform("records", lambda r: F.struct(
        F.array_position(order, r["shop_id"]).alias("rank"), F.length(r["name"]).alias("length"), r["position"].alias("position"), r["name"].alias("name"))))
    block_id = F.concat_ws("_", "model_code", "signature")
    kept = ("shop_id", "shop_name", "source_key", "identity_key", "name", "model_no", "tags", "latest_price", "image_url")
    return blocks.select(
        F.regexp_replace(F.concat(F.lit("candidate_"), block_id), "[^a-zA-Z0-9_-]", "_").alias("candidate_id"),
        F.regexp_replace(F.upper(block_id), "[^a-zA-Z0-9_-]", "_").alias("canonical_id"),
        by_rank["name"].alias("canonical_name"), *BLOCK, "score", round_half_up(F.col("name_score") * 100).alias("name_score"), "shops",
        "image_max", "image_median", "image_min", "image_pairs", "hashed_records", "total_records",
        "min_price", "max_price", "price_ratio", "risk_level", "warnings", "duplicate_shops", "condition_conflict",
        F.transform("records", lambda r: F.struct(*[r[c].alias(c) for c in kept])).alias("records"))


def order_candidates(candidates: DataFrame) -> DataFrame:
    """High risk first, then by price and score."""
    risk = F.array_position(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.col("risk_level"))
    return candidates.orderBy(risk, F.col("max_price").desc(), F.col("score").desc(), "candidate_id")


def tile_pairs(values: DataFrame, keys: list[str], value: str, per_tile: int) -> DataFrame:
    """(keys..., same, left_values, right_values): every two distinct values of a group meet in exactly one row, or twice where `same`, whose two arrays are equal.

    A group's values are dealt by hash into tiles of about `per_tile`; each two tiles meet under a key of their own, so the pairs
    of a large group spread over all tasks and no row holds more than two tiles.
    """
    tiles_of = values.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / per_tile).cast("int").alias("_tiles"))
    dealt = spread_join(values, tiles_of, keys).withColumn("_tile", F.pmod(F.xxhash64(value), F.col("_tiles")).cast("int"))
    tiles = written(dealt.groupBy(*keys, "_tiles", "_tile").agg(F.collect_list(value).alias("held")))
    left = tiles.select(*keys, F.col("_tile").alias("_low"), F.explode(F.sequence(F.col("_tile"), F.col("_tiles") - 1)).alias("_high"), F.col("held").alias("left_values"))
    right = tiles.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_tile"))).alias("_low"), F.col("_tile").alias("_high"), F.col("held").alias("right_values"))
    return left.join(right, [*keys, "_low", "_high"]).select(*keys, (F.col("_low") == F.col("_high")).alias("same"), "left_values", "right_values")


def _extremes(measure) -> tuple[Column, Column]:
    """Lowest and highest symmetric measure(x, y) over the two arrays of `tile_pairs`, nulls left out; each pair of a tile with itself once."""
    def others(i: Column) -> Column:
        return F.when(F.col("same"), F.slice("right_values", i + 1, F.size("right_values"))).otherwise(F.col("right_values"))

    each = F.transform("left_values", lambda x, i: F.transform(others(i), lambda y: measure(x, y)))
    return F.array_min(F.transform(each, F.array_min)), F.array_max(F.transform(each, F.array_max))


def block_name_score(records: DataFrame, per_tile: int = 128) -> DataFrame:
    """(block, block_name_score): the least Jaccard similarity of two records' name chunks, 1 for a block of one record.

    Records with the same chunks count once. Every set of a block holds the chunks common to all and lies within their union, so no pair is below
    common / union: where that is 1, or a set is empty, nothing needs comparing; all other blocks go to tiles.
    """
    sets = written(records.select(*BLOCK, F.array_sort(name_chunks(F.col("name"))).alias("chunks")).groupBy(*BLOCK, "chunks").agg(F.count(F.lit(1)).alias("n")))
    sizes = sets.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("records"), F.min(F.size("chunks")).alias("least"))
    decided = sizes.filter("sets = 1 OR least = 0").select(*BLOCK, F.when((F.col("least") == 0) & (F.col("records") > 1), 0.0).otherwise(1.0).alias("block_name_score"))
    open_sets = spread_join(sets, sizes.filter("sets > 1 AND least > 0").select(*BLOCK), BLOCK).select(*BLOCK, "chunks")
    pairs = tile_pairs(open_sets, BLOCK, "chunks", per_tile)
    low, _ = _extremes(overlap)
    return decided.unionByName(pairs.withColumn("low", low).groupBy(*BLOCK).agg(F.min("low").alias("block_name_score")))


def block_images(records: DataFrame, signatures: DataFrame, at_least: int | None = None, per_tile: int = 512) -> DataFrame:
    """(block, image_max, image_min, image_pairs, hashed_records): extremes of the cross-shop image similarities (percent) of whole blocks.

    Records with the same signature count once, and twice if of several shops; image_pairs is counted, not enumerated. The signatures' common bits (`bit_and`,
    `bit_or`) bound every distance. With `at_least` a block whose images are all that similar by this bound is not compared: its image_min
    is the bound, its image_max 100 or, if no image is shared by shops, the bound too. All other blocks are compared exactly, in tiles.
    """
    known = signatures.filter(F.coalesce("signature", F.lit("")) != "").groupBy("url").agg(F.max("signature").alias("dhash"))
    held = records.filter("shop_id IS NOT NULL").join(known.withColumnRenamed("url", "image_url"), "image_url")
    hashes = written(held.groupBy(*BLOCK, "dhash").agg(F.min("shop_id").alias("lo"), F.max("shop_id").alias("hi"), F.count(F.lit(1)).alias("n")).withColumn("digits", F.length("dhash")))
    kind = [*BLOCK, "digits"]
    several = F.col("lo") != F.col("hi")
    # Pairs of the same length, less those within one shop.
    own = hashes.filter(~several).groupBy(*kind, "lo").agg(F.count(F.lit(1)).alias("k")).groupBy(*kind).agg(F.sum(F.col("k") * (F.col("k") + 1) / 2).alias("within"))
    facts = hashes.groupBy(*kind).agg(F.count(F.lit(1)).alias("k"), F.max(several).alias("shared"), F.sum("n").alias("hashed")).join(own, kind, "left").withColumn(
        "pairs", (F.col("k") * (F.col("k") + 1) / 2 - F.coalesce("within", F.lit(0))).cast("long"))
    words = hashes.select(*kind, F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.col("digits") - 1) / 8).cast("int")), lambda n: F.conv(F.substring(F.col("dhash"), n * 8 + 1, F.lit(8)), 16, 10).cast("long"))).alias("place", "word"))
    spans = words.groupBy(*kind, "place").agg(F.bit_and("word").alias("every"), F.bit_or("word").alias("any")).groupBy(*kind).agg(F.sum(F.bit_count(F.col("every").bitwiseXOR(F.col("any")))).alias("differ"))
    judged = written(facts.join(spans, kind).withColumn("bound", round_half_up((1 - F.col("differ") / (F.col("digits") * 4)) * 100)))
    sure = F.col("pairs") == 0
    if at_least is not None:
        sure = sure | (F.col("bound") >= at_least)
    bounded = judged.filter(sure).select(*kind, F.when(F.col("pairs") > 0, F.when(F.col("shared"), 100).otherwise(F.col("bound"))).alias("high"), F.when(F.col("pairs") > 0, F.col("bound")).alias("low"))
    open_hashes = spread_join(hashes, judged.filter(~sure).select(*kind), kind).select(*kind, F.struct("dhash", "lo", "hi").alias("image"))
    # Unless all records of both are of one shop; a signature meets itself if several shops have it.
    pairs = tile_pairs(open_hashes, kind, "image", per_tile)
    low, high = _extremes(lambda x, y: F.when(
        ~((x["lo"] == y["hi"]) & (x["hi"] == y["lo"])), round_half_up(hamming_similarity(x["dhash"], y["dhash"]) * 100)))
    compared = pairs.withColumns({"low": low, "high": high}).groupBy(*kind).agg(F.max("high").alias("high"), F.min("low").alias("low"))
    extremes = bounded.select(*kind, F.col("high").cast("long"), F.col("low").cast("long")).unionByName(compared)
    return judged.join(extremes, kind, "left").groupBy(*BLOCK).agg(
        F.max("high").alias("image_max"), F.min("low").alias("image_min"), F.sum("pairs").alias("image_pairs"), F.sum("hashed").alias("hashed_records"))


def whole_block_candidates(candidates: DataFrame, records: DataFrame, signatures: DataFrame, condition_tags: tuple[str, ...] = CONDITION_TAGS, at_least: int | None = None, **prices) -> DataFrame:
    """The candidates with every fact from all records of their blocks instead of those of the review list: shops, prices, duplicates,
    conditions, images, name score, score, warnings and risk level. `block_shops` holds the number of shops with an id, `block_name_score` the exact
    name score. The median of the image similarities, a fact of the list alone, is left out. `at_least`: see `block_images`.
    """
    held = written(records.select(*BLOCK, "shop_id", "name", "latest_price", "tags", "image_url").join(candidates.select(*BLOCK).distinct(), BLOCK, "left_semi"))
    price = F.when(F.col("latest_price") > 0, F.col("latest_price"))
    conditions = {f"_tag{k}": F.max(F.coalesce(F.array_contains("tags", tag), F.lit(False))) for k, tag in enumerate(condition_tags)}
    shops = held.groupBy(*BLOCK, "shop_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(price).alias("low"), F.max(price).alias("high"), *[c.alias(n) for n, c in conditions.items()])
    # At most one entry per shop.
    duplicates = F.array_sort(F.collect_list(F.when((F.col("n") > 1) & F.col("shop_id").isNotNull(), F.struct("shop_id", F.col("n").cast("int").alias("n")))))
    facts = shops.groupBy(*BLOCK).agg(
        F.count_if(F.coalesce("shop_id", F.lit("")) != "").alias("block_shops"), F.count(F.lit(1)).cast("int").alias("shops"), F.sum("n").cast("int").alias("total_records"),
        F.coalesce(F.min("low"), F.lit(0)).alias("min_price"), F.coalesce(F.max("high"), F.lit(0)).alias("max_price"), duplicates.alias("duplicate_shops"), *[F.max(n).cast("int").alias(n) for n in conditions])
    found = sum((F.col(n) for n in conditions), F.lit(0))
    facts = facts.withColumn("condition_conflict", found > 1).drop(*conditions)
    images = block_images(held, signatures, at_least).withColumn("image_pairs", F.col("image_pairs").cast("int"))
    own = ["min_price", "max_price", "price_ratio", "duplicate_shops", "condition_conflict", "image_max", "image_min", "image_median", "image_pairs", "hashed_records", "total_records",
           "risk_level", "warnings", "block_shops", "shops", "name_score", "block_name_score", "score"]
    joined = candidates.drop(*own).join(facts, BLOCK).join(images, BLOCK, "left").join(block_name_score(held), BLOCK).withColumns({
        "image_pairs": F.coalesce("image_pairs", F.lit(0)), "hashed_records": F.coalesce("hashed_records", F.lit(0)).cast("int"),
        "price_ratio": F.round(F.when(F.col("min_price") > 0, F.col("max_price") / F.col("min_price")), 1)})
    closeness = F.coalesce(F.when(F.col("min_price") > 0, F.col("min_price") / F.col("max_price")), F.lit(0.0))
    raw = 40 + F.least("shops", F.lit(3)) * 10 + F.col("block_name_score") * 25 + closeness * 5
    return with_risk_level(joined.withColumns({"name_score": round_half_up(F.col("block_name_score") * 100), "score": round_half_up(F.least(F.lit(100.0), raw))}), **prices)


GATE_LIMITS = {"min_shops": 3, "max_ratio": 2.0, "min_image": 80}


def safety_gate(candidates: DataFrame, min_shops: int = 3, max_ratio: float = 2.0, min_image: int = 80) -> DataFrame:
    """Candidates with `reasons` against automatic acceptance and `safe`, by the review list, or by the whole block for `whole_block_candidates`."""
    shops = F.size(F.array_distinct(F.filter(F.transform("records", lambda r: r["shop_id"]), lambda s: F.coalesce(s, F.lit("")) != "")))
    if "block_shops" in candidates.columns:
        shops = F.col("block_shops").cast("int")
    no_pairs = F.coalesce("image_pairs", F.lit(0)) == 0
    reasons = F.array_compact(F.array(
        F.when(F.col("condition_conflict"), "opened and unopened mixed"),
        F.when(~F.coalesce(F.col("risk_level") == "low", F.lit(False)), F.concat(F.lit("risk level "), F.coalesce("risk_level", F.lit("unknown")))),
        F.when(F.size("warnings") > 0, "has warnings"),
        F.when(shops < min_shops, f"fewer than {min_shops} shops"),
        F.when(~F.coalesce(F.col("price_ratio") <= max_ratio, F.lit(False)), "prices too far apart or not comparable"),
        F.when(no_pairs, "no images to compare between shops").when(
            ~F.coalesce(F.col("image_min") >= min_image, F.lit(False)), f"image similarity below {min_image}"),
    ))
    return candidates.withColumn("distinct_shops", shops).withColumn("reasons", reasons).withColumn("safe", F.size("reasons") == 0)


def gradient_signature(values: Column, row_width: int | None = None) -> Column:
    """Hex text of the bits 'greater than its right neighbour' per row of a value grid, padded with zeros to whole digits.

    Without `row_width` the values are one row.
    """
    width = F.lit(row_width) if row_width else F.size(values)
    signs = F.zip_with(values, F.slice(values, 2, F.size(values)), lambda a, b: F.when(a > b, "1").otherwise("0"))
    bits = F.array_join(F.filter(signs, lambda _, i: (i + 1) % width != 0), "")
    padded = F.concat(bits, F.lit("000"))
    digits = F.transform(F.regexp_extract_all(padded, F.lit("(.{4})")), lambda d: F.lower(F.conv(d, 2, 16)))
    return F.when(F.size(values) >= 2, F.array_join(digits, ""))


def signature_job(vectors: DataFrame, cache: DataFrame, limit: int = 0, row_width: int | None = None) -> DataFrame:
    """New cache rows (url, signature, error) for urls not cached yet, highest priority first.

    vectors(url, priority, values); `limit` 0 means all. Rows without usable values are cached as errors.
    """
    wanted = vectors.join(cache.select("url"), "url", "left_anti").groupBy("url").agg(
        F.max("priority").alias("priority"), F.max_by("values", "priority").alias("values"))
    if limit > 0:
        wanted = wanted.orderBy(F.col("priority").desc(), "url").limit(limit)
    signature = gradient_signature(F.col("values"), row_width)
    return wanted.select("url", signature.alias("signature"), F.when(signature.isNull(), "no usable values").alias("error"))


def signature_urls(candidates: DataFrame, offers: DataFrame | None = None) -> DataFrame:
    """(url, priority) of the images to sign: those of candidates by price, optionally all offers' after them."""
    rows = candidates.select("max_price", F.explode("records.image_url").alias("url")).select(
        F.trim("url").alias("url"), F.col("max_price").cast("long").alias("priority"))
    if offers is not None:
        rows = rows.unionByName(offers.select(F.trim("image_url").alias("url"), F.lit(-1).cast("long").alias("priority")))
    return rows.filter(F.col("url").startswith("http")).groupBy("url").agg(F.max("priority").alias("priority"))
