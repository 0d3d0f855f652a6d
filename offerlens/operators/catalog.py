"""Variant catalog and the table of priced items it is matched to.

Matching never pairs all variants with all priced items of a number: priced items are first
reduced per (number, hash), (number, image), (number, tag set) and number to their lowest and highest
entry, which tells none, exactly one or several apart.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.columns import first_code, image_identity, nonblank, tag_signature, variant_type_of
from offerlens.functions.components import connected_components
from offerlens.functions.durable import written
from offerlens.functions.ordered import with_sum_before
from offerlens.functions.unicode import nfkc
from offerlens.operators.identity import IdentityRules, parse_spellings

# Default labels and the first index of the second variant family.
NORMAL_LABEL, OTHER_LABEL = "通常", "別イラスト"
PROVISIONAL_LABEL, PROVISIONAL_PREFIX = "仮DB画像", "仮DB: "
RARITY_FROM = 1000


class IncompleteCatalog(ValueError):
    """The catalog source holds too few cards."""


def variant_id_of(number: Column, index: Column) -> Column:
    return (F.when(index >= RARITY_FROM, F.concat(number, F.lit("_r"), (index - RARITY_FROM).cast("string")))
            .when(index > 0, F.concat(number, F.lit("_p"), index.cast("string"))).otherwise(number))


def variant_key_of(number: Column, variant_id: Column) -> Column:
    return F.concat_ws("::", number, variant_id)


def _finish_variants(rows: DataFrame, hashes: DataFrame, rules: IdentityRules, provisional: bool) -> DataFrame:
    """Catalog columns from rows(row_id, card_number, index, label, hint_info, get_info, source, source_url, path, fallback_path, card_name, dhash)."""
    links = rows.filter(F.coalesce("dhash", F.lit("")) == "").select("row_id", F.posexplode(F.array("source_url", "path", "fallback_path")).alias("prio", "url"))
    found = links.filter(F.coalesce("url", F.lit("")) != "").join(hashes.filter(F.coalesce("signature", F.lit("")) != ""), "url").groupBy("row_id").agg(
        F.min_by("signature", "prio").alias("looked_up"))
    hints = F.concat(*[F.when(nonblank(c).isNotNull(), F.concat(F.lit("【"), F.col(c), F.lit("】"))).otherwise("") for c in ("label", "hint_info")])
    hinted = rows.withColumn("hinted", F.concat(F.coalesce("card_name", F.lit("")), hints))
    names = hinted.filter(F.col("index") != 0).select(F.col("hinted").alias("name"), F.col("card_number").alias("model_no"))
    tags = parse_spellings(names, rules).select(F.col("name").alias("hinted"), F.col("model_no").alias("card_number"), F.col("tags").alias("parsed"))
    variant_id = variant_id_of(F.col("card_number"), F.col("index"))
    none = F.array().cast("array<string>")
    return hinted.join(found, "row_id", "left").join(tags, ["hinted", "card_number"], "left").select(
        variant_key_of(F.col("card_number"), variant_id).alias("variant_key"), "card_number", F.coalesce("card_name", F.lit("")).alias("card_name"),
        variant_id.alias("variant_id"), variant_type_of(F.lit(""), variant_id).alias("variant_type"), F.col("index").alias("variant_index"),
        F.coalesce(nonblank("label"), F.when(F.col("index") == 0, NORMAL_LABEL).otherwise(OTHER_LABEL)).alias("label"),
        F.coalesce("get_info", F.lit("")).alias("get_info"), F.coalesce(nonblank("source"), F.lit("provisional" if provisional else "official")).alias("source"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("source_url", "path", "fallback_path")],
        F.coalesce(nonblank("dhash"), "looked_up").alias("image_hash"),
        F.when(F.col("index") == 0, none).otherwise(F.coalesce("parsed", none)).alias("identity_tags"), F.lit(provisional).alias("provisional"))


def official_variants(cards: DataFrame, manifest: DataFrame, hashes: DataFrame, rules: IdentityRules, min_cards: int = 100) -> DataFrame:
    """Catalog rows of manifest(number, position, variant_index, label, get_info, source, source_url, path, fallback_path, card_name, dhash).

    cards(card_number, card_name, get_info, ordinal). The index is the given whole number, else the position in the list.
    """
    if cards.limit(min_cards).count() < min_cards:
        raise IncompleteCatalog(f"fewer than {min_cards} cards")
    def number(c):
        return first_code(nfkc(F.coalesce(c, F.lit(""))), rules.code_pattern)

    known = cards.select(number(F.col("card_number")).alias("n"), "card_name", "get_info", "ordinal").groupBy("n").agg(
        F.max_by(F.struct("card_name", "get_info"), "ordinal").alias("card")).select(F.col("n").alias("card_number_"), "card")
    numbered = manifest.withColumn("card_number_", number(F.col("number"))).filter(F.col("card_number_").isNotNull()).join(known, "card_number_", "left")
    given = F.col("variant_index").try_cast("int")
    rows = numbered.select(
        F.concat_ws("|", "number", F.col("position").cast("string")).alias("row_id"), F.col("card_number_").alias("card_number"),
        F.when(given >= 0, given).otherwise(F.col("position").cast("int")).alias("index"), "label", F.col("get_info").alias("hint_info"),
        F.coalesce(nonblank("get_info"), "card.get_info").alias("get_info"),
        "source", "source_url", "path", F.col("fallback_path"), F.coalesce(nonblank("card_name"), "card.card_name").alias("card_name"), "dhash")
    return _finish_variants(rows, hashes, rules, False)


def image_identities(df: DataFrame, keep: list[str], columns: tuple[str, ...] = ("source_url", "path", "fallback_path")) -> DataFrame:
    """(keep..., identity), one row per distinct image identity of a row."""
    found = F.array_distinct(F.array_compact(F.array(*[image_identity(F.col(c)) for c in columns])))
    return df.select(*keep, F.explode(found).alias("identity"))


def accept_first_images(rows: DataFrame, rounds: int = 3) -> DataFrame:
    """(card_number, seq) of rows accepted when going through rows(card_number, seq, identity) by seq and skipping
    each row that shares an image with an accepted one.

    A round accepts the rows that come first for all their images and drops those sharing an image with
    them, which gives the same rows as going one by one. Overlaps that hang together in chains longer than `rounds` are then cut into connected
    components, found in rounds that grow with the logarithm of a chain, and each component is gone through in order.
    """
    row = ["card_number", "seq"]
    rest = written(rows.select(*row, "identity").distinct())
    parts = []
    for _ in range(rounds):
        if rest.isEmpty():
            break
        first = rest.groupBy("card_number", "identity").agg(F.min("seq").alias("first"))
        ranked = rest.join(first, ["card_number", "identity"])
        won = written(ranked.groupBy(*row).agg(F.bool_and(F.col("seq") == F.col("first")).alias("won")).filter("won").select(*row))
        taken = rest.join(won, row, "left_semi").select("card_number", "identity").distinct()
        out = rest.join(taken, ["card_number", "identity"], "left_semi").select(*row).distinct()
        rest = written(rest.join(out, row, "left_anti"))
        parts.append(won)
    if not rest.isEmpty():
        parts.append(_accept_in_components(rest))
    accepted = rest.select(*row).limit(0)
    for part in parts:
        accepted = accepted.unionByName(part)
    return accepted


def _accept_in_components(rows: DataFrame) -> DataFrame:
    """The same by going through the rows of each connected component in order; a task holds the taken images of one component."""
    # A row of a number is linked to the first row that has the image: a star per image, whatever its size.
    first = rows.groupBy("card_number", "identity").agg(F.min("seq").alias("first"))
    named = rows.join(first, ["card_number", "identity"])
    node = lambda c: F.struct("card_number", F.col(c).cast("long").alias("seq"))
    components = connected_components(named.select(node("seq").alias("a"), node("first").alias("b")))
    placed = rows.join(components.select("node.card_number", F.col("node.seq").cast(rows.schema["seq"].dataType).alias("seq"), F.col("component.seq").alias("component")), ["card_number", "seq"])
    ordered = placed.groupBy("card_number", "component", "seq").agg(F.collect_set("identity").alias("identities"))
    ordered = ordered.repartition("card_number", "component").sortWithinPartitions("card_number", "component", "seq")

    def go_through(batches):
        current, taken = None, set()
        for batch in batches:
            keep = []
            for number, component, images in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if (number, component) != current:
                    current, taken = (number, component), set()
                free = taken.isdisjoint(images)
                if free:
                    taken.update(images)
                keep.append(free)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["card_number", "seq"]).filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(go_through, rows.select("card_number", "seq").schema)


def provisional_variants(official: DataFrame, provisional: DataFrame, hashes: DataFrame, rules: IdentityRules) -> DataFrame:
    """Catalog rows for provisional(card_number, seq, card_name, image_path, image_url, series_title, get_info), seq unique whole numbers.

    Images already official or taken by an earlier row of the number are skipped. A number without official
    variants starts at index 0, all others take the free positive indexes in order.
    """
    path = F.coalesce(nonblank("image_path"), nonblank("image_url"))
    rows = provisional.withColumn("card_number", first_code(nfkc(F.coalesce("card_number", F.lit(""))), rules.code_pattern)).filter(
        F.col("card_number").isNotNull() & path.isNotNull()).withColumns({
            "source_url": F.coalesce("image_url", F.lit("")), "path": path, "fallback_path": path})
    images = written(image_identities(rows, ["card_number", "seq"]))
    official_images = image_identities(official, ["card_number"]).distinct()
    known = images.join(official_images, ["card_number", "identity"], "left_semi").select("card_number", "seq").distinct()
    open_images = images.join(known, ["card_number", "seq"], "left_anti")
    bare = rows.select("card_number", "seq").join(images.select("card_number", "seq").distinct(), ["card_number", "seq"], "left_anti")
    # The places are counted in steps that read their rows twice each, so these are written.
    accepted = written(accept_first_images(open_images).unionByName(bare))

    used = written(official.groupBy("card_number", "variant_index").agg(F.lit(1).alias("one")))
    numbers = used.select("card_number").distinct().withColumn("official", F.lit(True))
    placed = with_sum_before(accepted.withColumn("one", F.lit(1)), ["card_number"], "seq", "one", "before").join(numbers, "card_number", "left")
    # Number of the free positive index wanted; 0 is the primary row of a number without official ones.
    placed = placed.withColumn("nth", F.col("before") + F.when(F.col("official"), 1).otherwise(0))
    positive = with_sum_before(used.filter("variant_index > 0"), ["card_number"], "variant_index", "one", "smaller")
    # A used index u with s smaller used ones lies before the n-th free index iff u - s - 1 < n.
    events = positive.select("card_number", ((F.col("variant_index") - F.col("smaller") - 1) * 2 + 1).cast("long").alias("at"), F.lit(1).alias("is_used"), F.lit(None).cast("long").alias("seq")).unionByName(
        placed.select("card_number", (F.col("nth") * 2).cast("long").alias("at"), F.lit(0).alias("is_used"), F.col("seq").cast("long").alias("seq")))
    free = with_sum_before(written(events), ["card_number"], "at", "is_used", "skipped").filter(F.col("seq").isNotNull()).select(
        "card_number", "seq", (F.col("at") / 2 + F.col("skipped")).cast("int").alias("index"))
    made = rows.join(free, ["card_number", "seq"]).select(
        F.concat_ws("|", "card_number", F.col("seq").cast("string")).alias("row_id"), "card_number", "index",
        F.coalesce(F.concat(F.lit(PROVISIONAL_PREFIX), nonblank("series_title")), F.lit(PROVISIONAL_LABEL)).alias("label"), "get_info", F.col("get_info").alias("hint_info"),
        F.lit("provisional").alias("source"), "source_url", "path", "fallback_path", "card_name", F.lit("").alias("dhash"))
    return _finish_variants(made, hashes, rules, True)


def catalog_summary(cards: DataFrame, manifest: DataFrame, provisional: DataFrame, generated_at=None, synced_at=None) -> DataFrame:
    """One row about a snapshot's sources: how many cards, numbers in the manifest and provisional rows there were, when the manifest was
    made (null if unknown) and when the snapshot was taken (now, unless given)."""
    count = lambda df, c: df.agg(c.alias("n")).scalar()
    moment = lambda x: x.cast("timestamp") if isinstance(x, Column) else F.lit(x).cast("timestamp")
    return cards.agg(F.count(F.lit(1)).alias("cards")).withColumns({
        "manifest_cards": count(manifest, F.count_distinct("number")), "provisional_cards": count(provisional, F.count(F.lit(1))),
        "generated_at": moment(generated_at), "synced_at": F.current_timestamp() if synced_at is None else moment(synced_at)})


def catalog_snapshot(official: DataFrame, provisional: DataFrame) -> DataFrame:
    """All variants ordered by number (digits as numbers), then index. Ordering reads its rows twice, so they are written."""
    number = F.col("card_number")
    return written(official.unionByName(provisional)).orderBy(
        F.regexp_extract(number, r"^(\D*)", 1), F.regexp_extract(number, r"^\D*(\d+)", 1).try_cast("int"),
        F.regexp_extract(number, r"(\d+)$", 1).try_cast("int"), "variant_index", "variant_key")


def price_index(items: DataFrame, offers: DataFrame, hashes: DataFrame, rules: IdentityRules) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, images, image hashes) of the priced items.

    entries(entry_id, price_key, card_number, tags, tag_sig, name, model_no); images(entry_id, identity);
    hashes(entry_id, hash). entry_id is the item's ordinal.
    """
    named = items.withColumns({"name": F.coalesce("name", F.lit("")), "model_no": F.coalesce("model_no", F.lit(""))})
    parsed = parse_spellings(named, rules).filter(F.col("model_code") != "")
    key = F.coalesce(nonblank("canonical_id"), nonblank("entity_key"), F.concat_ws("_", "name", "model_no"))
    keyed = named.join(parsed, ["name", "model_no"]).select(
        F.col("ordinal").alias("entry_id"), "entity_key", key.alias("price_key"), F.col("model_code").alias("card_number"), "tags",
        tag_signature(F.col("tags")).alias("tag_sig"), "name", "model_no", "image_url")
    urls = keyed.select("entry_id", "image_url").unionByName(offers.select("entity_key", "image_url").join(
        keyed.select("entity_key", "entry_id"), "entity_key").select("entry_id", "image_url")).filter(F.coalesce("image_url", F.lit("")) != "").distinct()
    images = urls.select("entry_id", image_identity(F.col("image_url")).alias("identity")).filter(F.col("identity").isNotNull()).distinct()
    signed = hashes.filter(F.coalesce("signature", F.lit("")) != "").select(F.col("url").alias("image_url"), F.col("signature").alias("hash"))
    return keyed.drop("image_url", "entity_key"), images, urls.join(signed, "image_url").select("entry_id", "hash").distinct()


def _extent(df: DataFrame, *keys: str) -> DataFrame:
    """Lowest and highest entry per key: equal if there is exactly one."""
    return df.groupBy(*keys).agg(F.min(F.struct("entry_id", "price_key")).alias("lo"), F.max("entry_id").alias("hi"))


def eligible(variant_type: Column, tag_sig: Column, expected: Column, restricted: tuple[str, ...]) -> Column:
    """Whether an entry with these tags may be matched automatically to a variant."""
    tags = F.filter(F.split(tag_sig, r"\+"), lambda t: t != "")
    barred = F.size(F.array_except(F.array_intersect(tags, F.array(*map(F.lit, restricted)).cast("array<string>")), expected)) > 0
    return ~barred & F.when(variant_type == "normal", F.size(tags) == 0).otherwise(F.size(tags) > 0)


def eligible_extent(wanted: DataFrame, entries: DataFrame, links: DataFrame, link: str, row_key: list[str], restricted: tuple[str, ...], name: str) -> DataFrame:
    """(row_key, name_lo, name_hi): the eligible entries of the row's number that share `link` (a hash or image).

    wanted(row_key, card_number, link, variant_type, expected). Entries are reduced per (number, link, tag set) first.
    """
    reduced = _extent(entries.join(links, "entry_id"), "card_number", link, "tag_sig")
    met = wanted.join(reduced, ["card_number", link]).filter(eligible(F.col("variant_type"), F.col("tag_sig"), F.col("expected"), restricted))
    return met.groupBy(*row_key).agg(F.min("lo").alias(f"{name}_lo"), F.max("hi").alias(f"{name}_hi"))


def with_tag_and_number_extents(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds tags_lo/tags_hi (entries of the number with exactly the expected tags), number_lo/number_hi and number_sig."""
    by_tags = _extent(entries, "card_number", "tag_sig").select("card_number", F.col("tag_sig").alias("expected_sig"), F.col("lo").alias("tags_lo"), F.col("hi").alias("tags_hi"))
    by_number = entries.groupBy("card_number").agg(F.min(F.struct("entry_id", "price_key")).alias("number_lo"), F.max("entry_id").alias("number_hi"), F.min_by("tag_sig", "entry_id").alias("number_sig"))
    return rows.withColumn("expected_sig", tag_signature(F.col("expected"))).join(by_tags, ["card_number", "expected_sig"], "left").join(by_number, "card_number", "left")


def exactly_one(name: str) -> Column:
    return F.coalesce(F.col(f"{name}_lo.entry_id") == F.col(f"{name}_hi"), F.lit(False))


def several(name: str) -> Column:
    return F.coalesce(F.col(f"{name}_lo.entry_id") < F.col(f"{name}_hi"), F.lit(False))


def variant_mappings(catalog: DataFrame, index: tuple[DataFrame, DataFrame, DataFrame], restricted: tuple[str, ...] = ()) -> DataFrame:
    """Variants with a price key found by the first step that has exactly one candidate; several fall through."""
    entries, images, hashes = index
    rows = catalog.select("variant_key", "card_number", "variant_id", variant_type_of(F.col("variant_type"), F.col("variant_id")).alias("variant_type"),
                          F.col("identity_tags").alias("expected"), "image_hash", "provisional", "source_url", "path", "fallback_path")
    key = ["variant_key"]
    by_hash = eligible_extent(rows.filter("image_hash <> ''").withColumnRenamed("image_hash", "hash"), entries, hashes, "hash", key, restricted, "hash")
    by_image = eligible_extent(image_identities(rows, ["variant_key", "card_number", "variant_type", "expected"]), entries, images, "identity", key, restricted, "image")
    untagged = _extent(entries.filter("tag_sig = ''"), "card_number").select("card_number", F.col("lo").alias("plain_lo"), F.col("hi").alias("plain_hi"))
    wide = with_tag_and_number_extents(rows, entries).join(by_hash, key, "left").join(by_image, key, "left").join(untagged, "card_number", "left")
    sure, normal = ~F.col("provisional"), F.col("variant_type") == "normal"
    steps = [
        ("image-hash", "image-hash", "hash", exactly_one("hash")),
        ("image-path", "image-path", "image", exactly_one("image")),
        ("normal-variant-tags", "variant-tags", "plain", sure & normal & exactly_one("plain")),
        ("variant-tags", "variant-tags", "tags", sure & (F.size("expected") > 0) & exactly_one("tags")),
        ("unique-card-number", "unique-card-number", "number", sure & normal & exactly_one("number") & eligible(F.col("variant_type"), F.col("number_sig"), F.col("expected"), restricted)),
    ]

    def first(value):
        return F.coalesce(*[F.when(test, value(method, confirmed, name)) for method, confirmed, name, test in steps])

    return wide.select(
        "variant_key", first(lambda m, c, n: F.col(f"{n}_lo.price_key")).alias("price_key"), first(lambda m, c, n: F.lit(m)).alias("method"),
        first(lambda m, c, n: F.lit(c)).alias("confirmed_by"), "card_number", "variant_id").filter(F.col("price_key").isNotNull())
