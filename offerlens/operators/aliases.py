"""Alias groups: reviewed candidates become groups, groups merge items.

Tables: groups(canonical_id, canonical_name, model_no, batch, candidate_id, position) and
members(canonical_id, position, shop_id, source_key, name, model_no) where position orders a group's members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.functions.columns import last_code, nonblank
from offerlens.functions.durable import checkpointed, written
from offerlens.functions.ordered import with_max_before, with_place
from offerlens.functions.skew import spread_join
from offerlens.functions.unicode import nfkc
from offerlens.operators import merge
from offerlens.operators.identity import IdentityRules, parse_spellings
from offerlens.operators.resolution import GATE_LIMITS, safety_gate, whole_block_candidates


# Order numbers of incoming rows start above those of all existing ones.
INCOMING_FROM = 1 << 40


class AliasConflict(ValueError):
    """Reviewed candidates or alias groups contradict the stored data."""


def deferral_report(candidates: DataFrame, reviewed: DataFrame, **limits) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(deferred candidates with reasons, counts per reason, one-row summary with the limits used) for what was not reviewed."""
    gated = safety_gate(candidates, **limits)
    open_rows = gated.join(reviewed.select("candidate_id"), "candidate_id", "left_anti")
    reasons = F.when(F.size("reasons") == 0, F.array(F.lit("safe but outside this review batch"))).otherwise(F.col("reasons"))
    deferred = open_rows.withColumn("reasons", reasons).select(
        "candidate_id", "model_code", "signature", "risk_level", F.col("distinct_shops").alias("shops"), "image_min", "image_pairs", "price_ratio", "reasons")
    counts = deferred.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    accepted = gated.join(reviewed.select("candidate_id"), "candidate_id", "left_semi")
    total = candidates.agg(F.count(F.lit(1)).alias("total")).withColumns({
        "accepted": accepted.agg(F.count(F.lit(1)).alias("n")).scalar(), "deferred": deferred.agg(F.count(F.lit(1)).alias("n")).scalar(),
        **{name: F.lit(value) for name, value in (GATE_LIMITS | limits).items()}})
    return deferred, counts, total


def review_violations(candidates: DataFrame, reviewed: DataFrame, groups: DataFrame, batch: str, records: DataFrame | None = None,
                      signatures: DataFrame | None = None, risk: dict | None = None, **limits) -> DataFrame:
    """(kind, subject) for reviewed ids that are missing or unsafe, or collide with another batch's group.

    With `records`, for groups that take whole blocks, the gate judges all records of the reviewed blocks; `signatures` and `risk` are then those of `build_candidates`.
    """
    if (records is None) != (signatures is None):
        raise ValueError("records and signatures go together")
    judged = candidates
    if records is not None:
        asked = candidates.join(reviewed.select("candidate_id"), "candidate_id", "left_semi")
        judged = whole_block_candidates(asked, records, signatures, at_least=limits.get("min_image", GATE_LIMITS["min_image"]), **(risk or {}))
    gated = safety_gate(judged, **limits)
    chosen = gated.join(reviewed.select("candidate_id"), "candidate_id", "left_semi")
    missing = reviewed.join(candidates.select("candidate_id"), "candidate_id", "left_anti")
    kept = groups.filter(~F.col("batch").eqNullSafe(batch))
    collide = chosen.join(kept.select("canonical_id"), "canonical_id", "left_semi")
    return (
        missing.select(F.lit("missing candidate").alias("kind"), F.col("candidate_id").alias("subject"))
        .unionByName(chosen.filter(~F.col("safe")).select(F.lit("unsafe candidate").alias("kind"), F.col("candidate_id").alias("subject")))
        .unionByName(collide.select(F.lit("canonical id in use").alias("kind"), F.col("canonical_id").alias("subject")))
    )


def alias_groups_from(candidates: DataFrame, reviewed: DataFrame, groups: DataFrame, members: DataFrame, batch: str,
                      records: DataFrame | None = None, signatures: DataFrame | None = None, risk: dict | None = None, **limits) -> tuple[DataFrame, DataFrame]:
    """Groups and members after a review batch: its earlier groups are replaced, those of other batches stay.

    reviewed(candidate_id, position). Check `review_violations` first. With `records`, the candidate records, a group holds every
    record of its block, without, those of the review list. With `signatures` too, the gate judges all records of the
    reviewed blocks, and unsafe ones make no group. Positions count from 0, highest price first.
    """
    if signatures is not None:
        if records is None:
            raise ValueError("the gate over whole blocks needs the records")
        asked = candidates.join(reviewed.select("candidate_id"), "candidate_id", "left_semi")
        judged = whole_block_candidates(asked, records, signatures, at_least=limits.get("min_image", GATE_LIMITS["min_image"]), **(risk or {}))
        safe = written(safety_gate(judged, **limits).filter("safe").select("candidate_id"))
        reviewed = reviewed.join(safe, "candidate_id", "left_semi")
    kept = groups.filter(~F.col("batch").eqNullSafe(batch))
    kept_members = members.join(kept.select("canonical_id"), "canonical_id", "left_semi")
    chosen = candidates.join(reviewed.select("candidate_id", "position"), "candidate_id")
    made = chosen.select("canonical_id", "canonical_name", F.col("model_code").alias("model_no"), F.lit(batch).alias("batch"), "candidate_id", "position")
    if records is None:
        made_members = chosen.select("canonical_id", F.posexplode("records").alias("position", "r")).select(
            "canonical_id", "position", "r.shop_id", "r.source_key", "r.name", "r.model_no")
    else:
        held = records.join(chosen.select("canonical_id", "model_code", "signature"), ["model_code", "signature"])
        order = [F.col("latest_price").desc(), F.col("ordinal"), F.col("shop_ordinal"), F.col("source_key"), F.col("shop_id")]
        made_members = with_place(held, ["canonical_id"], order, "position").select("canonical_id", "position", "shop_id", "source_key", "name", "model_no")
    return kept.unionByName(made), kept_members.unionByName(made_members)


def validate_alias_groups(groups: DataFrame, members: DataFrame, items: DataFrame, batch: str | None = None) -> DataFrame:
    """(kind, subject) of every broken constraint: unique canonical ids, one owner per (shop, source key),
    and at least two stored items behind each group of the batch."""
    twice = groups.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    owners = members.groupBy("shop_id", "source_key").agg(F.min("canonical_id").alias("a"), F.max("canonical_id").alias("b")).filter("a <> b")
    generated = groups if batch is None else groups.filter(F.col("batch").eqNullSafe(batch))
    live = members.join(items.select(F.col("entity_key").alias("source_key")), "source_key", "left_semi").groupBy("canonical_id").agg(
        F.min("source_key").alias("lo"), F.max("source_key").alias("hi")).filter("lo <> hi")
    thin = generated.join(live.select("canonical_id"), "canonical_id", "left_anti")
    return (
        twice.select(F.lit("duplicate canonical id").alias("kind"), F.col("canonical_id").alias("subject"))
        .unionByName(owners.select(F.lit("source key in several groups").alias("kind"), F.concat_ws(" ", "shop_id", "source_key").alias("subject")))
        .unionByName(thin.select(F.lit("fewer than two stored items").alias("kind"), F.col("canonical_id").alias("subject")))
    )


def assert_no_violations(violations: DataFrame) -> None:
    first = violations.head()
    if first is not None:
        raise AliasConflict(f"{first['kind']}: {first['subject']}")


def merge_alias_groups(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Slots after incoming groups are upserted one after another; the last writer of a slot holds.

    existing and incoming: (canonical_id, candidate_id, position, n_members, ...) with the same columns,
    positions unique within each. Incoming rows need a canonical id and two members. A row goes to
    the slot of the latest earlier row with its candidate id, else of the latest earlier row with its
    canonical id, else to a new slot. So every row points to at most one earlier row, and its slot is
    the root of that chain, found by repeatedly replacing each pointer by its target's pointer.
    Returns the surviving rows with `slot`, a number in the order of the slots.
    """
    ok = (F.coalesce("canonical_id", F.lit("")) != "") & (F.coalesce("n_members", F.lit(0)) >= 2)
    rows = existing.withColumn("_new", F.lit(0)).unionByName(incoming.filter(ok).withColumn("_new", F.lit(1)))
    # Existing rows come before all incoming ones.
    rows = rows.withColumn("_at", F.col("position").cast("long") + F.col("_new") * INCOMING_FROM)

    def latest_before(key: str, name: str) -> DataFrame:
        """The latest earlier row with the same id; rows without the id take no part."""
        having = rows.filter(F.coalesce(key, F.lit("")) != "").select(key, "_at")
        return with_max_before(having, [key], "_at", "_at", name).select("_at", name)

    pointed = rows.select("_at", "_new").join(latest_before("candidate_id", "_cand"), "_at", "left").join(
        latest_before("canonical_id", "_canon"), "_at", "left")
    parent = F.coalesce(F.when(F.col("_new") == 1, F.coalesce("_cand", "_canon")), F.col("_at"))
    links = checkpointed(pointed.select("_at", parent.alias("_to")))
    while True:
        hop = links.select(F.col("_at").alias("_to"), F.col("_to").alias("_next"))
        stepped = checkpointed(links.join(hop, "_to").select("_at", F.col("_next").alias("_to"), (F.col("_next") != F.col("_to")).alias("_moved")))
        links = stepped.select("_at", "_to")
        if stepped.filter("_moved").isEmpty():
            break
    last = links.groupBy("_to").agg(F.max("_at").alias("_at"))
    return rows.join(last, "_at").withColumnRenamed("_to", "slot").drop("_at", "_new")


def match_alias_members(store: merge.Store, groups: DataFrame, members: DataFrame, rules: IdentityRules) -> DataFrame:
    """(canonical_id, entity_key, ordinal) of the items each group takes in, groups with at least two only.

    Items already carrying the canonical id come first. A member matches by its source key, else by its
    recomputed identity key, else by exact name (the item's or one of its shops') with the same code.
    """
    alias = members.select("canonical_id", "position", "source_key", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("model_no", F.lit("")).alias("model_no"))
    keys = store.items.select("entity_key", F.col("ordinal").alias("item_ordinal"))
    by_key = alias.join(keys.withColumnRenamed("entity_key", "source_key"), "source_key").select(
        "canonical_id", "position", F.col("source_key").alias("entity_key"), "item_ordinal")

    rest = alias.join(by_key.select("canonical_id", "position"), ["canonical_id", "position"], "left_anti")
    identities = parse_spellings(rest, rules).select("name", "model_no", F.col("identity_key").alias("entity_key"))
    by_identity = rest.join(identities, ["name", "model_no"]).join(keys, "entity_key").select("canonical_id", "position", "entity_key", "item_ordinal")

    left = rest.join(by_identity.select("canonical_id", "position"), ["canonical_id", "position"], "left_anti").withColumn(
        "alias_code", F.coalesce(last_code(nfkc(F.col("model_no")), rules.code_pattern), last_code(nfkc(F.col("name")), rules.code_pattern)))
    coded = store.items.select("entity_key", F.col("ordinal").alias("item_ordinal"), "name", F.coalesce(
        last_code(nfkc(F.coalesce("model_no", F.lit(""))), rules.code_pattern), last_code(nfkc(F.coalesce("name", F.lit(""))), rules.code_pattern)).alias("item_code"))
    spelled = coded.unionByName(
        store.offers.select("entity_key", F.col("source_name").alias("name")).join(coded.drop("name"), "entity_key")).distinct()
    # Of a group's members with the same spelling only the first place counts: what meets the items is one row per group and spelling,
    # so the join gives nothing that is not in the result. A code narrows it; members without one meet every item of their name.
    spellings = left.groupBy("canonical_id", "name", "alias_code").agg(F.min("position").alias("position"))
    place = ("canonical_id", "position", "entity_key", "item_ordinal")
    with_code = spread_join(spelled.withColumnRenamed("item_code", "alias_code"), spellings.filter("alias_code IS NOT NULL"), ["name", "alias_code"])
    # An item has a name once here, whatever its codes; a name that very many items have is split.
    named = spelled.select("name", "entity_key", "item_ordinal").distinct()
    without = spread_join(named, spellings.filter("alias_code IS NULL").select("canonical_id", "name", "position"), ["name"])
    by_name = with_code.select(*place).unionByName(without.select(*place))

    holders = store.items.filter(F.coalesce("canonical_id", F.lit("")) != "").join(groups.select("canonical_id").distinct(), "canonical_id", "left_semi").select(
        "canonical_id", F.lit(-1).alias("position"), "entity_key", F.col("ordinal").alias("item_ordinal"))
    found = holders.unionByName(by_key).unionByName(by_identity).unionByName(by_name)
    merged = found.groupBy("canonical_id", "entity_key").agg(F.min(F.struct("position", "item_ordinal")).alias("place"))
    enough = merged.groupBy("canonical_id").agg(F.min("entity_key").alias("lo"), F.max("entity_key").alias("hi")).filter("lo <> hi")
    # Merge order as one number: place of the member, then of the item.
    items_up_to = F.lit(1 << 40)
    return merged.join(enough, "canonical_id", "left_semi").select(
        "canonical_id", "entity_key", ((F.col("place.position") + 1).cast("long") * items_up_to + F.col("place.item_ordinal")).alias("ordinal"))


def apply_aliases(store: merge.Store, groups: DataFrame, members: DataFrame, shops: DataFrame, rules: IdentityRules,
                  exclude: DataFrame | None = None) -> merge.Store:
    """Store in which each group's items are one item under the canonical id; best offers and order renewed."""
    # Read many times below; a table of keys only.
    matched = written(match_alias_members(store, groups, members, rules))
    key_map = matched.withColumnRenamed("canonical_id", "new_key")
    merged = merge.merge_store(store, key_map)
    first = store.items.join(key_map.select("entity_key", "new_key", F.col("ordinal").alias("place")), "entity_key").groupBy("new_key").agg(
        F.min_by(F.struct("name", "model_no", "ordinal"), "place").alias("f"))
    heads = groups.groupBy("canonical_id").agg(F.min_by(F.struct("canonical_name", "model_no"), "position").alias("g"))
    renamed = (
        merged.items.select("entity_key", "image_url").join(first.withColumnRenamed("new_key", "entity_key"), "entity_key")
        .join(heads.withColumnRenamed("canonical_id", "entity_key"), "entity_key")
        .select("entity_key", F.col("entity_key").alias("canonical_id"), F.coalesce(nonblank("g.canonical_name"), "f.name").alias("name"),
                F.coalesce(nonblank("g.model_no"), "f.model_no").alias("model_no"), "image_url", F.col("f.ordinal").alias("ordinal"))
    )
    consumed = matched.select("entity_key").distinct()

    def rest(df):
        return df.join(consumed, "entity_key", "left_anti")

    out = merge.Store(
        renamed.unionByName(rest(store.items).select(*renamed.columns)),
        merged.aliases.unionByName(rest(store.aliases)),
        merged.offers.unionByName(rest(store.offers), allowMissingColumns=True),
        merged.history.unionByName(rest(store.history)),
    )
    return merge.finish_store(out, shops, exclude)
