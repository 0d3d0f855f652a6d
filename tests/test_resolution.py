import random

import pytest
from pyspark.sql import functions as F

from offerlens.functions.skew import salted_join
from offerlens.operators import aliases as al
from offerlens.operators import resolution as er

CANDIDATE = ("c", False, "low", [], 1.5, 3, 90, ["a", "b", "c"])


def gate(spark, **change):
    fields = dict(zip(("candidate_id", "condition_conflict", "risk_level", "warnings", "price_ratio", "image_pairs", "image_min", "shops_"), CANDIDATE)) | change
    df = spark.createDataFrame([tuple(fields.values())], "candidate_id string, condition_conflict boolean, risk_level string, warnings array<string>, price_ratio double, image_pairs int, image_min long, shops_ array<string>")
    return er.safety_gate(df.withColumn("records", F.transform("shops_", lambda s: F.struct(s.alias("shop_id"))))).head()


@pytest.mark.parametrize("change, safe", [
    ({}, True), ({"price_ratio": 2.0}, True), ({"image_min": 80}, True), ({"price_ratio": 2.1}, False), ({"price_ratio": None}, False), ({"image_min": 79}, False),
    ({"image_pairs": 0, "image_min": None}, False), ({"shops_": ["a", "b", "b", ""]}, False), ({"warnings": ["w"]}, False), ({"risk_level": "medium"}, False),
    ({"condition_conflict": True}, False),
])
def test_each_threshold_of_the_gate(spark, change, safe):
    row = gate(spark, **change)
    assert row["safe"] is safe and (len(row["reasons"]) == (0 if safe else 1))


def test_signature_bits_and_similarity(spark):
    values = [3.0, 1.0, 2.0, 5.0, 4.0, 4.0]
    df = spark.createDataFrame([(values, "ff00ff00ff", "ff00ff00fe", "ff")], "v array<double>, a string, b string, c string")
    row = df.select(er.gradient_signature(F.col("v")).alias("one"), er.gradient_signature(F.col("v"), 3).alias("two"), er.hamming_similarity(F.col("a"), F.col("b")).alias("near"),
                    er.hamming_similarity(F.col("a"), F.col("c")).alias("none")).head()
    # One row: 10010 -> 1001 0000; two rows of three: 10 | 10 -> 1010.
    assert (row["one"], row["two"], row["near"], row["none"]) == ("90", "a", 1 - 1 / 40, None)


def fold_groups(existing, incoming):
    slots = [dict(g) for g in existing]
    by_cand, by_canon = {}, {}
    for k, g in enumerate(slots):
        if g["candidate_id"]:
            by_cand[g["candidate_id"]] = k
        if g["canonical_id"]:
            by_canon[g["canonical_id"]] = k
    for g in incoming:
        if not g["canonical_id"] or g["n_members"] < 2:
            continue
        k = by_cand.get(g["candidate_id"]) if g["candidate_id"] in by_cand and g["candidate_id"] else by_canon.get(g["canonical_id"])
        if k is None:
            k = len(slots)
            slots.append(None)
        slots[k] = dict(g)
        if g["candidate_id"]:
            by_cand[g["candidate_id"]] = k
        by_canon[g["canonical_id"]] = k
    return [(g["canonical_id"], g["candidate_id"], g["tag"]) for g in slots]


def test_group_merge_with_chains_equals_going_one_by_one(spark):
    rng = random.Random(9)
    schema = "canonical_id string, candidate_id string, position long, n_members long, tag string"
    for _ in range(4):
        def made(n, kind):
            return [{"canonical_id": rng.choice(["a", "b", "c", "d", "e", None]), "candidate_id": rng.choice([None, None, "x", "y", "z"]), "position": k,
                     "n_members": rng.choice([1, 2, 3]), "tag": f"{kind}{k}"} for k in range(n)]
        existing, incoming = made(4, "old"), made(15, "new")
        out = al.merge_alias_groups(spark.createDataFrame([tuple(g.values()) for g in existing], schema), spark.createDataFrame([tuple(g.values()) for g in incoming], schema))
        assert [(r["canonical_id"], r["candidate_id"], r["tag"]) for r in out.orderBy("slot").collect()] == fold_groups(existing, incoming)


def test_salted_join_equals_join(spark):
    many = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    few = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        want = {tuple(r) for r in many.join(few, "k", how).select("k", "id", "v").collect()}
        assert {tuple(r) for r in salted_join(many, few, ["k"], how, rows_per_task=200).select("k", "id", "v").collect()} == want


def test_recovered_tags_need_agreement(spark):
    aliases = spark.createDataFrame([("i1", "OP01-001@red+big"), ("i1", "op01-001@RED"), ("i2", "op01-001@red"), ("i2", "op01-001@blue"), ("i3", "op01-001@big")], "entity_key string, alias_key string")
    got = {(r["entity_key"], r["code"], tuple(r["recovered"])) for r in er.recovered_hard_tags(aliases, "^(?:red|blue)$").collect()}
    assert got == {("i1", "op01-001", ("red",))}
