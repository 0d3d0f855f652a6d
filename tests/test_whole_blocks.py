"""Comparisons over whole blocks against plain loops."""

import random

from pyspark.sql import functions as F

from offerlens.operators import resolution as er

RECORD = "model_code string, signature string, shop_id string, name string, image_url string, latest_price long, tags array<string>"


def similarity(a, b):
    if len(a) != len(b):
        return None
    distance = sum((int(x, 16) ^ int(y, 16)).bit_count() for x, y in zip(a, b))
    return int((1 - distance / (4 * len(a))) * 100 + 0.5)


def made(rng, n, blocks=2, bits=64):
    base = rng.getrandbits(64)
    rows, hashes = [], {}
    for k in range(n):
        value = base
        for _ in range(rng.randrange(12)):
            value ^= 1 << rng.randrange(bits)
        hashes[f"u{k}"] = f"{value:016x}" if k % 9 else f"{value & 0xFFFF:04x}"
        rows.append((f"b{k % blocks}", "base", rng.choice("abc"), "".join(rng.choice("abcd") for _ in range(rng.randrange(6, 12))), f"u{k}", 100, []))
    return rows, hashes


def plain_images(rows, hashes):
    out = {}
    for block in {r[0] for r in rows}:
        held = [(r[2], hashes[r[4]]) for r in rows if r[0] == block and r[4] in hashes]
        found = [s for i, (shop, x) in enumerate(held) for other, y in held[i + 1 :] if shop != other and (s := similarity(x, y)) is not None]
        out[block] = (max(found, default=None), min(found, default=None))
    return out


def frames(spark, rows, hashes):
    return spark.createDataFrame(rows, RECORD), spark.createDataFrame(list(hashes.items()), "url string, signature string")


def test_image_extremes_of_whole_blocks(spark):
    rows, hashes = made(random.Random(2), 160)
    records, signatures = frames(spark, rows, hashes)
    want = plain_images(rows, hashes)
    for per_tile in (512, 7):
        got = {r["model_code"]: (r["image_max"], r["image_min"]) for r in er.block_images(records, signatures, per_tile=per_tile).collect()}
        assert got == want


def test_pairs_are_counted_as_distinct_signatures_across_shops(spark):
    rows = [("b", "base", shop, "n", url, 1, []) for shop, url in [("a", "u1"), ("a", "u2"), ("b", "u1"), ("c", "u3"), ("a", "u2")]]
    records, signatures = frames(spark, rows, {"u1": "00", "u2": "0f", "u3": "f0"})
    row = er.block_images(records, signatures).first()
    # u1 (a, b) with itself, u1-u2, u1-u3, u2-u3.
    assert (row["image_pairs"], row["image_max"], row["image_min"], row["hashed_records"]) == (4, 100, 0, 5)


def test_a_bound_decides_blocks_of_alike_images(spark):
    rows, hashes = made(random.Random(3), 60, blocks=1, bits=6)
    hashes = {u: h.rjust(16, "0") for u, h in hashes.items() if len(h) == 16}
    records, signatures = frames(spark, rows, hashes)
    exact = er.block_images(records, signatures).first()
    bounded = er.block_images(records, signatures, at_least=80).first()
    assert 80 <= bounded["image_min"] <= exact["image_min"] and bounded["image_pairs"] == exact["image_pairs"]


def test_twenty_thousand_signatures_in_one_block(spark):
    rows = spark.range(20_000).select(F.lit("b").alias("model_code"), F.lit("base").alias("signature"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("shop_id"), F.lit("n").alias("name"),
                                      F.col("id").cast("string").alias("image_url"), F.lit(1).cast("long").alias("latest_price"))
    signatures = spark.range(20_000).select(F.col("id").cast("string").alias("url"), F.lpad(F.lower(F.hex(F.col("id"))), 16, "0").alias("signature"))
    row = er.block_images(rows, signatures, at_least=70).first()
    assert row["hashed_records"] == 20_000 and row["image_min"] == 77 and row["image_pairs"] == 20_000 * 20_001 // 2 - 2 * (10_000 * 10_001 // 2)


def test_weakest_name_pair_of_whole_blocks(spark):
    rows, _ = made(random.Random(5), 90, blocks=3)
    rows += [("one", "base", "a", "abcd", "u", 1, []), ("same", "base", "a", "abcd", "u", 1, []), ("same", "base", "b", "AB-CD", "u", 1, []), ("none", "base", "a", "--", "u", 1, []), ("none", "base", "b", "abcd", "u", 1, [])]
    records = spark.createDataFrame(rows, RECORD)

    def chunks(name):
        name = name.lower().replace("-", "")
        return {name[k : k + 2] for k in range(0, len(name), 2)}

    want = {}
    for block in {r[0] for r in rows}:
        sets = [chunks(r[3]) for r in rows if r[0] == block]
        pairs = [len(x & y) / len(x | y) if x and y else 0.0 for i, x in enumerate(sets) for y in sets[i + 1 :]]
        want[block] = min(pairs, default=1.0)
    for per_tile in (128, 5):
        got = {r["model_code"]: r["block_name_score"] for r in er.block_name_score(records, per_tile).collect()}
        assert {b: round(v, 9) for b, v in got.items()} == {b: round(v, 9) for b, v in want.items()}
