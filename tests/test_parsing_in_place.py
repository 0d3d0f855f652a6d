"""Tables of one record per item are parsed in place, and nothing is written or compared twice."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from offerlens.functions.durable import shared_folder, written
from offerlens.operators import identity, merge
from offerlens.operators import resolution as er
from offerlens.plans.identity_queries import RULES

NAMES = [("red rod [Opened] (red)", "OP00-002"), ("[red]red rod ※opened", "OP00-002"), ("red rod op00-002 (RED/R/2024)", "No: opened"), ("Ａ－Ｂ&amp;c\n [x/ｙy/]", "※serial"),
         ("café 【長い ラベル版】[ab\n]", ""), ("", ""), (None, None), ("x", None), ("[ok-go][---][R](2024)", "P-001※※z9"), ("red rod [Opened] (red)", "OP00-002")]


def tables(root):
    return {p.name for p in Path(root.removeprefix("file:")).iterdir()}


def test_each_record_has_the_identity_of_its_spelling(spark):
    rows = spark.createDataFrame([(k, n, m, {"k": n or ""}) for k, (n, m) in enumerate(NAMES)], "id int, name string, model_no string, more map<string,string>")
    fields = ["id", "name", "model_no", "model_code", "base_name", F.array_join("tags", "+").alias("tags"), "identity_key"]
    each = identity.resolve_each(rows, RULES)
    assert sorted(each.select(*fields).collect()) == sorted(identity.resolve_identity(rows, RULES).select(*fields).collect())
    got = {r["id"]: (r["model_code"], r["tags"]) for r in each.select(*fields).collect()}
    assert got[0] == ("OP00-002", "opened+red") and got[4] == ("", "ab+長いラベル".replace("ー", "")) and got[8] == ("P-001", "okgo+z9")


def test_names_of_items_are_shuffled_once(spark):
    items = written(spark.range(200).select(F.concat(F.lit("k"), "id").alias("entity_key"), F.concat(F.lit("rod "), "id").alias("name"), F.lit("OP00-001").alias("model_no"), F.col("id").alias("ordinal")))
    plan = merge.identity_key_map(items, RULES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_plain_tokens_keep_their_form(spark):
    tokens = ["ABC9", "a-b", "ab\n", "", None, "ラベル版", "Long Name", "x\u0085", "é"]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", identity.plain_token(F.col("t")).alias("plain")).collect()
    assert {r["t"]: r["plain"] for r in rows} == {"ABC9": "abc9", "a-b": "ab", "ab\n": "ab", "": "", None: None, "ラベル版": "ラベル", "Long Name": "longname", "x\u0085": "x", "é": "é"}


def test_a_written_table_is_not_written_again(spark):
    rows = written(spark.range(9).withColumnRenamed("id", "_written"))
    assert written(rows) is rows and written(rows.filter("_written > 3")).count() == 5


def test_the_best_of_a_block_are_kept_before_anything_is_written(spark):
    rng = random.Random(4)
    rows = [(f"b{b}", "base", f"i{k % 3}" if b else "i", f"s{k % 4}", "AB"[k % 2], rng.randrange(9), k, 0) for b in range(3) for k in range(30)]
    records = written(spark.createDataFrame(rows, "model_code string, signature string, identity_key string, source_key string, shop_id string, latest_price long, ordinal int, shop_ordinal int"))
    root = shared_folder(spark)
    before = tables(root)
    found = er.review_records(records, 5)
    got = {(r["model_code"], r["position"], r["ordinal"]) for r in found.collect()}
    assert tables(root) == before
    # Block b0 has one identity and does not qualify.
    want = set()
    for b in ("b1", "b2"):
        for p, r in enumerate(sorted((r for r in rows if r[0] == b), key=lambda r: (-r[5], r[6]))[:5]):
            want.add((b, p + 1, r[6]))
    assert got == want


def test_a_tile_meets_itself_once(spark):
    rows = spark.createDataFrame([(True, [1, 2, 3], [1, 2, 3]), (False, [1, 2], [5, 9])], "same boolean, left_values array<int>, right_values array<int>")
    low, high = er._extremes(lambda x, y: F.abs(x - y))
    pairs = F.size(F.flatten(F.transform("left_values", lambda x, i: F.when(F.col("same"), F.slice("right_values", i + 1, F.size("right_values"))).otherwise(F.col("right_values")))))
    assert sorted(tuple(r) for r in rows.select(low, high, pairs).collect()) == [(0, 2, 6), (3, 8, 4)]
