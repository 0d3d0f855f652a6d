"""Change-driven re-keying against the full one; alias members of a very frequent name."""

import random

import pytest
from pyspark.sql import functions as F

from offerlens.functions import skew
from offerlens.operators import aliases, merge
from offerlens.plans.identity_queries import RULES

ITEMS = "entity_key string, canonical_id string, name string, model_no string, image_url string, ordinal int"


def store_of(spark, items, more_aliases=()):
    """One offer and two log entries of shop s or t per item, one entry of its own."""
    listed = [(r[0], f"was-{r[0]}") for r in items] + list(more_aliases)
    offers = [(r[0], "st"[r[5] % 2], 100 + r[5], None if r[5] % 3 else "img", r[2]) for r in items]
    log = [(r[0], shop, f"2024-01-{1 + (7 * r[5] + k) % 28:02}", 10 * r[5] + k) for r in items for shop, ks in (("st"[r[5] % 2], (0, 3)), ("*", (0,))) for k in ks]
    return merge.Store(
        spark.createDataFrame(items, ITEMS), spark.createDataFrame(listed, "entity_key string, alias_key string"),
        spark.createDataFrame(offers, "entity_key string, shop_id string, latest_price long, image_url string, source_name string"),
        spark.createDataFrame(log, "entity_key string, shop_id string, date string, price long").withColumn("date", F.col("date").cast("date")),
    )


def rows(store):
    return [sorted(map(repr, df.select(*sorted(set(df.columns) - {"last_date"})).collect())) for df in (store.items, store.aliases, store.offers, store.history)]


def settled(spark, seed):
    """Items under their keys with their texts among the aliases, then some renamed, one moved onto another's key, and new ones."""
    rng = random.Random(seed)
    items, spelled = [], []
    for k in range(30):
        key = f"op01-{k:03}"
        items.append((key, "c" if k == 4 else None, f"Cat {k}", f"OP01-{k:03}", "" if k % 4 else f"i{k}", k))
        spelled.append((key, f"Cat {k}_OP01-{k:03}"))
    changed = {}
    for k in rng.sample(range(30), 6):  # among them chains: one takes a key whose holder moves on
        changed[k] = rng.randrange(34)
    items = [(*r[:2], f"Dog {r[5]}", f"OP01-{changed[r[5]]:03}", *r[4:]) if r[5] in changed else r for r in items]
    new = [(f"new{k}", None, "Bird" * (k % 3 + 1), f"OP01-{rng.randrange(36):03}", "n", 30 + k) for k in range(8)]
    touched = [(f"op01-{k:03}",) for k in changed] + [(r[0],) for r in new]
    return store_of(spark, items + new, spelled), spark.createDataFrame(touched, "entity_key string")


@pytest.mark.parametrize("seed", [1])
def test_changed_items_only(spark, seed):
    store, touched = settled(spark, seed)
    full = rows(merge.rekey(store, RULES))
    assert rows(merge.rekey_changed(store, RULES, touched)) == full
    items, _, offers, history = rows(merge.rekey_changed(store, RULES))
    assert (items, offers, history) == (full[0], full[2], full[3])


def test_nothing_changed(spark):
    items = [("op01-001", None, "Cat", "OP01-001", "", 0), ("op01-002", None, "Dog", "OP01-002", "x", 1)]
    store = store_of(spark, items)
    none = spark.createDataFrame([], "entity_key string")
    assert rows(merge.rekey_changed(store, RULES)) == rows(merge.rekey_changed(store, RULES, none)) == rows(store)
    empty = merge.Store(*(df.limit(0) for df in (store.items, store.aliases, store.offers, store.history)))
    assert rows(merge.rekey_changed(empty, RULES)) == [[], [], [], []]


def test_only_concerned_rows_are_merged(spark):
    """Rows of other items pass as they are, even where a merge would change them."""
    items = [("op01-001", "", "Cat", "OP01-001", None, 0), ("k", None, "Dog", "OP01-002", "x", 1), ("op01-002", None, "Bird", "OP01-002", "", 2)]
    out = merge.rekey_changed(store_of(spark, items), RULES)
    made = {r["entity_key"]: r for r in out.items.collect()}
    assert set(made) == {"op01-001", "op01-002"} and made["op01-001"]["image_url"] is None and made["op01-001"]["canonical_id"] == ""
    assert (made["op01-002"]["name"], made["op01-002"]["image_url"], made["op01-002"]["ordinal"]) == ("Dog", "x", 1)
    assert {r["alias_key"] for r in out.aliases.filter("entity_key = 'op01-002'").collect()} == {"k", "was-k", "was-op01-002", "Dog_OP01-002", "Bird_OP01-002"}


@pytest.mark.parametrize("salted", [False, True])
def test_frequent_name(spark, monkeypatch, salted):
    """Half of the items share a name; forty members without a code name them in two groups."""
    if salted:
        monkeypatch.setattr(skew, "splits_skew_itself", lambda df: False)
        monkeypatch.setattr(skew.salted_join, "__defaults__", ("inner", 100))
    items = [(f"k{k}", None, "Twin" if k % 2 else f"Only {k}", "", "", k) for k in range(4_000)]
    store = merge.Store(spark.createDataFrame(items, ITEMS), None, spark.createDataFrame([(f"k{k}", "Twin") for k in range(0, 40, 4)], "entity_key string, source_name string"), None)
    listed = [(f"g{k % 2}", 100 + k, "s", "gone", "Twin" if k else "Only 2", None) for k in range(40)]
    members = spark.createDataFrame(listed, "canonical_id string, position long, shop_id string, source_key string, name string, model_no string")
    groups = spark.createDataFrame([(f"g{k}", "n", "m", "b", "c", k) for k in range(2)], "canonical_id string, canonical_name string, model_no string, batch string, candidate_id string, position long")
    found = {(r["canonical_id"], r["entity_key"]): (r["ordinal"] >> 40) - 1 for r in aliases.match_alias_members(store, groups, members, RULES).collect()}
    held = {f"k{k}" for k in range(4_000) if k % 2 or (k < 40 and k % 4 == 0)}
    first = {"g0": 102, "g1": 101}
    assert found == {(g, key): first[g] for g in first for key in held} | {("g0", "k2"): 100}
