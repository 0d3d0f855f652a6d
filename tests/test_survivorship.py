"""Field-wise survivorship, strict payloads, image fall-back, holdings files, whole-block groups."""

import pytest
from pyspark.sql import functions as F

from offerlens.functions import durable
from offerlens.operators import aliases, collection, history, merge, portfolio, resolution, views
from offerlens.operators.offers import nest_listing_index
from offerlens.plans.identity_queries import RULES
from offerlens.sources import backfill, payloads


def test_older_offer_fills_missing_fields(spark):
    rows = [("i", "s", 5, None, "2024-01-02", 2, "new"), ("i", "s", 4, "img", "2024-01-01", 1, "old"), ("i", "s", 3, "older", "2023-01-01", 3, None), ("j", "s", None, "x", None, 1, None)]
    offers = spark.createDataFrame(rows, "entity_key string, shop_id string, latest_price long, image_url string, last_date string, ordinal int, source_name string").withColumn("last_date", F.col("last_date").cast("date"))
    out = {r["entity_key"]: r for r in merge.merge_offers(offers).collect()}
    assert (out["i"]["latest_price"], out["i"]["image_url"], out["i"]["source_name"], out["i"]["ordinal"], str(out["i"]["last_date"])) == (5, "img", "new", 2, "2024-01-02")
    assert (out["j"]["latest_price"], out["j"]["image_url"], out["j"]["last_date"]) == (None, "x", None)
    ranked = merge.merge_offers(merge.precedence(offers, ["entity_key", "shop_id"])).filter("entity_key = 'i'").head()
    assert (ranked["latest_price"], ranked["image_url"], ranked["source_name"]) == (5, "img", "new")


def test_broken_page_fails_the_ingestion(spark):
    pages = spark.createDataFrame([("a", 1, '{"result": true, "last_page": 200, "records": []}')], "source_id string, page int, body string")
    with pytest.raises(Exception, match="invalid last_page"):
        payloads.ingest_paged_json(pages).collect()
    assert payloads.ingest_paged_json(pages, on_violation="skip").count() == 0 and payloads.ingest_paged_json(pages, max_pages=200).count() == 0
    with pytest.raises(ValueError):
        payloads.ingest_paged_json(pages, on_violation="ignore")


def test_item_images(spark):
    shops = spark.createDataFrame([("a", 0, True), ("b", 1, True), ("c", 2, False)], "shop_id string, ordinal int, enabled boolean")
    offers = spark.createDataFrame(
        [("i", "a", 1, "ia"), ("i", "b", 9, ""), ("j", "a", 1, "ja"), ("j", "b", 9, "jb"), ("k", "c", 9, "kc"), ("k", "a", 1, None), ("l", "b", 0, "lb")],
        "entity_key string, shop_id string, latest_price long, image_url string")
    off = shops.filter("NOT enabled").select("shop_id")
    images = views.item_images(offers, shops, off)
    assert {r["entity_key"]: r["item_image"] for r in images.collect()} == {"i": "ia", "j": "jb", "l": "lb"}
    best = views.with_item_images(views.shop_view(offers, shops, "best", off), images)
    assert {r["entity_key"]: r["image_url"] for r in best.collect()} == {"i": "ia", "j": "jb", "k": ""}


def test_quantities_beyond_64_bits_are_not_cut(spark):
    rows = spark.createDataFrame([("o", "n", str(k), q, k) for k, q in enumerate(["123456789012345678901", "12 pieces", "-3", "x"])], "owner_id string, name string, model_no string, qty string, seq long")
    assert {r["entity_key"]: r["qty"] for r in portfolio.import_holdings(rows).collect()} == {"n_0": 0, "n_1": 12, "n_2": -3, "n_3": 0}


def test_later_file_wins(spark, tmp_path):
    for name, qty in (("b.csv", 2), ("a.csv", 1)):
        (tmp_path / name).write_text(f'"owner_id","name","model_no","price","qty","subtotal","image_url"\n"o","n","m","1","{qty + 5}","1",""\n"o","n","m","1","{qty}","1",""\n')
    rows = portfolio.read_holdings_csv(spark, str(tmp_path))
    assert [r["qty"] for r in portfolio.import_holdings(rows).collect()] == [2]


def test_late_observations_by_day(spark):
    tails = spark.createDataFrame([("i", "s", "2024-01-03", 7)], "entity_key string, shop_id string, date string, price long").withColumn("date", F.col("date").cast("date"))
    seen = [("i", "s", "2024-01-02", 1, 5), ("i", "s", "2024-01-02", 2, 6), ("i", "s", "2024-01-03", 3, 8), ("i", "s", "2024-01-04", 4, 8), ("i", "s", "2024-01-05", 5, 9), ("j", "s", "2024-01-01", 6, 1)]
    observations = spark.createDataFrame(seen, "entity_key string, shop_id string, obs_date string, obs_seq long, price long").withColumn("obs_date", F.col("obs_date").cast("date"))
    entries, late = history.log_changes(tails, observations)
    assert sorted((r["entity_key"], str(r["date"]), r["price"]) for r in entries.collect()) == [("i", "2024-01-03", 8), ("i", "2024-01-05", 9), ("j", "2024-01-01", 1)]
    assert sorted(r["obs_seq"] for r in late.collect()) == [1, 2] and late.columns == observations.columns


def test_renewed_offers(spark):
    items = spark.createDataFrame([("i", "n", "m", "item"), ("j", "n", "m", "")], "entity_key string, name string, model_no string, image_url string")
    offers = spark.createDataFrame([("i", "s", 1, "", "x"), ("i", "t", 9, "t", "y")], "entity_key string, shop_id string, latest_price long, image_url string, source_name string")
    log = spark.createDataFrame([("i", "s", "2024-01-01", 3), ("i", "s", "2024-01-02", 4), ("j", "s", "2024-01-01", 0)], "entity_key string, shop_id string, date string, price long").withColumn("date", F.col("date").cast("date"))
    assert sorted(map(tuple, backfill.renew_offers(items, offers, log, "s").collect()), key=str) == [("i", "s", 4, "item", "x"), ("i", "t", 9, "t", "y"), ("j", "s", 0, "", None)]
    shops = spark.createDataFrame([("s", 0, True), ("t", 1, True)], "shop_id string, ordinal int, enabled boolean")
    kept, _ = backfill.finish_backfill(items, offers, log, "s", shops)
    assert [(r["entity_key"], r["best_shop_id"], r["best_price"]) for r in kept.collect()] == [("i", "t", 9)]


def test_groups_hold_every_record(spark):
    kinds = "source_key string, identity_key string, shop_id string, shop_name string, name string, model_no string, model_code string, tags array<string>, signature string, latest_price long, image_url string, ordinal long, shop_ordinal int"
    records = spark.createDataFrame([(f"k{k}", f"id{k % 2}", f"s{k % 3}", "S", f"n{k}", "m", "c", [], "base", 100 + k, "", k, k % 3) for k in range(20)], kinds)
    candidates = resolution.build_candidates(records, spark.createDataFrame([], "url string, signature string"))
    reviewed = candidates.select("candidate_id", F.lit(0).alias("position"))
    none = spark.createDataFrame([], "canonical_id string, canonical_name string, model_no string, batch string, candidate_id string, position long")
    no_members = spark.createDataFrame([], "canonical_id string, position long, shop_id string, source_key string, name string, model_no string")
    members = aliases.alias_groups_from(candidates, reviewed, none, no_members, "b", records)[1].orderBy("position").collect()
    assert [m["source_key"] for m in members] == [f"k{k}" for k in reversed(range(20))]
    assert aliases.alias_groups_from(candidates, reviewed, none, no_members, "b")[1].count() == 8
    facts = resolution.block_facts(records).head()
    assert (facts["block_records"], facts["block_shops"], facts["block_min_price"], facts["block_max_price"], facts["block_duplicate_shops"]) == (20, 3, 100, 119, 3)
    summary = aliases.deferral_report(candidates, reviewed, min_shops=2)[2].head()
    assert (summary["total"], summary["min_shops"], summary["max_ratio"], summary["min_image"]) == (1, 2, 2.0, 80)


def block_of(spark, changed):
    """Twelve equal records of twelve shops, highest price first, some of them changed; (candidates, records, signatures)."""
    kinds = "source_key string, identity_key string, shop_id string, shop_name string, name string, model_no string, model_code string, tags array<string>, signature string, latest_price long, image_url string, ordinal long, shop_ordinal int"
    rows = [{"source_key": f"k{k}", "identity_key": f"id{k % 2}", "shop_id": f"s{k:02}", "shop_name": "S", "name": "n", "model_no": "m", "model_code": "c", "tags": ["opened"], "signature": "base",
             "latest_price": 5000 - k, "image_url": "u", "ordinal": k, "shop_ordinal": k} | changed.get(k, {}) for k in range(12)]
    records = spark.createDataFrame([tuple(r.values()) for r in rows], kinds)
    signatures = spark.createDataFrame([("u", "ffff"), ("v", "ff00")], "url string, signature string")
    return resolution.build_candidates(records, signatures), records, signatures


@pytest.mark.parametrize("changed", [{"latest_price": 900}, {"tags": ["unopened"]}, {"shop_id": "s00"}, {"image_url": "v"}])
def test_gate_of_whole_blocks(spark, changed):
    none = spark.createDataFrame([], "canonical_id string, canonical_name string, model_no string, batch string, candidate_id string, position long")
    for late, unsafe in (({}, []), ({11: changed}, ["unsafe candidate"])):
        candidates, records, signatures = block_of(spark, late)
        reviewed = candidates.select("candidate_id", F.lit(0).alias("position"))
        assert aliases.review_violations(candidates, reviewed, none, "b").count() == 0  # the review list shows nothing
        found = aliases.review_violations(candidates, reviewed, none, "b", records, signatures).collect()
        assert [r["kind"] for r in found] == unsafe


def test_whole_block_facts_equal_the_review_list_where_it_holds_all(spark):
    changed = {k: {"shop_id": "s00", "image_url": "v" if k % 2 else "u"} for k in range(0, 12, 3)} | {5: {"tags": ["unopened"], "latest_price": 0}}
    candidates, records, signatures = block_of(spark, changed)
    whole = resolution.build_candidates(records, signatures, k=12).head().asDict()
    found = resolution.whole_block_candidates(candidates, records, signatures).head().asDict()
    for c in ("min_price", "max_price", "price_ratio", "duplicate_shops", "condition_conflict", "image_min", "image_max", "warnings", "risk_level"):
        assert found[c] == whole[c], c


def test_positions_of_whole_blocks(spark):
    candidates, records, _ = block_of(spark, {3: {"latest_price": 5000 - 4}, 7: {"latest_price": 1 << 50}})
    none = spark.createDataFrame([], "canonical_id string, canonical_name string, model_no string, batch string, candidate_id string, position long")
    no_members = spark.createDataFrame([], "canonical_id string, position long, shop_id string, source_key string, name string, model_no string")
    groups, members = aliases.alias_groups_from(candidates, candidates.select("candidate_id", F.lit(0).alias("position")), none, no_members, "b", records)
    placed = [(r["position"], r["source_key"]) for r in members.orderBy("position").collect()]
    assert placed == list(enumerate(f"k{k}" for k in (7, 0, 1, 2, 3, 4, 5, 6, 8, 9, 10, 11)))
    items = records.select(F.col("source_key").alias("entity_key"), F.lit(None).cast("string").alias("canonical_id"), "name", "model_no", "ordinal")
    offers = records.select(F.col("source_key").alias("entity_key"), F.col("name").alias("source_name"))
    matched = aliases.match_alias_members(merge.Store(items, None, offers, None), groups, members, RULES).orderBy("ordinal").collect()
    assert [r["entity_key"] for r in matched] == [key for _, key in placed]


def test_only_local_sessions_get_a_folder_of_their_own(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        class _jsc:
            @staticmethod
            def sc():
                class S:
                    @staticmethod
                    def getCheckpointDir():
                        class D:
                            @staticmethod
                            def isDefined():
                                return False

                        return D

                return S

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        durable.shared_folder(Session())


def test_nested_index_and_default_offers(spark):
    offers = spark.createDataFrame([("i", "b", 2), ("i", "a", 1)], "entity_key string, shop_id string, latest_price long")
    rows = spark.createDataFrame([("i", "n"), ("j", "m")], "entity_key string, name string")
    out = {r["entity_key"]: r["offers_by_shop"] for r in nest_listing_index(rows, offers).collect()}
    assert {k: v["latest_price"] for k, v in out["i"].items()} == {"a": 1, "b": 2} and out["j"] is None
    items = spark.createDataFrame([("i", None, "n", "m", "x", 0, 7), ("j", None, "n", "m", "y", 1, 8)], "entity_key string, canonical_id string, name string, model_no string, image_url string, ordinal int, latest_price long")
    log = spark.createDataFrame([("j", "*", 8), ("i", "a", 1)], "entity_key string, shop_id string, price long").withColumn("date", F.lit("2024-01-01").cast("date"))
    store = merge.Store(items, spark.createDataFrame([], "entity_key string, alias_key string"), offers.withColumn("image_url", F.lit("z")), log)
    made = merge.with_default_offers(store, "d")
    assert [tuple(r) for r in made.offers.filter("shop_id = 'd'").select("entity_key", "latest_price", "image_url").collect()] == [("j", 8, "y")]
    assert [(r["entity_key"], r["price"]) for r in made.history.filter("shop_id = 'd'").collect()] == [("j", 8)]


def test_signature_urls_and_unresolved_files(spark, tmp_path):
    candidates = spark.createDataFrame([(900, [("http://a",), ("",)]), (50, [("http://a ",), ("http://b",)])], "max_price long, records array<struct<image_url string>>")
    offers = spark.createDataFrame([("http://b",), ("http://c",), ("ftp://d",)], "image_url string")
    assert {(r["url"], r["priority"]) for r in resolution.signature_urls(candidates, offers).collect()} == {("http://a", 900), ("http://b", 50), ("http://c", -1)}
    rows = spark.createDataFrame([("1", 'say "x"', "k|l")], "payload_id string, card_name string, candidate_keys string")
    for fmt, read in (("csv", lambda p: spark.read.csv(p, header=True, escape='"')), ("json", spark.read.json)):
        collection.write_unresolved(rows, str(tmp_path / fmt), fmt)
        assert read(str(tmp_path / fmt)).select(*rows.columns).collect() == rows.collect()
