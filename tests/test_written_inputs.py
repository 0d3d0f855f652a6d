"""What registered queries read many times is written once, and small tables do not keep their work in one task."""

import pytest
from pyspark.sql import functions as F

from offerlens.functions.skew import measured_session
from offerlens.functions.unicode import nfkc_decoded
from offerlens.operators import catalog, merge
from offerlens.operators.identity import parse_spellings
from offerlens.plans import identity_queries, resolution_queries
from offerlens.plans.bindings import Inputs

SF = "/root/testdata/sf0.001"


@pytest.fixture
def inputs(spark):
    return Inputs(measured_session(spark), SF)


@pytest.mark.parametrize("name", ["lots", "listings", "er", "parts"])
def test_bindings_read_many_times_come_from_a_written_table(inputs, name):
    assert not [f for f in getattr(inputs, name).inputFiles() if SF in f]


def test_parts_are_more_than_one_task(inputs):
    assert len(inputs.parts.inputFiles()) > 1
    assert inputs.parts.count() == inputs.part.count()


def test_parsing_keeps_its_partitions(spark):
    """Also where the session shuffles into as many partitions as the parsing asks for."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    names = own.range(100).select(F.concat(F.lit("item "), F.col("id").cast("string")).alias("name"), F.lit("OP01-001").alias("model_no"))
    assert parse_spellings(names, identity_queries.RULES).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("rows", [[], [("gear [Serial] (hot)", "OP01-001", ["hot", "serial"]), ("gear [/ ]", "OP01-001", []), (None, None, [])]])
def test_tags_of_tokens_with_and_without_rule(spark, rows):
    names = spark.createDataFrame([r[:2] for r in rows], "name string, model_no string")
    got = {(r["name"], r["model_no"]): r["tags"] for r in parse_spellings(names, identity_queries.RULES).collect()}
    assert got == {r[:2]: r[2] for r in rows}


def test_folding_of_texts_with_and_without_entities(spark):
    texts = ["a&nbsp;b", "&#65;&#x42;", "Ａ&#65;", "x &amp; y", "", None, "&#38;quot;", "plain"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r["f"] for r in rows.withColumn("f", nfkc_decoded(F.col("t"))).orderBy("k").collect()]
    assert got == ["a b", "AB", "AA", "x & y", "", "", '"', "plain"]


@pytest.mark.parametrize("query", [resolution_queries.whole_block_score])
def test_names_are_parsed_once_for_candidates_and_blocks(inputs, query, monkeypatch):
    made, records = [], resolution_queries.records
    monkeypatch.setattr(resolution_queries, "records", lambda i: made.append(1) or records(i))
    query(inputs)
    assert len(made) == 1


def test_a_merged_store_is_written_before_it_is_finished(spark):
    items = spark.createDataFrame([("a", None, "n", "m", "", 1), ("b", None, "n", "m", "", 2)], "entity_key string, canonical_id string, name string, model_no string, image_url string, ordinal long")
    offers = spark.createDataFrame([("a", "A", 5, "", "n")], "entity_key string, shop_id string, latest_price long, image_url string, source_name string")
    log = spark.sql("SELECT 'a' AS entity_key, shop_id, DATE '2024-01-01' AS date, 5L AS price FROM VALUES ('A'), ('*') AS t(shop_id)")
    shops = spark.createDataFrame([("A", "Shop A", 0, True)], "shop_id string, shop_name string, ordinal int, enabled boolean")
    done = merge.finish_store(merge.Store(items, items.select("entity_key", F.lit("x").alias("alias_key")), offers, log), shops)
    assert [r["entity_key"] for r in done.items.collect()] == ["a"] and done.history.count() == 2
    assert done.offers.inputFiles() and done.history.inputFiles()


def test_a_snapshot_is_written_before_it_is_ordered(spark):
    rows = spark.createDataFrame([("OP01-002", 1, "b"), ("OP01-002", 0, "a"), ("OP01-001", 3, "c")], "card_number string, variant_index int, variant_key string")
    out = catalog.catalog_snapshot(rows.limit(2), rows.filter("variant_index = 3"))
    assert [r["variant_key"] for r in out.collect()][0] == "c" and out.inputFiles()
