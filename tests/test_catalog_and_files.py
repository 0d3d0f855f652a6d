import json
import random

import pytest
from pyspark.sql import functions as F

from offerlens.operators import catalog as cat
from offerlens.operators import collection as col
from offerlens.operators import portfolio
from offerlens.operators.identity import IdentityRules
from offerlens.sources import details, json_maps, pages, payloads, snapshots

OFFICIAL = "card_number string, variant_index int, source_url string, path string, fallback_path string"


def test_provisional_images_equal_going_one_by_one(spark):
    rng = random.Random(2)
    rows = [(f"OP01-00{rng.randrange(3)}", k, f"p/{rng.randrange(25)}.png", f"http://x/{rng.randrange(25)}.jpg") for k in range(60)]
    official = [("OP01-000", k, f"http://o/{k}.webp", "", "") for k in (0, 2, 3)] + [("OP01-001", 1, "http://o/24.png", "", "")]
    want = []
    for number in sorted({r[0] for r in rows}):
        used = {o[2].split("/")[-1].split(".")[0] for o in official if o[0] == number}
        taken = {o[1] for o in official if o[0] == number}
        primary, index = bool(taken), 1
        for _, seq, path, url in (r for r in rows if r[0] == number):
            images = {path[2:].split(".")[0], url[9:].split(".")[0]}
            if images & used:
                continue
            used |= images
            at = 0
            if primary:
                while index in taken:
                    index += 1
                at, index = index, index + 1
            primary = True
            taken.add(at)
            want.append((number, at, path))
    provisional = spark.createDataFrame([(n, k, "x", p, u, "", "") for n, k, p, u in rows],
                                        "card_number string, seq long, card_name string, image_path string, image_url string, series_title string, get_info string")
    hashes = spark.createDataFrame([], "url string, signature string")
    got = cat.provisional_variants(spark.createDataFrame(official, OFFICIAL), provisional, hashes, IdentityRules())
    assert sorted((r["card_number"], r["variant_index"], r["path"]) for r in got.collect()) == sorted(want)


def violations(spark, *bodies):
    df = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "payload_id long, body string")
    return [r["violation"] for r in col.collection_violations(df).orderBy("payload_id").collect()]


def test_collection_contract(spark):
    item = {"cardNumber": "op01-001", "variantId": "OP01-001_p1", "count": 2}
    def body(item_change=None, **change):
        return json.dumps({"format": "card-collection", "version": 1, "items": [item | (item_change or {})]} | change)

    bad = [("[]", "not an object"), (body(format="x"), "unsupported format"), (body(version=1.5), "version is no whole number"), (body(version=2), "version too new"),
           (body(version=0), "version unsupported"), (body(items={}), "no items list"), (body(items=[3]), "item is no object"), (body({"cardNumber": "x"}), "cardNumber invalid"),
           (body({"variantId": " "}), "variantId missing"), (body({"count": -1}), "count is no whole number of at least 0"), (body({"count": 1.5}), "count is no whole number of at least 0"),
           (body({"id": "z"}), "id does not fit cardNumber and variantId")]
    assert violations(spark, *[b for b, _ in bad]) == [v for _, v in bad]
    good = spark.createDataFrame([(1, body({"id": "OP01-001::OP01-001_p1", "cardName": "n"}))], "payload_id long, body string")
    row = col.collection_items(good).head()
    assert (row["card_number"], row["variant_type"], row["count"], row["id"]) == ("OP01-001", "alternate-art", 2, "OP01-001::OP01-001_p1")


def test_holdings_file_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("o", 'Say "hi", you', "M-1", 5, 2, 10, "u"), ("o", "Line\nbreak", "M-2", 1, 3, 3, "")],
                                 "owner_id string, name string, model_no string, price long, qty long, subtotal long, image_url string")
    portfolio.write_holdings_csv(rows, str(tmp_path / "h"))
    back = portfolio.import_holdings(portfolio.read_holdings_csv(spark, str(tmp_path / "h")))
    assert {(r["entity_key"], r["qty"]) for r in back.collect()} == {('Say "hi", you_M-1', 2), ("Line\nbreak_M-2", 3)}


def test_payload_contract(spark):
    def page(n, body):
        return ("s", n, body)

    record = {"id": 7, "name": "<b>A</b>&amp;B", "extra_difference": "x", "model_number": "M", "amount": 10, "original_image_source": "o", "ocha_product": {"image_source": None}}
    docs = [page(1, json.dumps({"result": True, "last_page": 2, "records": [record, record | {"id": 8, "amount": 0}]})),
            page(2, json.dumps({"result": True, "last_page": 2, "records": [record | {"amount": 20}, record | {"id": None, "name": "N"}]})),
            page(3, json.dumps({"result": True, "last_page": 2, "records": []})), page(4, "{"), page(5, json.dumps({"result": "true", "last_page": 9, "records": []})),
            page(6, json.dumps({"result": True, "last_page": 101, "records": []})), page(7, json.dumps({"result": True, "last_page": 9, "records": {}}))]
    df = spark.createDataFrame(docs, "source_id string, page int, body string")
    assert {(r["name"], r["price"], r["image_url"]) for r in payloads.ingest_paged_json(df, on_violation="skip").collect()} == {("A&B(x)", 20.0, "o"), ("N(x)", 10.0, "o")}
    assert [r["page"] for r in payloads.payload_violations(df).orderBy("page").collect()] == [3, 4, 5, 6, 7]


def test_paused_pages_and_links(spark):
    df = spark.createDataFrame([("s", "http://a.b/c/d?x", "<p>buying is\n<b>paused</b></p>"), ("t", "http://a.b/c/d?x", "<p>open</p>")], "source_id string, url string, body string")
    assert [r["status"] for r in pages.source_status(df, "is paused").orderBy("source_id").collect()] == ["paused", "active"]
    assert [r["source_id"] for r in pages.active_pages(df, "is paused").collect()] == ["t"]
    links = ["/x.png", "x.png", "//c.d/x.png", "https://e/x.png", ""]
    out = spark.createDataFrame([(v,) for v in links], "l string").select(pages.absolute_url(F.col("l"), F.lit("http://a.b/c/d?x")).alias("u")).collect()
    assert [r["u"] for r in out] == ["http://a.b/x.png", "http://a.b/c/x.png", "http://c.d/x.png", "https://e/x.png", ""]


def test_guards_and_optional_inputs(spark, tmp_path):
    with pytest.raises(details.IncompleteDetails):
        details.load_details(spark.createDataFrame([(" ",), ("a",)], "card_number string"), min_rows=2)
    assert snapshots.read_optional(spark, str(tmp_path / "none"), "a long").isEmpty()
    (tmp_path / "m.json").write_text('{"mappings": {"k": "v", "o": {"priceKey": "w", "confirmedBy": "manual"}}}')
    got = json_maps.variant_map(json_maps.read_json_map(spark, str(tmp_path / "m.json"))).orderBy("variant_key").collect()
    assert [tuple(r) for r in got] == [("k", "v", None), ("o", "w", "manual")]
