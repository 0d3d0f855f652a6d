"""Provisional images in long chains, valuation intervals and paging against plain loops."""

import datetime as dt
import random

from pyspark.sql import functions as F

from offerlens.functions.components import connected_components
from offerlens.operators import catalog, portfolio
from offerlens.operators import listing_filters as lf

DAY = dt.date(2024, 3, 1)


def one_by_one(rows):
    accepted, taken = set(), set()
    by_row = {}
    for number, seq, image in rows:
        by_row.setdefault((number, seq), set()).add(image)
    for (number, seq), images in sorted(by_row.items()):
        if not any((number, x) in taken for x in images):
            accepted.add((number, seq))
            taken |= {(number, x) for x in images}
    return accepted


def accepted(spark, rows, **options):
    df = spark.createDataFrame(rows, "card_number string, seq long, identity string")
    return {tuple(r) for r in catalog.accept_first_images(df, **options).select("card_number", "seq").collect()}


def test_a_chain_of_ten_thousand_images(spark):
    """Row k shares an image with rows k - 1 and k + 1: every second row is accepted, without a round per row."""
    rows = [("P-001", k, f"i{j}") for k in range(10_000) for j in (k, k + 1)]
    assert accepted(spark, rows) == {("P-001", k) for k in range(0, 10_000, 2)}


def test_random_overlaps_with_and_without_components(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(60), f"i{rng.randrange(70)}") for _ in range(220)]
    assert accepted(spark, rows, rounds=0) == one_by_one(rows) == accepted(spark, rows)
    assert accepted(spark, [("a", 1, "x"), ("a", 1, "x"), ("b", 2, "x")]) == {("a", 1), ("b", 2)}


def test_components_of_paths_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(100, 400)] + [(7, k) for k in range(1000, 1100)] + [(3, 3), (5, 4), (4, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in range(100, 401)} == {100} and {got[k] for k in [7, *range(1000, 1100)]} == {7}
    assert got[3] == 3 and got[4] == got[5] == 4


def test_intervals_hold_the_series(spark):
    rng = random.Random(6)
    log = sorted({(k, rng.randrange(30)) for k in range(6) for _ in range(8)})
    history = spark.createDataFrame([(k, DAY + dt.timedelta(days=d), rng.choice([0, 100, 100, 250])) for k, d in log], "entity_key long, date date, price long")
    holdings = spark.createDataFrame([(o, k, rng.randrange(3)) for o in range(3) for k in range(6)], "owner_id long, entity_key long, qty long")
    intervals = portfolio.valuation_intervals(holdings, history)
    series = portfolio.valuation_series(holdings, history)
    want = {(r["owner_id"], r["date"]): r["value"] for r in series.collect()}
    asked = series.select("owner_id", "date", F.col("value").alias("tag"))
    got = portfolio.valuation_on(intervals, asked).collect()
    assert {(r["owner_id"], r["date"]): r["value"] for r in got} == want and all(r["tag"] == r["value"] for r in got)
    rows = intervals.orderBy("owner_id", "from_date").collect()
    assert len(rows) < len(want)
    for a, b in zip(rows, rows[1:]):
        assert a["owner_id"] != b["owner_id"] or (a["to_date"] == b["from_date"] and a["value"] != b["value"])
    assert portfolio.valuation_on(intervals, spark.createDataFrame([(0, DAY - dt.timedelta(days=9))], "owner_id long, date date")).first()["value"] == 0
    some = portfolio.valuation_series(holdings, history, spark.createDataFrame([(1,)], "owner_id long"))
    assert {(r["owner_id"], r["date"]): r["value"] for r in some.collect()} == {k: v for k, v in want.items() if k[0] == 1}


def test_pages_follow_each_other(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice([None, 5, 9, 9, 12]), rng.choice("abc")) for k in range(95)]
    df = spark.createDataFrame(rows, "entity_key long, active_price long, model_no string")
    for mode in ("priceDesc", "priceAsc", "modelAsc"):
        want = [r["entity_key"] for r in lf.sort_listing(df, mode).collect()]
        pages, shown, page = lf.Pages(df, mode, 30), [], None
        page = pages.first()
        while (key := pages.page_key(page)) is not None:
            got = page.orderBy("position").collect()
            shown += [r["entity_key"] for r in got]
            assert [r["position"] for r in got] == list(range(len(shown) - len(got) + 1, len(shown) + 1)) and {r["total"] for r in got} == {95}
            page = pages.after(key)
        assert shown == want


def test_a_page_reads_its_input_once(spark, tmp_path):
    spark.range(50).selectExpr("id AS entity_key", "id AS active_price", "'m' AS model_no").write.parquet(str(tmp_path / "rows"))
    read = spark.read.parquet(str(tmp_path / "rows"))
    plan = lf.page(read, "priceDesc", 10)._jdf.queryExecution().toString()
    assert str(tmp_path / "rows") not in plan
