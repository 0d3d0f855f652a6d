import datetime as dt
import random

from pyspark.sql import functions as F

from offerlens.operators import health, history, merge
from offerlens.streaming import change_log

OBS = "entity_key long, shop_id string, obs_date date, obs_seq long, price long"
DAY = dt.date(2024, 3, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def replay(observations, start=()):
    """The log by going through the observations one by one."""
    logs = {}
    for key, shop, date, price in start:
        logs.setdefault((key, shop), []).append([date, price])
    for key, shop, date, _, price in sorted(observations, key=lambda r: r[3]):
        log = logs.setdefault((key, shop), [])
        if log and log[-1][0] == date:
            log[-1][1] = price
        elif not log or log[-1][1] != price:
            log.append([date, price])
    return {(k, s, d, p) for (k, s), log in logs.items() for d, p in log}


def random_observations(seed, n=400):
    rng, rows, date = random.Random(seed), [], 0
    for seq in range(n):
        date += rng.random() < 0.1
        rows.append((rng.randrange(4), rng.choice("ab"), day(date), seq, rng.choice([100, 100, 200, 300])))
    return rows


def as_set(df):
    return {tuple(r) for r in df.select("entity_key", "shop_id", "date", "price").collect()}


def test_closed_form_equals_replay(spark):
    for seed in range(3):
        rows = random_observations(seed)
        assert as_set(history.to_change_log(spark.createDataFrame(rows, OBS))) == replay(rows)


def test_log_extended_in_steps_equals_whole(spark):
    rows = random_observations(7)
    log = history.to_change_log(spark.createDataFrame(rows[:150], OBS))
    for part in (rows[150:151], rows[151:300], rows[300:]):
        log, late = history.extend_change_log(log, spark.createDataFrame(part, OBS))
        log = spark.createDataFrame(log.collect(), log.schema)
        assert late.isEmpty()
    assert as_set(log) == replay(rows)


def test_stream_in_parts_with_late_rows(spark, tmp_path):
    rows = random_observations(11, 300)
    state = str(tmp_path / "state")
    for batch, part in enumerate((rows[:100], rows[100:130], rows[130:], [(0, "a", day(-5), 999, 1)])):
        change_log.process_batch(spark.createDataFrame(part, OBS), batch, state, compact_every=2)
    # A repeated batch changes nothing.
    change_log.process_batch(spark.createDataFrame(rows[130:], OBS), 2, state, compact_every=2)
    assert as_set(change_log.read_change_log(spark, state)) == replay(rows)
    assert change_log.read_late(spark, state).count() == 1


def test_trend_rules(spark):
    log = spark.createDataFrame([
        (1, "a", day(0), 1000), (1, "a", day(5), 1200), (1, "a", day(10), 1500),  # rises on the latest date
        (2, "a", day(0), 100), (2, "a", day(1), 300),  # stopped long ago
        (3, "a", day(10), 700),  # single entry
    ], "entity_key long, shop_id string, date date, price long")
    offers = spark.createDataFrame([(1, "a", 1500), (2, "a", 300), (3, "a", 700), (4, "a", 5)], "entity_key long, shop_id string, latest_price long")
    got = {r["entity_key"]: r for r in history.summarize_offers(log, offers).collect()}
    assert (got[1]["day_diff"], got[1]["day_pct"]) == (300, 25.0)
    assert (got[1]["week_diff"], got[1]["week_pct"]) == (500, 50.0)
    assert [got[2][c] for c in ("day_diff", "week_diff", "min_price", "max_price")] == [0, 0, 100, 300]
    assert (got[3]["day_diff"], got[3]["week_diff"]) == (0, 0)
    assert (got[4]["min_price"], got[4]["last_date"]) == (0, None)


def test_upsert_keeps_unseen_and_first_texts(spark):
    items = spark.createDataFrame([(1, "Kept", "", "")], "entity_key long, name string, model_no string, image_url string")
    offers = spark.createDataFrame([(1, "a", 100, "old.png", "s"), (1, "b", 50, "", "t")], "entity_key long, shop_id string, latest_price long, image_url string, source_name string")
    log = spark.createDataFrame([(1, "a", day(0), 100), (1, "b", day(0), 50)], "entity_key long, shop_id string, date date, price long")
    batch = spark.createDataFrame([
        (1, "a", day(2), 1, 120, "New", "M1", ""), (2, "a", day(2), 2, 10, "", "M2", "x.png"), (2, "a", day(2), 3, 20, "Two", "M3", "")],
        OBS + ", name string, model_no string, image_url string")
    new_items, new_offers, new_log, late = merge.upsert_observations(items, offers, log, batch)
    assert {tuple(r) for r in new_items.collect()} == {(1, "Kept", "M1", ""), (2, "Two", "M2", "x.png")}
    got = {(r["entity_key"], r["shop_id"]): (r["latest_price"], r["image_url"], r["source_name"]) for r in new_offers.collect()}
    assert got == {(1, "a"): (120, "old.png", "New"), (1, "b"): (50, "", "t"), (2, "a"): (20, "x.png", "Two")}
    assert as_set(new_log) == {(1, "a", day(0), 100), (1, "a", day(2), 120), (1, "b", day(0), 50), (2, "a", day(2), 20)}
    assert late.isEmpty()


def test_health_thresholds(spark):
    shops = spark.createDataFrame([(s, s.upper(), k, True) for k, s in enumerate("abcd")], "shop_id string, shop_name string, ordinal int, enabled boolean")
    stored = [(n, "a") for n in range(19)] + [(n, "b") for n in range(20)] + [(n, "c") for n in range(20)]
    batch = [(n, "b") for n in range(10)] + [(n, "c") for n in range(9)]
    schema = "entity_key long, shop_id string"
    report = health.source_health(shops, spark.createDataFrame(batch, schema), spark.createDataFrame(stored, schema))
    assert {r["shop_id"]: r["healthy"] for r in report.collect()} == {"a": True, "b": True, "c": False, "d": True}
    assert [r["shop_id"] for r in health.run_exclusions(report).collect()] == ["c"]
    health.assert_run_gate(report)
    try:
        health.assert_healthy(report)
        raise AssertionError("unhealthy source not reported")
    except health.UnhealthySources:
        pass


def test_merge_precedence_equals_fold(spark):
    """N records of a shop merged pairwise: the record with the newer last date overrides, ties go to the later."""
    rng = random.Random(3)
    for _ in range(3):
        records = [(k, [(day(rng.randrange(6)), rng.randrange(90)) for _ in range(3)]) for k in range(8)]
        acc = None
        for _, entries in records:
            log = dict(sorted(dict(entries).items()))
            if acc is None:
                acc = log
                continue
            acc = {**acc, **log} if max(acc) <= max(log) else {**log, **acc}
        items = spark.createDataFrame([(f"i{k}", None, "n", "m", "", k) for k, _ in records], "entity_key string, canonical_id string, name string, model_no string, image_url string, ordinal long")
        offers = spark.createDataFrame([(f"i{k}", "a", k, "") for k, _ in records], "entity_key string, shop_id string, latest_price long, image_url string")
        log = spark.createDataFrame([(f"i{k}", "a", d, p) for k, entries in records for d, p in dict(entries).items()], "entity_key string, shop_id string, date date, price long")
        key_map = items.select("entity_key", F.lit("one").alias("new_key"), "ordinal")
        out = merge.merge_store(merge.Store(items, spark.createDataFrame([], "entity_key string, alias_key string"), offers, log), key_map)
        assert {(r["date"], r["price"]) for r in out.history.collect()} == set(acc.items())
        ranks = merge.precedence(spark.createDataFrame([("g", k, max(d for d, _ in e)) for k, e in records], "g string, ordinal long, last_date date"), ["g"], block=3)
        order = [r["ordinal"] for r in ranks.orderBy("rank").collect()]
        assert len(order) == 8


def test_late_rows_merged_in_steps(spark, tmp_path):
    """Deliveries in any order: after merging, the log is that of all rows, also when steps are repeated."""
    rng = random.Random(17)
    rows = random_observations(13, 400)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    state = str(tmp_path / "state")
    parts = [shuffled[k::6] for k in range(6)]
    for batch, part in enumerate(parts):
        for _ in range(1 + (batch == 3)):
            change_log.process_batch(spark.createDataFrame(part, OBS), batch, state, compact_every=2, buckets=4)
            if batch in (1, 3, 5):
                change_log.merge_late(spark, state, batch, since=max(0, batch - 1), compact_every=2, buckets=4)
    want = as_set(history.to_change_log(spark.createDataFrame(rows, OBS)))
    assert as_set(change_log.read_change_log(spark, state)) == want
    assert change_log.read_late(spark, state).count() > 0


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    state = str(tmp_path / "state")
    change_log.process_batch(spark.createDataFrame(random_observations(2), OBS), 0, state, compact_every=4, buckets=16)
    days = change_log._parts(spark, f"{state}/days", 2, change_log.DAYS, 4, [3])
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]


def test_merge_late_equals_all_rows(spark):
    rng = random.Random(5)
    rows = random_observations(21, 300)
    rng.shuffle(rows)
    first, later = spark.createDataFrame(rows[:200], OBS), spark.createDataFrame(rows[200:], OBS)
    log, days = history.merge_late(history.to_change_log(first), history.day_rows(first), later)
    assert as_set(log) == as_set(history.to_change_log(spark.createDataFrame(rows, OBS)))
    assert {tuple(r) for r in days.collect()} == {tuple(r) for r in history.day_rows(spark.createDataFrame(rows, OBS)).collect()}


def test_an_entry_disappears_with_a_late_price(spark):
    first = spark.createDataFrame([(1, "a", day(0), 0, 100), (1, "a", day(4), 1, 200)], OBS)
    late = spark.createDataFrame([(1, "a", day(2), 2, 200)], OBS)
    log, _ = history.merge_late(history.to_change_log(first), history.day_rows(first), late)
    assert as_set(log) == {(1, "a", day(0), 100), (1, "a", day(2), 200)}


def test_an_offer_is_not_renewed_by_an_older_listing(spark):
    items = spark.createDataFrame([(1, "n", "m", "")], "entity_key long, name string, model_no string, image_url string")
    offers = spark.createDataFrame([(1, "a", 200, "i.png")], "entity_key long, shop_id string, latest_price long, image_url string")
    first = spark.createDataFrame([(1, "a", day(3), 0, 200)], OBS)
    batch = spark.createDataFrame([(1, "a", day(1), 9, 100, "old", "m", "o.png"), (1, "b", day(1), 10, 70, "b", "m", "")], OBS + ", name string, model_no string, image_url string")
    _, current, log, days = merge.upsert_observations_of_any_age(items, offers, history.to_change_log(first), history.day_rows(first), batch)
    assert {(r["shop_id"], r["latest_price"], r["image_url"]) for r in current.collect()} == {("a", 200, "i.png"), ("b", 70, "")}
    assert as_set(log) == {(1, "a", day(1), 100), (1, "a", day(3), 200), (1, "b", day(1), 70)} and days.count() == 3
