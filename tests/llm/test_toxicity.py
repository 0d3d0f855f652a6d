"""Toxicity: features and ratios against plain loops, held-out accuracy, odd rows."""

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from offerlens.llm import toxicity

from . import cases

CALM = "river stone garden window paper morning letter bridge summer forest music kitchen lantern harbour ribbon valley".split()
RUDE = ["blockhead", "nitwit", "dunderhead"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        rude = i % 5 == 0
        words = [rng.choice(CALM) for _ in range(rng.choice([8, 40, 400]))]
        for _ in range(rng.choice([1, 3]) if rude else 0):
            words.insert(rng.randrange(len(words)), rng.choice(RUDE))
        out.append((i, " ".join(words), int(rude)))
    return out


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", "mine") for i, t, _ in rows], "doc_id long, text string, lang string, source string, label string")
    return docs, spark.createDataFrame([(i, k, 0) for i, _, k in rows], "doc_id long, toxic int, quality int")


def learnable():
    return F.crc32(F.col("row_id").cast("string")) % 5 != 0


def test_slots_are_those_of_all_n_grams():
    def plain(text):
        bare = " ".join(text.lower().split())
        s, out = f" {bare} " if bare else "", set()
        for n in toxicity.SIZES:
            for k in range(len(s) - n + 1):
                code = 0
                for c in s[k : k + n]:
                    code = (code + ord(c)) * 0x9E3779B1 & 0xFFFFFFFF
                    code ^= code >> 15
                out.add((code * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - toxicity.BITS))
        return sorted(out)

    for text in ["", "a", "Ab", "  One\n two\tTHREE ", "naïve 東京 \U0001f600", " ".join(f"w{i}" for i in range(9_000))]:
        assert toxicity.slots(text).tolist() == plain(text)
        wanted = np.zeros(toxicity.SLOTS, bool)
        wanted[::3] = True
        assert toxicity.slots(text, wanted).tolist() == [s for s in plain(text) if s % 3 == 0]


def test_counts_cover_all_labelled_texts(spark):
    rows = corpus(60)
    docs, labels = tables(spark, rows)
    got = {r["slot"]: (r["ones"], r["noughts"]) for r in toxicity.slot_counts(docs.join(labels, "doc_id").selectExpr("doc_id AS row_id", "toxic AS label", "text")).collect()}
    want = {-1: [0, 0]}
    for _, text, kind in rows:
        for s in [-1, *toxicity.slots(text).tolist()]:
            want.setdefault(s, [0, 0])[1 - kind] += 1
    assert got == {s: tuple(v) for s, v in want.items()}


def test_ratio_is_drawn_towards_nought():
    ratio = toxicity.log_ratio(np.array([0, 9, 1]), np.array([0, 0, 3]), 10, 30, 1.0)
    full = math.log(10 / 12) - math.log(1 / 32)
    assert abs(ratio[1] - (full - math.sqrt(1 / 10 + 1))) < 1e-12
    assert ratio[2] == 0 and ratio[0] == 0


def test_minimum_of_a_known_function():
    target = np.array([3.0, -1.0, 0.5])
    heft = np.array([1.0, 10.0, 100.0])
    x = toxicity.minimise(lambda v: (float(heft @ (v - target) ** 2), 2 * heft * (v - target)), np.zeros(3))
    assert np.abs(x - target).max() < 1e-3


def test_held_out_rows(spark):
    rows = corpus(900)
    docs, labels = tables(spark, rows)
    got = toxicity.score(docs, toxicity.train(docs, labels, learnable())).select("doc_id", "score", "label").collect()
    kind = {i: k for i, _, k in rows}
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(got) == 900 and len(held) > 100 and {r["label"] for r in got} == {"mine"}
    assert all((r["score"] >= 0.5) == bool(kind[r["doc_id"]]) for r in held)


def test_held_out_labels_are_never_read(spark):
    rows = corpus(300)
    docs, labels = tables(spark, rows)
    lies = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, other = (toxicity.train(docs, given, learnable()) for given in (labels, lies))
    assert np.array_equal(one.weight, other.weight) and one.constant == other.constant


def test_odd_rows(spark):
    docs, labels = tables(spark, corpus(200))
    model = toxicity.train(docs, labels)
    got = toxicity.score(cases.documents(spark), model)
    rows = got.collect()
    assert got.columns == [f.name for f in cases.documents(spark).schema if f.name != "score"] + ["score"] and len(rows) == len(cases.rows())
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not (r["text"] or "").strip()}) == 1
    assert toxicity.score(cases.empty(spark), model).count() == 0


def test_labels_of_one_kind_or_none(spark):
    docs, labels = tables(spark, corpus(20))
    for given, want in ((labels.filter("toxic = 1"), 1.0), (labels.filter("toxic = 0"), 0.0), (labels.limit(0), 0.5), (labels.withColumn("toxic", F.lit(None).cast("int")), 0.5)):
        assert {round(r["score"], 6) for r in toxicity.score(docs, toxicity.train(docs, given)).collect()} == {want}
    assert toxicity.score(docs, toxicity.train(docs.limit(0), labels)).first()["score"] == 0.5
