import random
import re

from pyspark.sql import functions as F

from offerlens.operators import listing_filters as lf
from offerlens.operators import search


def docs_of(spark, rows):
    return search.build_search_docs(spark.createDataFrame(rows, "entity_key long, values array<string>"))


def matches(spark, docs, text, **options):
    saved = spark.createDataFrame([(1, text)], "query_id long, query string")
    return {r["entity_key"] for r in search.match_queries(docs, search.parse_queries(saved), saved, **options).collect()}


def test_folding_phrases_exclusions_and_modes(spark):
    docs = docs_of(spark, [(1, ["キャット・Ｄ・フィル", "OP01-001"]), (2, ["クロネコ ヤマ", "OP01-002"]), (3, ["x"])])
    assert matches(spark, docs, "ふぃる") == {1}
    assert matches(spark, docs, "キャットD") == {1}
    assert matches(spark, docs, '"クロネコ　ヤマ" op01002') == {2}
    assert matches(spark, docs, "ふぃる ヤマ") == set()
    assert matches(spark, docs, "ふぃる ヤマ", mode="OR") == {1, 2}
    assert matches(spark, docs, "op01 -ヤマ") == {1}
    assert matches(spark, docs, "－ヤマ") == {1, 3}
    assert matches(spark, docs, " ・ ") == {1, 2, 3}
    assert matches(spark, docs, "x") == {3}
    assert matches(spark, docs, "キャッド") == set()
    assert matches(spark, docs, "キャッド", fuzzy=True) == {1}
    assert matches(spark, docs, "キャッド -フイル", fuzzy=True) == {1}  # exclusions are never fuzzy


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    def word():
        return "".join(rng.choice("ABé") for _ in range(rng.randrange(1, 13)))

    vocabulary, tokens = {word() for _ in range(250)}, {word() for _ in range(60)}
    got = {(r["compact"], r["term"], r["distance"]) for r in search.fuzzy_terms(
        spark.createDataFrame([(w,) for w in vocabulary], "term string"), spark.createDataFrame([(w,) for w in tokens], "compact string")).collect()}
    want = set()
    for t in tokens:
        k = 0 if len(t) <= 2 else 1 if len(t) <= 4 else 2 if len(t) <= 8 else 3
        want |= {(t, v, distance(t, v)) for v in vocabulary if k and distance(t, v) <= k}
    assert got == want


def test_sort_orders_and_page(spark):
    rows = spark.createDataFrame([(1, 5, "b"), (2, 9, "a"), (3, 5, "c")], "entity_key long, active_price long, model_no string")
    assert [r["entity_key"] for r in lf.sort_listing(rows, "priceDesc").collect()] == [2, 1, 3]
    assert [r["entity_key"] for r in lf.sort_listing(rows, "modelAsc").collect()] == [2, 1, 3]
    page = lf.page(rows, "priceAsc", 2).orderBy("position").collect()
    assert [(r["entity_key"], r["position"], r["total"]) for r in page] == [(1, 1, 3), (3, 2, 3)]


def test_series_prefix_quirk(spark):
    df = spark.createDataFrame([("P-001", ""), ("PRB01-001", ""), ("", "x OP01-001!"), ("XOP01-001", "")], "model_no string, name string")
    got = df.select(lf.series_of(F.col("model_no"), F.col("name")).alias("s")).select(
        "s", lf.series_filter(F.col("s"), "P-").alias("prefix"), lf.series_filter(F.col("s"), "P-", exact=True).alias("exact")).collect()
    assert [tuple(r) for r in got] == [("P", True, True), ("PRB01", True, False), ("OP01", False, False), ("", False, False)]


def _frames(spark):
    rows = [(1, "RED GEAR", "red"), (2, "BLUE RING", "blue"), (3, "RED RING", "red")]
    docs = search.build_search_docs(spark.createDataFrame(rows, "entity_key long, name string, model_no string").selectExpr("entity_key", "array(name, model_no) AS values"))
    saved = spark.createDataFrame([(1, "red gear"), (2, "red -ring"), (3, "-gear"), (4, "blu ring")], "query_id long, query string")
    return docs, saved


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_are_folded_once(spark):
    docs, saved = _frames(spark)
    found = search.match_queries(docs, search.parse_queries(saved), saved)
    assert "PythonUDF" not in _plan(found) and "ArrowEvalPython" not in _plan(found)
    assert {tuple(r) for r in found.select("query_id", "entity_key").collect()} == {(1, 1), (2, 1), (3, 2), (3, 3), (4, 2)}


def test_any_judges_each_document_where_its_hits_are(spark):
    docs, saved = _frames(spark)
    found = search.match_queries(docs, search.parse_queries(saved), saved, mode="OR")
    assert re.search(r"keys=\[entity_key#\d+L?, query_id#\d+L?\]", _plan(found))
    assert {tuple(r) for r in found.select("query_id", "entity_key").collect()} == {(1, 1), (1, 3), (2, 1), (3, 2), (3, 3), (4, 2), (4, 3)}


def test_fuzzy_test_of_pairs_measures_within_the_limit(spark):
    docs, saved = _frames(spark)
    found = search.match_queries(docs, search.parse_queries(saved), saved, fuzzy=True)
    analyzed = found._jdf.queryExecution().analyzed().toString()
    assert "levenshtein(" in analyzed and ") >= 0)" in analyzed
    assert (1, 1) in {tuple(r) for r in found.select("query_id", "entity_key").collect()}
