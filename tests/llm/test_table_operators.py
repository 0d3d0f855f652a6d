"""Mixing, nearest neighbours, Jaccard join, line spread, licences and the pipeline: brute force and odd input."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from offerlens.llm import block_knn, licence_scan, line_spread, minhash_join, mixing, queries
from offerlens.llm.components import components
from offerlens.llm.grams import gram_hashes, gram_set, normalised

from . import cases

SF = "/root/testdata/sf0.001"


def test_gram_hashes_tell_runs_apart():
    words = "a b c d e f g a b c d e".split()
    joined, n = normalised(" a b\tc d\ne f g  a b c d e ".encode())
    found = gram_hashes(joined, n, 5).tolist()
    runs = [tuple(words[k : k + 5]) for k in range(8)]
    assert [found.index(h) for h in found] == [runs.index(r) for r in runs]
    assert len(gram_set(b"", 5)) == 0 and len(gram_set(b"one two", 5)) == 1 and gram_set(b"one two", 5) == gram_set(b" one  two", 5)


def test_components_by_union(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1_000, 1_060)] + [(None, 1), (5, None)]
    label = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    group = {n: {n} for e in edges if None not in e for n in e}
    for a, b in edges:
        if None not in (a, b) and group[a] is not group[b]:
            group[a] |= group[b]
            for n in group[b]:
                group[n] = group[a]
    assert label == {n: min(g) for n, g in group.items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_groups(texts, size=5, threshold=0.8):
    """class_id and n_links of (id, text) rows."""
    def grams(text):
        words = (text or "").encode().split()
        return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()

    sets = [grams(t) for _, t in texts]
    parent, links = list(range(len(texts))), [0] * len(texts)

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            parent[root(b)] = root(a)
    lowest = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            lowest[root(k)] = min(lowest.get(root(k), i), i)
    return sorted((i, (lowest.get(root(k)) if sets[k] else i), links[k]) for k, (i, _) in enumerate(texts) if i is not None)


def near_copies(rng, groups=6, copies=12):
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([60, 120, 400]))]
        for _ in range(copies):
            made = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                made[rng.randrange(len(made))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(made[: len(made) - rng.choice([0, 0, 5, 12])]))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_groups_by_brute_force(spark, monkeypatch, small):
    if small:  # many blocks per bucket
        monkeypatch.setattr(minhash_join, "TILE_ROWS", 3)
        monkeypatch.setattr(minhash_join, "TILE_GRAMS", 500)
    texts = list(enumerate([*near_copies(random.Random(8)), None, "", " ", "one", "one", "a b c", "a b c", "a b d"]))
    out = minhash_join.jaccard_groups(spark.createDataFrame(texts, "doc_id long, text string"), recall=0.99999)
    assert sorted((r["row_id"], r["class_id"], r["n_links"]) for r in out.collect()) == brute_groups(texts)


def test_jaccard_odd_input(spark):
    documents = cases.documents(spark)
    out = {r["row_id"]: r for r in minhash_join.jaccard_groups(documents).collect()}
    assert minhash_join.jaccard_groups(documents).count() == len(cases.rows())
    assert out[2]["class_id"] == 1 and out[3]["class_id"] == 1 and out[9]["class_id"] == 8 and out[10]["n_links"] == 1 and out[4]["class_id"] == 4 and out[4]["n_links"] == 0
    kept = minhash_join.one_per_group(documents)
    assert kept.columns == documents.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 8, 10, 11]
    assert minhash_join.one_per_group(cases.empty(spark)).count() == 0
    same = spark.createDataFrame([(1, "p q r s t u"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted(r["text"] for r in minhash_join.one_per_group(same).collect()) == ["a b c d e f", "p q r s t u"]


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9995), (0.5, 0.9), (0.9, 0.999), (1.0, 0.9)):
        bands, rows = minhash_join.bands_and_rows(threshold, recall)
        assert bands * rows <= minhash_join.MOST_HASHES and 1 - (1 - threshold**rows) ** bands >= recall
    with pytest.raises(ValueError):
        minhash_join.bands_and_rows(0.01, 0.999999)


def test_jaccard_query(spark):
    texts = [(r["doc_id"], r["text"]) for r in queries.table(spark, SF, "documents").collect()]
    rows = queries.QUERIES["op9_minhash_join"](spark, SF).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in rows) == brute_groups(texts)


def brute_nearest(rows, k):
    out = []
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    for q in {i for i, _ in usable if i % 3 == 0}:
        best = {}
        for i, v in usable:
            for j, w in usable:
                if i == q and j != q and len(v) == len(w):
                    score = float(np.dot(np.float64(v), np.float64(w)))
                    best[j] = max(best.get(j, score), score)
        out += [(q, rank, j) for rank, j in enumerate(sorted(best, key=lambda j: (-best[j], j))[:k], 1)]
    return sorted(out)


def test_nearest_by_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.integers(-3, 4, 6).astype(float).tolist()) for k in range(90)]
    rows += [(k, [1.0, 2.0, 0.0, 1.0, 0.0, 1.0]) for k in range(90, 130)] + [(200, None), (201, []), (202, [0.0] * 6), (203, [float("nan")] * 6), (204, [None, 1.0, 1.0, 1.0, 1.0, 1.0])]
    rows += [(None, [1.0] * 6), (206, [float("inf")] * 6), (207, [1.0, 2.0]), (210, [2.0, 1.0]), (3, rows[3][1]), (6, [1.0] * 6)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, id int, v string")
    out = block_knn.nearest(frame, F.col("vec_id") % 3 == 0, k=7, query_block=10, row_block=16).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in out) == brute_nearest(rows, 7)
    assert block_knn.nearest(frame.limit(0), F.col("vec_id") % 3 == 0).count() == 0


def test_rounding_bound_holds():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 16)) * np.exp(rng.standard_normal((40, 1)) * 3)
    codes, scale, length, error = block_knn._rounded(x)
    rounded = codes * scale[:, None]
    assert (np.abs(x @ x.T - rounded @ rounded.T) <= error[:, None] * (length + error) + length[:, None] * error + 1e-9).all()


def test_line_spread_odd_input(spark):
    rows = [(k, f"Home page\nbody {k} of the page\n  Home page \nLog in", None, f"s{k % 5}", 1, *[None] * 7) for k in range(10)]
    rows += [(20, "Log in", None, None, 1, *[None] * 7), (21, None, None, "s1", 1, *[None] * 7), (None, "Log in\nrest", None, "s2", 1, *[None] * 7), (22, "", None, "s2", 1, *[None] * 7), (22, "Log in\n" + cases.LONG, None, "s2", 1, *[None] * 7)]
    documents = cases.documents(spark, rows)
    out = line_spread.remove_boilerplate(documents, min_sites=5)
    assert set(out.columns) == set(documents.columns) | {"n_removed"} and out.count() == len(rows)
    found = defaultdict(list)
    for r in out.collect():
        found[r["doc_id"]].append((r["text"], r["n_lines"], r["n_removed"], r["struck"]))
    assert found[0] == [(rows[0][1], 4, 0, None)] and found[3] == [("body 3 of the page", 4, 3, None)]
    assert found[20] == [("", 1, 1, None)] and found[21] == [(None, 0, 0, None)] and found[None] == [("rest", 2, 1, None)]
    assert sorted(found[22], key=lambda r: r[1]) == [("", 1, 0, None), (cases.LONG, 2, 1, None)]
    assert line_spread.remove_boilerplate(documents, min_sites=6).filter("n_removed > 0").count() == 0
    assert line_spread.remove_boilerplate(cases.empty(spark)).count() == 0


def test_long_lines_in_the_pipeline(spark):
    notice = " ".join(f"word{k} of the notice" for k in range(20))
    documents = cases.documents(spark, [(k, f"body {k} of the page\n{notice}", None, f"s{k}", 1, *[None] * 7) for k in range(8)])
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.without_boilerplate(spark, documents, SF).collect()}
    assert out == {k: f"body {k} of the page" + (f"\n{notice}" if k == 0 else "") for k in range(8)}


def test_spread_near_the_threshold_is_exact(spark):
    lines = spark.range(120).select(F.explode(F.sequence(F.lit(0), F.col("id"))).alias("site"), F.col("id").alias("k1"), F.lit(0).alias("k2"), F.lit(1).alias("row_id"))
    for least in (3, 60, 110):
        found = {r["k1"] for r in line_spread.boilerplate(lines.withColumn("site", F.col("site").cast("string")), least).collect()}
        assert found == set(range(least - 1, 120))


def test_mix_meets_its_targets(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(["w"] * min(2_000, int(rng.paretovariate(1) * 20))), f"s{min(rng.randrange(9), rng.randrange(9))}") for k in range(3_000)]
    plan = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in plan:
        assert 0 <= r["copies"] <= 3 and r["size"] == len(rows[r["row_id"]][1].split())
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    weights = dict(zip(sorted(sizes), itertools.cycle((5, 2, 1)), strict=False))
    wanted, free = {}, set(sizes)
    while True:  # stop the sources above three times their size, share the rest again
        level = (sum(sizes.values()) - sum(wanted.values())) / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 3 * sizes[s]}
        if not over:
            break
        wanted |= {s: 3 * sizes[s] for s in over}
        free -= over
    for s in sizes:
        assert target[s] == pytest.approx(wanted.get(s, level * weights[s])) and abs(taken[s] - target[s]) <= max(0.01 * target[s], 40)
    rates = {(r["source"], r["size"]): r["rate"] for r in plan}
    for s in sizes:  # log rates are in proportion to size
        slopes = [np.log(rates[(s, n)]) / n for (t, n) in rates if t == s and n and 0 < rates[(s, n)] < 3]
        assert np.allclose(slopes, slopes[0])


def test_mix_odd_input(spark):
    documents = cases.documents(spark)
    first, again = mixing.mixed(documents), mixing.mixed(documents)
    assert first.columns == documents.columns and sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
    plan = mixing.plan(documents)
    assert plan.agg(F.sum("repeats")).first()[0] == len(cases.rows()) and plan.filter("size = 0 AND copies <> 1").count() == 0
    assert mixing.plan(cases.empty(spark)).count() == 0 and mixing.plan(documents.filter("doc_id IN (4, 5)")).filter("target <> 0").count() == 0


def test_licences(spark):
    templates = licence_scan.TEMPLATES
    text = f"A long title of the file that follows here\n{templates['MIT/notice']}\n\n(c) 2020\n" + templates["MIT/grant"].replace("Software without", "Software\nwithout") + "\n\n" + "body text of the file " * 30
    rows = [(1, text), (2, None), (3, ""), (4, "all rights, reserved"), (4, "all rights, reserved"), (5, cases.LONG), (6, "MIT License released under the"), (7, "rights")]
    documents = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, unit int, template int")
    out = sorted(tuple(r)[:4] for r in licence_scan.scan(documents).collect())
    assert out == [(1, -2, "MIT", "MIT/grant"), (1, 2, "MIT", "MIT/notice"), *[(4, 1, "all-rights-reserved", "all-rights-reserved/notice")] * 2]
    assert licence_scan.scan(documents.limit(0)).count() == 0
    (row,) = licence_scan.scan(spark.createDataFrame([(1, "a b a b c")], "doc_id long, text string"), templates={"x/1": "a b a b d"}, least=0.5).collect()
    assert row["dice"] == 0.75


def test_pipeline_stages(spark, tmp_path):
    docs = queries.table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        if name == "quality classifier":
            lost = queries.table(spark, SF, "documents").join(docs, "doc_id", "left_anti").join(queries.table(spark, SF, "labels"), "doc_id")
            assert docs.count() < before and lost.filter("quality = 1").count() <= 2
        if name == "n-gram Jaccard join":
            texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert not any(n for _, _, n in brute_groups(texts))
        if number < 4:
            assert docs.columns == columns
    assert docs.filter("NOT exact").count() == 0 and docs.filter("n_tokens > 0").count() > 0


def test_pipeline_odd_input(spark, tmp_path):
    documents = cases.documents(spark)
    spark.createDataFrame([(1, 1), (7, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for kind, docs in (("odd", documents), ("empty", cases.empty(spark))):
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{kind}{number}"))
            docs = spark.read.parquet(str(tmp_path / f"{kind}{number}"))
            assert number == 4 or docs.columns == documents.columns
        assert docs.filter("NOT exact").count() == 0 and (docs.count() > 0) == (kind == "odd")


def test_lines_of_any_length_are_judged(spark):
    long_line = " ".join(f"term{k}" for k in range(60))
    docs = spark.createDataFrame([(k, f"own text {k}\n{long_line}", f"site{k % 9}") for k in range(18)], "doc_id long, text string, source string")
    out = {r["doc_id"]: r["text"] for r in line_spread.remove_boilerplate(docs).collect()}
    assert out[0].endswith(long_line) and all(out[k] == f"own text {k}" for k in range(1, 18))
    bounded = line_spread.remove_boilerplate(docs, max_words=20).collect()
    assert all(long_line in r["text"] for r in bounded)
