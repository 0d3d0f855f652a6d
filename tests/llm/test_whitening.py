"""Whitening against a plain computation, with exact whole numbers."""

import math

import numpy as np
from pyspark.sql import functions as F

from offerlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, weight int, k int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in vectors], SCHEMA)


def plain(vectors, weights=None):
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[float(n * c - s) / n for c, s in zip(row, sums, strict=True)] for row in x])
    covariance = centred.T @ centred / n
    return n, deviation, centred, covariance


def rows_of(spark, vectors, **options):
    return whitening.whiten(table(spark, vectors), **options).collect()


def test_equal_to_a_plain_computation_with_copies(spark):
    rng = np.random.default_rng(3)
    base = (rng.standard_normal((60, 12)) * np.linspace(1, 4, 12)).tolist()
    vectors = [(i, base[0] if i % 3 == 0 else base[i % 60]) for i in range(300)]
    n, deviation, centred, covariance = plain([v for _, v in vectors])
    values, axes = np.linalg.eigh(covariance)
    found = rows_of(spark, vectors)
    assert len(found) == 300 * 8 and {r["n"] for r in found} == {n}
    got = {(r["row_id"], r["component"]): r for r in found}
    for k in range(8):
        want = centred @ axes[:, -1 - k] / np.sqrt(values[-1 - k])
        have = np.array([got[i, k + 1]["whitened"] for i in range(300)])
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < 1e-8
        assert abs(got[0, k + 1]["explained"] - values[-1 - k] / np.trace(covariance)) < 1e-12
    assert all(got[i, 1]["deviation"] == deviation[i] for i in range(300))
    assert max(r["identity_error"] for r in found) < 1e-9


def test_weights_of_one_ignore_copies(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 4)).tolist()
    once = {(r["row_id"], r["component"]): r["whitened"] for r in rows_of(spark, list(enumerate(base)))}
    copies = [*enumerate(base), *((100 + i, base[0]) for i in range(50))]
    found = rows_of(spark, copies, multiplicity=False)
    assert {r["n"] for r in found} == {30} and len(found) == 80 * 4
    for r in found:
        assert abs(abs(r["whitened"]) - abs(once[r["row_id"] if r["row_id"] < 100 else 0, r["component"]])) < 1e-9


def test_unusable_vectors_take_no_part(spark):
    rng = np.random.default_rng(5)
    good = [(i, v) for i, v in enumerate(rng.standard_normal((20, 3)).tolist())]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, math.nan, 2.0]), (104, [math.inf, 0.0, 1.0]), (105, [1.0, 2.0])]
    found = rows_of(spark, good + bad)
    assert {r["row_id"] for r in found} == set(range(20)) and {r["n"] for r in found} == {20} and {r["component"] for r in found} == {1, 2, 3}
    extra = rows_of(spark, [*good, (None, good[0][1]), (0, good[1][1])])
    assert sum(r["row_id"] is None for r in extra) == 3 and sum(r["row_id"] == 0 for r in extra) == 6


def test_no_variance_and_no_rows(spark):
    assert rows_of(spark, []) == []
    assert rows_of(spark, [(1, [0.5, 0.5])]) == []
    assert rows_of(spark, [(i, [0.5, 0.5]) for i in range(5)]) == []
    line = rows_of(spark, [(i, [float(i), 2.0]) for i in range(5)])
    assert {r["component"] for r in line} == {1} and {r["explained"] for r in line} == {1.0}


def test_whole_numbers_beyond_a_long_stay_exact(spark):
    vectors = [(i, [float(i) * 1e13, float(i % 3), 1.0]) for i in range(6)]
    n, deviation, _, _ = plain([v for _, v in vectors])
    found = {r["row_id"]: r["deviation"] for r in rows_of(spark, vectors) if r["component"] == 1}
    assert found == {i: d if d < 1 << 63 else None for i, d in enumerate(deviation)}
    wide = [(i, [float(i) * 1e5, float(i % 3), 1.0]) for i in range(6)]
    exact = plain([v for _, v in wide])[1]
    assert {r["row_id"]: r["deviation"] for r in rows_of(spark, wide) if r["component"] == 1} == dict(enumerate(exact))
    assert max(exact) > 1 << 53
    assert len(rows_of(spark, [(0, [3e38, 1.0]), (1, [1.0, 2.0]), (2, [0.0, -3e38])])) > 0


def test_sums_are_exact_for_large_weights(spark):
    rows = spark.createDataFrame([([(1 << 62) - 1, -5], 1_000_003), ([(1 << 62) - 7, -(1 << 61)], 999_983)], "x array<long>, weight long")
    n, sums = whitening.exact_sums(rows, 2)
    assert n == 1_999_986
    assert sums == [((1 << 62) - 1) * 1_000_003 + ((1 << 62) - 7) * 999_983, -5 * 1_000_003 - (1 << 61) * 999_983]
    assert rows.filter(F.size("x") != 2).count() == 0
