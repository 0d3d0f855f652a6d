"""Embedding whitening from a covariance weighted by multiplicity.

Each entry c becomes the whole number x = floor(scale * c) + shift. Identical x-vectors are grouped by Spark; a group's fit weight is the number of
its rows (or 1). Sums of x are exact; the covariance is one weighted, centred product per task over distinct vectors, added up by
Spark entry by entry. Its eigenvectors, a problem of the size of one vector's square, are found on the driver. Each distinct vector is whitened once and
joined back to its rows, so copies cost no arithmetic. A vector held by a third of all rows is combined before the shuffle, and the join splits it.

Defined results. Vectors that are null, empty, or hold a null or non-finite entry take no part, nor do vectors whose length differs from
the most common one (of several, the longest). An entry too large for a long gets the nearest one. Whole numbers are never rounded: sums and deviations
are exact, and a deviation that no long can hold is null. Components with an eigenvalue below 1e-12 of the largest have no whitened value and are left out, so equal
vectors, or a single one, give no rows, nor does an empty table. Rows with a null or repeated id are rows like others. Other input columns are not used.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.durable import shared_folder
from offerlens.functions.skew import spread_join

LEAST_VARIANCE = 1e-12
LIMB = 21
ROWS = 2_048
LONG_MAX = (1 << 63) - 1


def whole_numbers(vector: Column, scale: int, shift: int) -> Column:
    """x of every entry; null unless the vector is non-empty and all its entries are finite."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    top = F.lit(float(1 << 62))
    held = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, top), -top)) + shift)
    return F.when((F.size(x) > 0) & finite, held)


def grouped(df: DataFrame, x: str, multiplicity: bool) -> DataFrame:
    """(x, weight): each distinct vector with its fit weight."""
    out = df.groupBy(x).agg(F.count(F.lit(1)).alias("weight"))
    return out if multiplicity else out.withColumn("weight", F.lit(1).cast("long"))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def exact_sums(distinct: DataFrame, dimensions: int) -> tuple[int, list[int]]:
    """Sum of weights and weighted sum of x per dimension, as Python integers.

    An entry is cut into three limbs of LIMB bits, whose weighted sums fit a long for 2^40 rows a task; Spark adds the tasks' sums as decimals.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, low = np.zeros((3, dimensions), np.int64), 0, (1 << LIMB) - 1
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                x, weight = _matrix(part, "x"), part.column(part.schema.get_field_index("weight")).to_numpy()
                n += int(weight.sum())
                for limb, values in enumerate((x >> 2 * LIMB, (x >> LIMB) & low, x & low)):
                    total[limb] += weight @ values
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([*range(dimensions), -1], pa.int32()), *(pa.array([*total[k].tolist(), n if k == 2 else 0], pa.int64()) for k in range(3))], names=["i", "high", "middle", "low"])

    parts = distinct.select("x", "weight").mapInArrow(run, "i int, high long, middle long, low long")
    # One row per dimension.
    rows = parts.groupBy("i").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "middle", "low")]).collect()
    whole = {r["i"]: (int(r["high"]) << 2 * LIMB) + (int(r["middle"]) << LIMB) + int(r["low"]) for r in rows}
    return whole.get(-1, 0), [whole.get(i, 0) for i in range(dimensions)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Entries of x - S / n as doubles, and the exact sum of (n * x - S)^2 per row (Python integers where a long may overflow)."""
    # |n * x - S| is at most n * (max - min); both ways give the same numbers, the second needs no bound.
    reach = max((abs(n * int(v) - s) for end in (x.max(axis=0), x.min(axis=0)) for v, s in zip(end, sums, strict=True)), default=0)
    if reach * reach * len(sums) <= LONG_MAX and n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums)) <= LONG_MAX:
        scaled = x * np.int64(n) - np.array(sums, np.int64)
        return scaled / n, (scaled * scaled).sum(axis=1)
    scaled = x.astype(object) * n - np.array(sums, object)
    return (scaled / n).astype(np.float64), (scaled * scaled).sum(axis=1)


def weighted_products(df: DataFrame, dimensions: int, weight: str, values: str, centre: tuple[int, list[int]] | None = None) -> np.ndarray:
    """Sum over rows of weight * v v' for v = values (less the centre): partial products per task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimensions, dimensions))
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                v = _matrix(part, values)
                v = v if centre is None else centred(v, *centre)[0]
                total += (v * part.column(part.schema.get_field_index(weight)).to_numpy()[:, None]).T @ v
        i, j = np.triu_indices(dimensions)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j], pa.float64())], names=["i", "j", "v"])

    # d * (d + 1) / 2 numbers for vectors of d entries, whatever the number of rows.
    rows = df.select(weight, values).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((dimensions, dimensions))
    for r in rows:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def whiten(
    df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000, multiplicity: bool = True,
) -> DataFrame:
    """(row_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component."""
    spark = df.sparkSession
    id_type = df.schema[row_id].dataType.simpleString()
    folder = f"{shared_folder(spark)}/whitening-{uuid.uuid4().hex}"
    numbers = df.select(F.col(row_id).alias("row_id"), whole_numbers(F.col(vector), scale, shift).alias("x")).filter("x IS NOT NULL")
    # One row: the most common length, the longest of several.
    usual = numbers.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    nothing = spark.createDataFrame([], f"row_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if usual is None:
        return nothing
    d = usual["d"]
    rows = numbers.filter(F.size("x") == d)
    grouped(rows, "x", multiplicity).write.parquet(f"{folder}/distinct")
    distinct = spark.read.parquet(f"{folder}/distinct")
    n, sums = exact_sums(distinct, d)
    covariance = weighted_products(distinct, d, "weight", "x", (n, sums)) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = int((values[:components] > max(values[0], 0) * LEAST_VARIANCE).sum()) if values[0] > 0 else 0
    if not kept:
        return nothing
    turn = vectors[:, :kept] / np.sqrt(values[:kept])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                v, deviation = centred(_matrix(part, "x"), n, sums)
                exact = [q if q <= LONG_MAX else None for q in deviation.tolist()]
                w = v @ turn
                whitened = pa.ListArray.from_arrays(np.arange(0, w.size + 1, kept, dtype=np.int32), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(exact, pa.int64()), whitened], names=["x", "weight", "deviation", "whitened"])

    distinct.select("x", "weight").mapInArrow(project, "x array<long>, weight long, deviation long, whitened array<double>").write.parquet(f"{folder}/whitened")
    whitened = spark.read.parquet(f"{folder}/whitened")
    means = np.array(whitened.agg(*[F.sum(F.col("whitened")[k] * F.col("weight")) for k in range(kept)]).first()) / n
    second = weighted_products(whitened, kept, "weight", "whitened") / n - np.outer(means, means)
    error = float(np.abs(second - np.eye(kept)).max())
    trace = float(np.trace(covariance))
    joined = spread_join(rows, whitened.drop("weight"), ["x"])
    place = joined.select("row_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    explained = F.element_at(F.array(*[F.lit(float(e / trace)) for e in values[:kept]]), F.col("k") + 1)
    return place.select(
        "row_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
