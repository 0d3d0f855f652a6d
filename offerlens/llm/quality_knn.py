"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

Terms are hashed byte trigrams and a few shape measures (repeated lines, words and word triples, capitals, characters that are no letters,
length). A bounded sample of labelled rows gives the term weights (inverse document frequency), the latent space (truncated singular value
decomposition) and the labelled vectors. All of it is a few megabytes whatever the tables hold, and goes to every task. Every
document is then compared with all labelled vectors, block by block, and the `neighbours` nearest vote with their cosine as weight.

The sample takes the labelled rows with the smallest hash of their id, at most `most_labelled` of them; everything
else covers all rows. The text is the only input of a score.

Defined results. A null text is the empty text. A text with no positive cosine to any labelled row, like the empty one, scores the share of label 1 in the
sample; without any labelled row every score is 0.5. Texts of any length are read whole; repeated rows score alike; a null
label is no label. Input columns named like an output column are replaced, others pass through.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

TRIGRAM_BITS = 12
TRIGRAMS = 1 << TRIGRAM_BITS
SHAPES = 6
SHAPE_WEIGHT = 0.5
BLOCK = 256


def terms(text: bytes) -> np.ndarray:
    """Row of the term-document matrix before weighting."""
    out = np.zeros(TRIGRAMS + SHAPES, np.float32)
    data = np.frombuffer(text, np.uint8)
    if len(data) >= 3:
        wide = data.astype(np.uint32)
        code = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)
        slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - TRIGRAM_BITS)
        out[:TRIGRAMS] = np.log1p(np.bincount(slot, minlength=TRIGRAMS))
    words = text.split()
    if words:
        lines = [line for line in text.split(b"\n") if line.strip()]
        capitals = np.count_nonzero((data >= 65) & (data <= 90))
        letters = np.count_nonzero((data >= 97) & (data <= 122) | (data >= 128))
        out[TRIGRAMS:] = SHAPE_WEIGHT * np.array([
            1 - len(set(lines)) / len(lines),
            sum(map(bytes.__eq__, words, words[1:])) / len(words),
            1 - len(set(zip(words, words[1:], words[2:], strict=False))) / (len(words) - 2) if len(words) > 2 else 0,
            capitals / len(data),
            1 - letters / len(data),
            np.log1p(len(words)) / 12,
        ])
    return out


@dataclass
class Model:
    """Term weights, latent directions, labelled vectors of length 1 and their labels."""

    weight: np.ndarray
    directions: np.ndarray
    labelled: np.ndarray
    label: np.ndarray
    neighbours: int

    def place(self, rows: np.ndarray) -> np.ndarray:
        """Latent vectors of length 1 (or 0)."""
        return _unit(_weighted(rows, self.weight) @ self.directions)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.label):
            return np.full(len(rows), 0.5)
        cosine = self.place(rows) @ self.labelled.T
        k = min(self.neighbours, len(self.label))
        nearest = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(cosine, nearest, axis=1), 0).astype(np.float64)
        total = vote.sum(axis=1)
        return np.where(total > 0, (vote * self.label[nearest]).sum(axis=1) / np.maximum(total, 1e-300), self.label.mean())


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _weighted(rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
    trigrams = _unit(rows[:, :TRIGRAMS] * weight)
    return np.hstack((trigrams, rows[:, TRIGRAMS:]))


def fit(rows: np.ndarray, label: np.ndarray, dimensions: int, neighbours: int) -> Model:
    """Latent space of the labelled rows, by subspace iteration from a fixed start."""
    weight = (np.log((1 + len(rows)) / (1 + (rows[:, :TRIGRAMS] > 0).sum(axis=0))) + 0.05).astype(np.float32)
    matrix = _weighted(rows, weight)
    basis = np.random.default_rng(7).standard_normal((matrix.shape[1], dimensions + 16)).astype(np.float32)
    for _ in range(6):
        basis = np.linalg.qr(matrix.T @ (matrix @ basis))[0]
    turn = np.linalg.svd(matrix @ basis, full_matrices=False)[2]
    directions = (basis @ turn[:dimensions].T).astype(np.float32)
    return Model(weight, directions, _unit(matrix @ directions), label.astype(np.float64), neighbours)


def train(
    documents: DataFrame, labels: DataFrame, usable: Column | None = None, row_id: str = "doc_id", text: str = "text", label: str = "quality",
    most_labelled: int = 4_096, dimensions: int = 32, neighbours: int = 16,
) -> Model:
    """Model of at most `most_labelled` labelled rows for which `usable`, a condition on the id, holds."""
    known = labels.select(F.col(row_id).alias("row_id"), F.col(label).cast("int").alias("label")).filter("row_id IS NOT NULL AND label IN (0, 1)")
    if usable is not None:
        known = known.filter(usable)
    sample = known.orderBy(F.xxhash64("row_id"), "row_id", "label").limit(most_labelled)
    texts = documents.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"))
    rows = texts.join(sample, "row_id").select("row_id", "label", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                packed = [terms((t or "").encode()).tobytes() for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary())], names=["row_id", "label", "terms"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted({(row["row_id"], row["label"], row["terms"]) for batch in batches for row in batch.to_pylist()}, key=repr)[:most_labelled]
        matrix = np.frombuffer(b"".join(f[2] for f in found), np.float32).reshape(len(found), TRIGRAMS + SHAPES)
        model = fit(matrix, np.array([f[1] for f in found]), dimensions, neighbours)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    id_type = rows.schema["row_id"].dataType.simpleString()
    measured = rows.mapInArrow(measure, f"row_id {id_type}, label int, terms binary")
    # One task on purpose: at most `most_labelled` rows of fixed size.
    made = measured.repartition(1).mapInArrow(solve, "model binary").first()
    return pickle.loads(made["model"]) if made else fit(np.zeros((0, TRIGRAMS + SHAPES), np.float32), np.zeros(0), dimensions, neighbours)


def score(documents: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All columns and the score (0 to 1, higher: label 1 likelier)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in documents.schema.fields if f.name != name]
    schema = StructType([*kept, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voter = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                scores = voter.score(np.stack([terms((t or "").encode()) for t in texts]))
                columns = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=schema.names)

    return documents.mapInArrow(run, schema)
