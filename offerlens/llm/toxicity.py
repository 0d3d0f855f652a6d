"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, its white space becomes single spaces, and a space is put at either end. Its character n-grams are hashed to
2^20 slots; a feature is whether a slot occurs in the text, times the slot's log-count ratio between labelled texts of both kinds.
Spark counts the slots over all labelled texts, however many there are. A ratio is drawn towards 0 by `errors` of its standard
errors, which takes out the slots whose ratio may be chance, the great majority. The linear weights (logistic loss, both labels weigh alike)
are fitted by L-BFGS in one task on at most `most_labelled` labelled texts, half of each label, those with the smallest hash of the
id; this is the only sample. The fitted table of 2^20 weights (4 MB, whatever the tables hold) goes to every task for scoring.
Texts travel to their labels only where a bitmap of fixed size says that they may have one; the join then decides.

Defined results. A null text is the empty text; it has the score of the constant term. Without labelled texts of both labels every score is the share of
label 1 among them, 0.5 without any. Texts of any length are read whole, in blocks of characters. Repeated rows score alike. A null label or id is no label, and a row labelled in both ways counts for
both. Ties of the hash are broken by the id. Extra columns pass through; one with the score's name is replaced. Empty tables give empty results.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

BITS = 20
SLOTS = 1 << BITS
SIZES = (3, 4, 5, 6, 7)
BLOCK = 1 << 15
ROWS = 256
PIECE = 1 << 10
ID_BITS = 1 << 26
ENTRIES = 1 << 20


def slots(text: str | None, wanted: np.ndarray | None = None) -> np.ndarray:
    """Distinct slots of the text's n-grams in ascending order; with `wanted` (a flag per slot) only those."""
    bare = " ".join((text or "").lower().split())
    if not bare:
        return np.zeros(0, np.int64)
    characters = np.frombuffer(f" {bare} ".encode("utf-32-le"), np.uint32)
    longest, found = max(SIZES), []
    for first in range(0, len(characters), BLOCK):
        part = characters[first : first + BLOCK + longest - 1]
        code = np.zeros(len(part), np.uint32)
        for n in range(1, min(longest, len(part)) + 1):
            code = (code[: len(part) - n + 1] + part[n - 1 :]) * np.uint32(0x9E3779B1)
            code ^= code >> np.uint32(15)
            if n in SIZES:
                slot = (code * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
                found.append(slot if wanted is None else slot[wanted[slot]])
    every = np.concatenate(found) if found else np.zeros(0, np.uint32)
    if wanted is not None:
        return np.unique(every).astype(np.int64)
    seen = np.zeros(SLOTS, np.bool_)
    seen[every] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    """Weight of each slot (ratio times linear weight) and the constant term."""

    weight: np.ndarray
    constant: float

    def __post_init__(self) -> None:
        self.wanted = self.weight != 0

    def score(self, text: str | None) -> float:
        z = float(self.weight[slots(text, self.wanted)].sum(dtype=np.float64)) + self.constant
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def log_ratio(with_slot_1: np.ndarray, with_slot_0: np.ndarray, texts_1: float, texts_0: float, errors: float) -> np.ndarray:
    """Log of the ratio of both labels' smoothed document shares, drawn towards 0 by `errors` standard errors."""
    one, nought = with_slot_1 + 1.0, with_slot_0 + 1.0
    ratio = np.log(one / (texts_1 + 2)) - np.log(nought / (texts_0 + 2))
    return np.sign(ratio) * np.maximum(np.abs(ratio) - errors * np.sqrt(1 / one + 1 / nought), 0)


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = 100, memory: int = 8) -> np.ndarray:
    """L-BFGS with step halving; `loss` returns value and gradient."""
    x, (f, g) = start, loss(start)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, kept = -g, []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            kept.append(a)
            d = d - a * y
        if pairs:
            s, y = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        t = 1.0 if pairs else 1 / max(1.0, float(np.abs(g).sum()))
        while True:
            f_new, g_new = loss(x + t * d)
            if f_new <= f + 1e-4 * t * float(g @ d) or t < 1e-12:
                break
            t /= 2
        s, y = t * d, g_new - g
        if s @ y > 1e-14:
            pairs = [*pairs, (s, y)][-memory:]
        done = abs(f - f_new) < 1e-8 * max(1.0, abs(f))
        x, f, g = x + s, f_new, g_new
        if done:
            break
    return x


def fit(texts: list[np.ndarray], label: np.ndarray, ratio: np.ndarray, penalty: float) -> Model:
    """Linear weights of the scaled features of the sampled texts (each given by its slots with a ratio other than 0)."""
    if not len(label) or label.min() == label.max():
        share = float(label.mean()) if len(label) else 0.5
        return Model(np.zeros(SLOTS, np.float32), float(np.log(max(share, 1e-12) / max(1 - share, 1e-12))))
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.concatenate(texts).astype(np.int32)
    used = np.flatnonzero(np.bincount(flat, minlength=SLOTS))
    index = np.zeros(SLOTS, np.int32)
    index[used] = np.arange(len(used), dtype=np.int32)
    place, scale = index[flat], ratio[used]
    ends = np.cumsum(sizes)
    heft = np.where(label == 1, 0.5 / (label == 1).sum(), 0.5 / (label == 0).sum())
    # Rows in blocks of about ENTRIES features, so that a step needs little memory beside the features themselves.
    edges = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + ENTRIES, ENTRIES), side="left").clip(0, len(texts)))
    blocks = [(int(i), int(j), int(ends[i] - sizes[i]), int(ends[j - 1])) for i, j in zip(edges, [*edges[1:], len(texts)], strict=True) if j > i]

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w = x[:-1]
        total, gradient, constant = penalty / 2 * float(w @ w), penalty * w, 0.0
        scaled = scale * w
        for i, j, first, end in blocks:
            part, row = place[first:end], np.repeat(np.arange(j - i), sizes[i:j])
            z = np.bincount(row, scaled[part], j - i) + x[-1]
            g = heft[i:j] * (1 / (1 + np.exp(-np.clip(z, -700, 700))) - label[i:j])
            total += float((heft[i:j] * np.logaddexp(0, np.where(label[i:j] == 1, -z, z))).sum())
            gradient = gradient + scale * np.bincount(part, g[row], len(used))
            constant += float(g.sum())
        return total, np.append(gradient, constant)

    solved = minimise(loss, np.zeros(len(used) + 1))
    weight = np.zeros(SLOTS, np.float32)
    weight[used] = ratio[used] * solved[:-1]
    return Model(weight, float(solved[-1]))


def _likely(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts(row_id, text) whose id may be among ids(row_id): all that are, and few others while the bitmap of 8 MB is not full."""
    place = F.pmod(F.xxhash64(F.col("row_id").cast("string")), F.lit(ID_BITS))
    # At most 2^20 rows of two numbers, whatever the tables hold.
    words = ids.select(F.floor(place / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    held = np.zeros(ID_BITS // 64, np.uint64)
    held[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    shared = texts.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            there = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["row_id", "text"]).filter(pa.array(there.astype(np.bool_)))

    return texts.filter("row_id IS NOT NULL").withColumn("place", place).mapInArrow(run, texts.schema)


def slot_counts(labelled: DataFrame) -> DataFrame:
    """(slot, ones, noughts): labelled texts of each label that hold the slot; slot -1 counts the texts themselves.

    A task counts in two arrays of 2^20 and gives them in pieces; the pieces of a place are added up by the task that gets it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, SLOTS + PIECE), np.uint32)
        for batch in batches:
            for kind, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = held[1 - kind]
                counts[slots(text.as_py())] += 1
                counts[SLOTS] += 1
        for piece in range(SLOTS // PIECE + 1):
            part = held[:, piece * PIECE : (piece + 1) * PIECE]
            if part.any():
                width = np.uint8 if part.max() < 256 else np.uint16 if part.max() < 65536 else np.uint32
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([part.astype(width).tobytes()], pa.binary())], names=["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                width = {2 * PIECE: np.uint8, 4 * PIECE: np.uint16, 8 * PIECE: np.uint32}[len(packed)]
                total.setdefault(piece, np.zeros((2, PIECE), np.int64))[:] += np.frombuffer(packed, width).reshape(2, PIECE)
        for piece, counts in total.items():
            used = np.flatnonzero(counts.any(axis=0))
            slot = np.where(piece * PIECE + used == SLOTS, -1, piece * PIECE + used)
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(counts[0][used]), pa.array(counts[1][used])], names=["slot", "ones", "noughts"])

    counted = labelled.select("label", "text").mapInArrow(count, "piece int, counts binary")
    return counted.repartition("piece").mapInArrow(add, "slot int, ones long, noughts long")


def train(
    documents: DataFrame, labels: DataFrame, usable: Column | None = None, row_id: str = "doc_id", text: str = "text", label: str = "toxic",
    most_labelled: int = 8_192, errors: float = 2.0, penalty: float = 1e-4,
) -> Model:
    """Model from the labelled rows for which `usable`, a condition on `row_id`, holds: ratios from all, weights from at most `most_labelled`."""
    texts = documents.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"))
    known = labels.select(F.col(row_id).cast(texts.schema["row_id"].dataType).alias("row_id"), F.col(label).cast("int").alias("label")).filter("row_id IS NOT NULL AND label IN (0, 1)").distinct()
    known = known if usable is None else known.filter(usable)
    labelled = _likely(texts, known).join(known, "row_id").select("row_id", "label", "text")
    # At most 2^20 + 1 rows of three numbers, whatever the tables hold.
    counted = slot_counts(labelled).toArrow()
    slot, ones, noughts = (counted.column(n).to_numpy() for n in ("slot", "ones", "noughts"))
    texts_1, texts_0 = (int(x[slot < 0].sum()) for x in (ones, noughts))
    ratio = np.zeros(SLOTS, np.float64)
    if texts_1 and texts_0:
        ratio[slot[slot >= 0]] = log_ratio(ones[slot >= 0], noughts[slot >= 0], texts_1, texts_0, errors)
    else:
        total = texts_1 + texts_0
        return fit([], np.repeat([1, 0], [texts_1 > 0, texts_0 > 0]) if total else np.zeros(0), ratio, penalty)
    shared = documents.sparkSession.sparkContext.broadcast(ratio.astype(np.float32))
    halves = [known.filter(F.col("label") == k).orderBy(F.xxhash64("row_id"), "row_id").limit(most_labelled // 2) for k in (0, 1)]
    chosen = halves[0].unionAll(halves[1])
    sample = _likely(texts, chosen).join(chosen, "row_id").select("row_id", "label", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value != 0
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                packed = [slots(t.as_py(), wanted).astype(np.int32).tobytes() for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary())], names=["row_id", "label", "slots"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
        found = sorted(rows, key=lambda r: (str(r[0]), r[1], r[2]))
        model = fit([np.frombuffer(f[2], np.int32) for f in found], np.array([f[1] for f in found]), shared.value.astype(np.float64), penalty)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model.weight, model.constant))], pa.binary())], names=["model"])

    id_type = sample.schema["row_id"].dataType.simpleString()
    # One task on purpose: a bounded number of rows, each with the few slots that have a ratio.
    made = sample.mapInArrow(measure, f"row_id {id_type}, label int, slots binary").repartition(1).mapInArrow(solve, "model binary").first()
    return Model(*pickle.loads(made["model"]))


def score(documents: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All columns and the score (0 to 1, higher: label 1 likelier)."""
    shared = documents.sparkSession.sparkContext.broadcast((model.weight, model.constant))
    kept = [f for f in documents.schema.fields if f.name != name]
    schema = StructType([*kept, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Model(*shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                scores = [judge.score(t.as_py()) for t in part.column(part.schema.get_field_index(text))]
                columns = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=schema.names)

    return documents.mapInArrow(run, schema)
