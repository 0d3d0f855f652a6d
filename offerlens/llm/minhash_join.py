"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

1. One pass over the texts gives each row a 128-bit hash of its words (its text class) and the MinHash values of its set of
   word n-grams, folded into one key per band. Rows and bands per signature are chosen for the wanted recall.
2. Text classes meet in a bucket when a band key is equal. Buckets with one member go; of buckets with the same members one stays.
3. The full sets of the remaining classes are sent to their buckets. A large bucket is cut by set size (a pair's sizes differ by less
   than the threshold's factor) and then into blocks; each pair of blocks is a tile, and a tile counts shared n-grams
   of all its pairs at once. Pairs are never written out: a tile returns, per class, its number of links and one edge to a
   member of its group. A pair met in several buckets counts in the first of them.
4. Edges are joined to groups (see `components`).

Defined results. Equal word sequences are equal texts. A text with fewer words than n has one n-gram, all its words. A null
text or one without words links to nothing and is a group of its own. Rows with a null id take part; a group's id is its smallest
non-null id. Repeated rows are copies like any other. Extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from offerlens.functions.durable import checkpointed
from offerlens.llm.components import components
from offerlens.llm.grams import gram_hashes, gram_set, mixed, normalised
from offerlens.llm.names import free_name

MOST_HASHES = 128
TILE_GRAMS = 1_000_000
TILE_ROWS = 1_024
TILE_COLUMNS = 1_024
FILTER_BITS = 1 << 26


def bands_and_rows(threshold: float, recall: float) -> tuple[int, int]:
    """Bands and rows per band whose chance to meet a pair at the threshold is at least `recall`.

    Among signatures of up to MOST_HASHES values the one with the most rows per band, which lets the fewest other pairs meet.
    """
    best = None
    for rows in range(1, MOST_HASHES + 1):
        missed = 1 - threshold**rows
        if missed >= 1:
            break
        bands = 1 if missed <= 0 else math.ceil(math.log(1 - recall) / math.log(missed))
        if bands * rows <= MOST_HASHES:
            best = (bands, rows)
    if best is None:
        raise ValueError("no signature of that size reaches the recall")
    return best


class Signer:
    """Band keys of n-gram sets."""

    def __init__(self, bands: int, rows: int):
        words = np.frombuffer(hashlib.shake_256(b"minhash").digest(16 * bands * rows), np.uint64)
        self.factor, self.offset = words[: bands * rows] | np.uint64(1), words[bands * rows :]
        self.bands, self.rows = bands, rows
        self.band = mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def keys(self, grams: np.ndarray) -> np.ndarray:
        low = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(grams), 2_000):  # a long text is signed piece by piece, so that memory stays small
            np.minimum(low, (grams[k : k + 2_000, None] * self.factor + self.offset).min(axis=0), out=low)
        key = self.band.copy()
        for column in (low >> np.uint64(20)).reshape(self.bands, self.rows).T:
            key = mixed(key ^ column) + np.uint64(1)
        return key.view(np.int64)


def _signed(rows: DataFrame, size: int, bands: int, band_rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, band_rows)
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            hashes, counts, keys = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                joined, n_words = normalised(text or b"")
                grams = np.unique(gram_hashes(joined, n_words, size))
                hashes.append(hashlib.blake2b(joined, digest_size=16).digest())
                counts.append(len(grams))
                keys.append(signer.keys(grams) if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hashes, pa.binary()), pa.array(counts, pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                names=["row_id", "text_class", "n_grams", "keys"],
            )

    id_type = rows.schema["row_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row_id {id_type}, text_class binary, n_grams int, keys array<bigint>")


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """Text class and packed sorted n-gram set of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                texts = [t or b"" for t in batch.column(1).slice(k, 256).cast(pa.binary()).to_pylist()]
                hashes = [hashlib.blake2b(normalised(t)[0], digest_size=16).digest() for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array([gram_set(t, size).tobytes() for t in texts], pa.binary())], names=["text_class", "grams"])

    return rows.mapInArrow(run, "text_class binary, grams binary")


def _id_bits(ids: DataFrame, row_id: str) -> np.ndarray:
    """Bitmap of FILTER_BITS (8 MB) with the bits of all ids set: at most FILTER_BITS / 32 words reach the driver, whatever the number of ids."""
    placed = ids.select(F.pmod(F.xxhash64(row_id), F.lit(FILTER_BITS)).alias("bit"))
    words = placed.groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 AS int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the ids with these hashes may be among those of the bitmap; never False for one that is."""
    bit = hashes & (FILTER_BITS - 1)
    return bits[bit >> 5] >> (bit & 31).astype(np.uint32) & 1 == 1


def _possible(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """Rows (row_id, text) whose id may be in the bitmap, so that few other texts are shuffled."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(_held(shared.value, batch.column(2).to_numpy())))
            yield pa.RecordBatch.from_arrays(kept.columns[:2], names=["row_id", "text"])

    return rows.withColumn("hash", F.xxhash64("row_id")).mapInArrow(run, rows.schema)


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values each set in `left` shares with each set in `right` (row numbers into `sets`)."""
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.concatenate(([True], values[1:] != values[:-1])) if len(values) else np.zeros(0, bool)
    column = np.cumsum(first) - 1
    often = np.bincount(column) > 1 if len(column) else np.zeros(0, bool)
    keep = often[column] if len(column) else np.zeros(0, bool)
    column, owner = (np.cumsum(often) - 1)[column[keep]] if keep.any() else column[:0], owner[keep]
    out = np.zeros((len(left), len(right)), np.float32)
    place = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + 1, TILE_COLUMNS))
    for a, b in zip(place, [*place[1:], len(column)], strict=True):
        if a == b:
            continue
        here = np.zeros((len(sets), TILE_COLUMNS), np.float32)
        here[owner[a:b], column[a:b] % TILE_COLUMNS] = 1
        one = here[left]
        out += one @ (one if right is left else here[right]).T
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each item's connected component for the pairs (a, b) of n items."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _tile(tile: tuple[int, ...], rows: list[dict], threshold: float) -> list[tuple[bytes, int, bytes]]:
    """(class, links found here first, a linked class or the class itself) for the linked classes of a tile."""
    by_class = {(r["text_class"], r["side"]): r for r in rows}  # repeated rows of one text
    rows = [by_class[k] for k in sorted(by_class)]
    side = np.array([r["side"] for r in rows])
    bucket, ga, gb, i, j = tile
    inside = (ga, i) == (gb, j)
    left, right = (np.arange(len(rows)),) * 2 if inside else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    if not len(left) or not len(right) or len(rows) < 2:
        return []
    sets = [np.frombuffer(r["grams"], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets], np.float64)
    shared = _shared(sets, left, right)
    linked = shared >= threshold / (1 + threshold) * (sizes[left][:, None] + sizes[right]) - 1e-6
    if inside:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return []
    earlier = [np.array([k for k in r["buckets"] if k < bucket], np.int64) for r in rows]
    fresh = linked & (_shared(earlier, left, right) == 0) if any(map(len, earlier)) else linked
    copies = np.array([r["copies"] for r in rows], np.int64)
    links = np.zeros(len(rows), np.int64)
    links[left] += fresh @ copies[right]
    if not inside:
        links[right] += fresh.T @ copies[left]
    a, b = np.nonzero(linked)
    root = _roots(len(rows), left[a], right[b])
    touched = np.union1d(left[a], right[b])
    return [(rows[k]["text_class"], int(links[k]), rows[root[k]]["text_class"]) for k in touched]


def _compared(tiles: DataFrame, threshold: float) -> DataFrame:
    key = ("bucket", "ga", "gb", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []

        def packed() -> pa.RecordBatch:
            classes, links, other = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(classes, pa.binary()), pa.array(links, pa.int64()), pa.array(other, pa.binary())], names=["text_class", "links", "other"])

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for row in batch.slice(k, 256).to_pylist():
                    tile = tuple(row[c] for c in key)
                    if tile != now:
                        out += _tile(now, rows, threshold) if now else []
                        now, rows = tile, []
                        if len(out) > 5_000:
                            yield packed()
                            out = []
                    rows.append(row)
        out += _tile(now, rows, threshold) if now else []
        if out:
            yield packed()

    ordered = tiles.repartition(*key).sortWithinPartitions(*key)
    return ordered.mapInArrow(run, "text_class binary, links bigint, other binary")


def _tiles(members: DataFrame, threshold: float) -> DataFrame:
    """A row for each tile that a member takes part in: tile key, side, member columns."""
    factor = math.log(1 / threshold) if threshold < 1 else 1.0
    blocks = lambda grams, rows: F.greatest(F.lit(1), F.ceil(grams / TILE_GRAMS), F.ceil(rows / TILE_ROWS)).cast("int")
    whole = members.groupBy("bucket").agg(F.sum("n_grams").alias("bucket_grams"), F.count(F.lit(1)).alias("bucket_rows"))
    cut = whole.filter(blocks(F.col("bucket_grams"), F.col("bucket_rows")) > 1).select("bucket", F.lit(True).alias("cut"))
    g = F.when(F.col("cut"), F.floor(F.log(F.col("n_grams").cast("double")) / F.lit(factor) + 1e-9)).otherwise(0).cast("int")
    sized = members.join(cut, "bucket", "left").withColumn("g", g).drop("cut")
    parts = sized.groupBy("bucket", "g").agg(blocks(F.sum("n_grams"), F.count(F.lit(1))).alias("parts"))
    around = (
        parts.select("bucket", "g", F.lit(0).alias("step"), "parts")
        .union(parts.select("bucket", (F.col("g") - 1).alias("g"), F.lit(1).alias("step"), "parts"))
        .union(parts.select("bucket", (F.col("g") + 1).alias("g"), F.lit(-1).alias("step"), "parts"))
        .groupBy("bucket", "g")
        .agg(*[F.max(F.when(F.col("step") == s, F.col("parts"))).alias(n) for s, n in ((0, "own"), (1, "above"), (-1, "below"))])
        .filter("own IS NOT NULL")
    )
    s = F.pmod(F.xxhash64("text_class"), F.col("own")).cast("int")
    spot = lambda ga, gb, i, j, side: F.struct(ga.alias("ga"), gb.alias("gb"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    ranged = lambda n: F.when(n.isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - 1))
    spots = F.concat(
        F.transform(F.sequence(F.col("s"), F.col("own") - 1), lambda j: spot(F.col("g"), F.col("g"), F.col("s"), j, 0)),
        F.transform(F.when(F.col("s") > 0, F.sequence(F.lit(0), F.col("s") - 1)).otherwise(F.array().cast("array<int>")), lambda i: spot(F.col("g"), F.col("g"), i, F.col("s"), 1)),
        F.transform(ranged(F.col("above")), lambda j: spot(F.col("g"), F.col("g") + 1, F.col("s"), j, 0)),
        F.transform(ranged(F.col("below")), lambda i: spot(F.col("g") - 1, F.col("g"), i, F.col("s"), 1)),
    )
    placed = sized.join(around, ["bucket", "g"]).withColumn("s", s).select("bucket", "text_class", "copies", F.explode(spots).alias("spot"))
    return placed.select("bucket", "spot.*", "text_class", "copies")


def jaccard_groups(rows: DataFrame, row_id: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """One row per input row: row_id, text_class, class_id (smallest id of its group), first_class (the text class that holds it),
    n_links (other rows whose text is equal or at least `threshold` similar)."""
    bands, band_rows = bands_and_rows(threshold, recall)
    source = rows.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"))
    signed = checkpointed(_signed(source, size, bands, band_rows))
    classes = checkpointed(
        signed.filter("n_grams > 0").groupBy("text_class")
        .agg(F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.any_value("n_grams").alias("n_grams"), F.any_value("keys").alias("keys"))
    )
    keyed = classes.select("text_class", "n_grams", "copies", F.explode("keys").alias("bucket"))
    prints = [F.bit_xor(F.xxhash64("text_class", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    shared = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *prints).filter("n > 1")
    kept = shared.groupBy("n", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket")
    members = checkpointed(keyed.join(kept, "bucket"))
    meets = members.groupBy("text_class").agg(F.collect_list("bucket").alias("buckets"))  # at most one entry per band
    needed = meets.join(classes.select("text_class", "first_id"), "text_class").select("first_id").distinct()
    needed = checkpointed(needed)
    possible = _possible(source, _id_bits(needed, "first_id"))
    chosen = possible.join(needed, possible["row_id"].eqNullSafe(needed["first_id"]), "left_semi")
    sets = _sets(chosen, size).join(meets, "text_class")
    found = checkpointed(_compared(_tiles(members, threshold).join(sets, "text_class"), threshold))
    linked = components(found, "text_class", "other")
    groups = linked.join(classes.select(F.col("text_class").alias("node"), "first_id"), "node")
    firsts = groups.groupBy("label").agg(F.min(F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "node")).alias("low"))
    groups = groups.join(firsts, "label").select(F.col("node").alias("text_class"), F.col("low.first_id").alias("group_id"), F.col("low.node").alias("first_class"))
    links = found.groupBy("text_class").agg(F.sum("links").alias("links"))
    facts = (
        classes.select("text_class", "first_id", "copies").join(links, "text_class", "left").join(groups, "text_class", "left")
        .select(
            "text_class",
            F.when(F.col("first_class").isNull(), F.col("first_id")).otherwise(F.col("group_id")).alias("class_id"),
            F.coalesce("first_class", "text_class").alias("first_class"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    facts = checkpointed(facts)  # so that the join may split the rows of a text with very many copies
    empty = F.col("n_grams") == 0
    return signed.join(facts, "text_class", "left").select(
        "row_id", "text_class",
        F.when(empty, F.col("row_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("first_class", "text_class").alias("first_class"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _with_text_class(documents: DataFrame, row_id: str, text: str, name: str, bits: np.ndarray) -> DataFrame:
    """All columns and the text class, null for rows whose id is surely not in the bitmap."""
    shared = documents.sparkSession.sparkContext.broadcast(bits)
    number = free_name(documents, "__hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = _held(shared.value, batch.column(batch.num_columns - 1).to_numpy()).tolist()
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
            hashes = [hashlib.blake2b(normalised(texts[k].as_py() or b"")[0], digest_size=16).digest() if h else None for k, h in enumerate(held)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hashes, pa.binary())], names=[*batch.schema.names[:-1], name])

    return documents.withColumn(number, F.xxhash64(row_id)).mapInArrow(run, StructType([*documents.schema.fields, StructField(name, BinaryType())]))


def one_per_group(documents: DataFrame, row_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows that are their group's first: smallest id, of its repeated rows one. Rows without words all stay."""
    groups = checkpointed(jaccard_groups(documents, row_id, text, **options).filter("n_links > 0"))  # all other rows stay
    bits = _id_bits(groups, "row_id")
    name = free_name(documents, "__text_class")
    marked = _with_text_class(documents, row_id, text, name, bits)
    alone = marked.filter(F.col(name).isNull())
    maybe = marked.filter(F.col(name).isNotNull())
    known = groups.select(F.col("row_id").alias("__known_id"), F.col("text_class").alias("__known_class"), (F.col("row_id").eqNullSafe(F.col("class_id")) & (F.col("text_class") == F.col("first_class"))).alias("__first")).distinct()
    same = lambda table: maybe[row_id].eqNullSafe(table["__known_id"]) & (maybe[name] == table["__known_class"])
    free = maybe.join(known, same(known), "left_anti")
    firsts = known.filter("__first")
    chosen = maybe.join(firsts, same(firsts), "left_semi").dropDuplicates([row_id, name])
    return alone.unionByName(free).unionByName(chosen).drop(name)
