"""Quality rules with n-gram perplexity.

The model is a modified Kneser-Ney model of ORDER characters. Characters are code points as they stand, only runs of white space count as
one space, so the n-grams grow with the corpus. Spark counts them over all texts and keeps every order as a table; n-grams are told apart by
their code points, never by their hashes.

Scoring goes by blocks of a file split, at most BLOCK characters each (or one longer text). The first pass over the texts counts the n-grams of every
block, which is both the corpus count and the list of what the block will ask for. Spark joins the log probabilities to that list and writes them
per block to the shared folder. The second pass reads the same splits again and loads one block's n-grams at a time as an array sorted by a
64-bit hash. So texts are never shuffled, no task holds more than a block's n-grams, and nothing that grows reaches the driver.
Two n-grams of one block with the same hash stop the job (chance below 10^-4 for a block of nothing but different n-grams).

Each language has its own lower and upper bound of log-perplexity, set from the quartiles of all its documents that pass
the basic rules: low perplexity marks repetitive or degenerate text, high perplexity noise.

Defined results. A null text is the empty text: no words, base_failed. A null language is a language of its own. Texts
of any length are read whole. Repeated rows count as often as they occur. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions.durable import checkpointed, shared_folder, written

ORDER = 4
SYMBOLS = [f"s{k}" for k in range(ORDER)]
BLOCK = 1 << 25
CHUNK = 1 << 20
HELD = 1 << 21
BINS_PER_BIT = 256
SHIFT = 21  # bits of a code point
LARGEST = (1 << SHIFT) - 1
MARKS = "#*$%&|<>"  # fixed value: the symbols counted by the basic rules
SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x3000], np.uint32)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each led by ORDER - 1 spaces, and the number of n-grams of each text (its characters, runs of white space once)."""
    lead = " " * (ORDER - 1)
    points = np.frombuffer((lead + lead.join(texts)).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + ORDER - 1)
    starts = ends - lengths
    blank = (points == 32) | (points < 14) & (points > 8) | (points > 127) & np.isin(points, SPACES)
    points = np.where(blank, np.uint32(32), points)
    keep = np.ones(len(points), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    led = (ends[:, None] - lengths[:, None] - np.arange(1, ORDER)).ravel()
    keep[led] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return points[keep], kept[ends] - kept[starts]


def hashes(points: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of the n-gram ending at each character of `symbols`' texts, and where in `points` it starts."""
    first = np.concatenate(([0], np.cumsum(counts + ORDER - 1)[:-1])) if len(counts) else np.zeros(0, np.int64)
    at = np.repeat(first - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum()) if len(counts) else np.zeros(0, np.int64)
    wide = points.astype(np.uint64)
    return mixed([wide[at + k] for k in range(ORDER)]), at


def mixed(grams: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of n-grams given as one array per symbol."""
    code = np.zeros(len(grams[0]), np.uint64)
    for symbol in grams:
        code = (code + symbol) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    return code ^ (code >> np.uint64(32))


def pieces(batches: Iterator[pa.RecordBatch], split: int, text: int) -> Iterator[tuple[int, pa.RecordBatch, list[str]]]:
    """(block, rows, their texts) in the order of the input, at most CHUNK characters or one text each. Blocks depend only on a split's rows and their order."""
    now, part, size = None, 0, 0
    for batch in batches:
        splits = batch.column(split).to_pylist()
        start, chunk, of = 0, [], None
        for k in range(batch.num_rows):
            value = batch.column(text)[k].as_py() or ""
            if splits[k] != now:
                now, part, size = splits[k], 0, 0
            elif size and size + len(value) > BLOCK:
                part, size = part + 1, 0
            size += len(value)
            block = (now * 1_000_003 + part + (1 << 63)) % (1 << 64) - (1 << 63)
            if chunk and (block != of or sum_chars + len(value) > CHUNK):
                yield of, batch.slice(start, k - start), chunk
                start, chunk = k, []
            if not chunk:
                sum_chars, of = 0, block
            chunk.append(value)
            sum_chars += len(value)
        if chunk:
            yield of, batch.slice(start), chunk


def placed(documents: DataFrame, *columns: Column) -> DataFrame:
    """The columns of rows read straight from files, with the split that each row comes from."""
    return documents.select(F.xxhash64(F.input_file_name(), F.input_file_block_start()).alias("split"), *columns)


def block_grams(texts: DataFrame) -> DataFrame:
    """(block, s0.., n): n-grams of every block of a table (split, text). A block's n-gram may come in several rows."""

    def rows(block: int, held: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        code, n, grams = held
        for k in range(0, len(code), 100_000):
            part = slice(k, k + 100_000)
            arrays = [pa.array(np.full(len(code[part]), block, np.int64)), *[pa.array(grams[part, j].astype(np.int32)) for j in range(ORDER)], pa.array(n[part])]
            yield pa.RecordBatch.from_arrays(arrays, names=["block", *SYMBOLS, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, ORDER), np.uint32))
        for block, _, texts_of in pieces(batches, 0, 1):
            if held is not None and (block != now or len(held[0]) > HELD):
                yield from rows(now, held)
                held = None
            now, held = block, held or none
            points, counts = symbols(texts_of)
            code, at = hashes(points, counts)
            found, n = np.unique(code, return_counts=True)
            place = np.minimum(np.searchsorted(held[0], found), max(len(held[0]) - 1, 0))
            known = held[0][place] == found if len(held[0]) else np.zeros(len(found), bool)
            held[1][place[known]] += n[known]
            fresh = found[~known]
            if len(fresh):
                where = np.flatnonzero(lookup(fresh, code) >= 0)
                _, first = np.unique(code[where], return_index=True)
                grams = points[at[where[first]][:, None] + np.arange(ORDER)]
                order = np.argsort(np.concatenate((held[0], fresh)), kind="stable")
                held = tuple(np.concatenate(x)[order] for x in zip(held, (fresh, n[~known].astype(np.int64), grams), strict=True))
        if held is not None:
            yield from rows(now, held)

    return texts.mapInArrow(run, "block bigint, " + ", ".join(f"{s} int" for s in SYMBOLS) + ", n bigint")


def lookup(table: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Place of each code in a sorted array of hashes, -1 if absent. A directory by leading bits gives the start, then places are stepped."""
    if not len(table):
        return np.full(len(code), -1, np.int64)
    bits = max(1, min(24, int(len(table)).bit_length()))
    shift = np.uint64(64 - bits)
    directory = np.searchsorted(table, np.arange(1 << bits, dtype=np.uint64) << shift)
    place = directory[(code >> shift).astype(np.int64)]
    last = len(table) - 1
    open_rows = np.flatnonzero((place <= last) & (table[np.minimum(place, last)] < code))
    while len(open_rows):
        place[open_rows] += 1
        at = place[open_rows]
        open_rows = open_rows[(at <= last) & (table[np.minimum(at, last)] < code[open_rows])]
    return np.where((place <= last) & (table[np.minimum(place, last)] == code), place, -1)


@dataclass
class Model:
    """Counts of the n-grams of each order as tables (s.., n) on their last symbols; orders below the highest count in how many ways an n-gram is preceded."""

    levels: list[DataFrame]
    discounts: list[list[float]]
    n_symbols: int

    def probabilities(self, grams: DataFrame, order: int = ORDER) -> DataFrame:
        """(s.., p) of distinct n-grams (s..) of an order, seen or not: p(last symbol after the others)."""
        names = SYMBOLS[ORDER - order :]
        seen, context = self.levels[order - 1], names[:-1]
        whole_level = grams is seen
        own = self.discounts[order - 1]
        cut = F.when(F.col("n") == 1, own[0]).when(F.col("n") == 2, own[1]).otherwise(own[2])
        sums = [F.sum("n").alias("total"), F.sum(cut).alias("left")]
        joined = seen if whole_level else grams.select(*names).join(seen, names, "left")
        if order == 1:
            whole = seen.agg(*sums).first()
            total, left = (float(whole["total"] or 0), float(whole["left"] or 0))
            even = 1 / (self.n_symbols + 1)
            p = (F.coalesce(F.col("n") - cut, F.lit(0.0)) + left * even) / total if total else F.lit(even)
            return joined.select(*names, p.alias("p"))
        contexts = seen.groupBy(*context).agg(*sums)
        suffixes = self.levels[order - 2] if whole_level else grams.select(*names[1:]).distinct()
        shorter = self.probabilities(suffixes, order - 1).withColumnRenamed("p", "lower")
        joined = joined.join(contexts, context, "left").join(shorter, names[1:])
        mixed = (F.coalesce(F.col("n") - cut, F.lit(0.0)) + F.col("left") * F.col("lower")) / F.col("total")
        return joined.select(*names, F.coalesce(mixed, F.col("lower")).alias("p"))


def discounts(counts: dict[int, int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from how many n-grams have counts 1 to 4."""
    n1, n2, n3, n4 = (counts.get(k, 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    parts = [k - (k + 1) * y * after / now if now else k / 2 for k, now, after in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(parts, 1)]


def fit(grams: DataFrame) -> Model:
    """Model of the n-grams (s.., n) of blocks."""
    levels = [written(grams.groupBy(*SYMBOLS).agg(F.sum("n").alias("n")))]
    for order in range(ORDER - 1, 0, -1):
        levels.insert(0, written(levels[0].groupBy(*SYMBOLS[ORDER - order :]).agg(F.count(F.lit(1)).alias("n"))))
    sizes = levels[0].select(F.lit(1).alias("order"), "n")
    for order in range(2, ORDER + 1):
        sizes = sizes.unionByName(levels[order - 1].select(F.lit(order).alias("order"), "n"))
    spread: dict[int, dict[int, int]] = {}
    for r in sizes.filter("n <= 4").groupBy("order", "n").count().collect():  # at most 4 rows an order
        spread.setdefault(r["order"], {})[r["n"]] = r["count"]
    return Model(levels, [discounts(spread.get(order, {})) for order in range(1, ORDER + 1)], levels[0].count())


def train(documents: DataFrame, text: str = "text") -> Model:
    """Model of all texts."""
    source = written(documents.select(F.col(text).alias("text")))
    return fit(written(block_grams(placed(source, F.col("text")))))


def basic_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of UTF-8 text."""
    words = text.split()
    characters = int((np.frombuffer(b"".join(words), np.uint8) & 0xC0 != 0x80).sum())
    marks = len(text) - len(text.translate(None, MARKS.encode()))
    lines = [line for line in text.split(b"\n") if line.strip()]
    first: dict[bytes, int] = {}
    ids = np.array([first.setdefault(w, k) for k, w in enumerate(words)], np.int64)
    repeated = 0
    if len(ids) >= 3:
        _, pair = np.unique(ids[:-1] * len(ids) + ids[1:], return_inverse=True)
        _, inverse, n = np.unique(pair[:-1] * len(ids) + ids[2:], return_inverse=True, return_counts=True)
        again = n[inverse] > 1
        covered = np.zeros(len(ids), bool)
        for k in range(3):
            covered[k : len(ids) - 2 + k] |= again
        repeated = int(covered.sum())
    return len(words), characters, marks, len(lines) - len(set(lines)), repeated


class SortedArrays:
    """The written log probabilities of one block at a time."""

    def __init__(self, folder: str) -> None:
        self.folder, self.block = folder, None

    def of(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        if block != self.block:
            self.block, self.held = block, None
            path = f"{self.folder}/block={block}"
            # Hadoop and Arrow write some locations differently.
            if path.startswith("file:"):
                system, path = pa.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
            elif "://" in path:
                system, path = pa.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
            else:
                system = pa.fs.LocalFileSystem()
            files = [f.path for f in system.get_file_info(pa.fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet")]
            tables = [pa.parquet.read_table(system.open_input_file(f), columns=["low", "high", "bits"]) for f in files]
            joined = {c: np.concatenate([np.zeros(0, np.int64), *[t[c].to_numpy() for t in tables]]) for c in ("low", "high")}
            code = mixed([(joined[c] >> SHIFT * k & LARGEST).astype(np.uint64) for c, k in (packed(j) for j in range(ORDER))])
            bits = np.concatenate([np.zeros(0, np.float32), *[t["bits"].to_numpy() for t in tables]])
            order = np.lexsort((bits, code))
            code, bits = code[order], bits[order]
            again = code[1:] == code[:-1]
            if (again & (bits[1:] != bits[:-1])).any():
                raise ValueError("two n-grams of a block have the same hash")
            once = np.concatenate(([True], ~again))[: len(code)]
            self.held = code[once], bits[once]
        return self.held


def packed(k: int) -> tuple[str, int]:
    """Column that holds symbol k when n-grams are packed into two numbers, and its place there."""
    return ("low", k) if k < 3 else ("high", k - 3)


def write_arrays(grams: DataFrame, model: Model, own: bool) -> str:
    """Folder of the bits (negative log2 probabilities) of each block's n-grams. `own`: the model was fitted to these n-grams."""
    pack = [sum((F.col(SYMBOLS[k]).cast("long") * (1 << SHIFT * place) for k in range(ORDER) for c, place in [packed(k)] if c == name), F.lit(0).cast("long")).alias(name) for name in ("low", "high")]
    known = model.probabilities(model.levels[-1] if own else grams.select(*SYMBOLS).distinct()).select(*pack, (-F.log2("p")).cast("float").alias("bits"))
    folder = f"{shared_folder(grams.sparkSession)}/arrays-{uuid.uuid4().hex}"
    found = grams.select("block", *pack).join(known, ["low", "high"])
    found.repartition("block").write.partitionBy("block").parquet(folder)
    return folder


def measured(documents: DataFrame, folder: str, row_id: str, text: str, lang: str) -> DataFrame:
    """Counts of the basic rules and bits per character (log2 of the perplexity) of each row; `documents` is read straight from files."""
    source = placed(documents, F.col(row_id).alias("row_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = SortedArrays(folder)
        for block, rows, texts in pieces(batches, 0, 3):
            points, counts = symbols(texts)
            code, _ = hashes(points, counts)
            table, bits = arrays.of(block)
            place = lookup(table, code)
            if (place < 0).any():
                raise ValueError("the documents changed between the two passes over them")
            upto = np.concatenate(([0.0], np.cumsum(bits[place], dtype=np.float64)))
            ends = np.cumsum(counts)
            total = upto[ends] - upto[ends - counts]
            mean = [float(t / n) if n else None for t, n in zip(total, counts, strict=True)]
            columns = list(zip(*[basic_counts(t.encode()) for t in texts], strict=True))
            yield pa.RecordBatch.from_arrays(
                [rows.column(1), rows.column(2), *[pa.array(c, pa.int64()) for c in columns], pa.array(mean, pa.float64())],
                names=["row_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "bits"],
            )

    id_type = source.schema["row_id"].dataType.simpleString()
    return source.mapInArrow(run, f"row_id {id_type}, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, bits double")


def bands(rows: DataFrame, width: float, least: float) -> DataFrame:
    """(lang, low, high): bounds of `bits` per language, `width` robust deviations (at least `least` bits each) from the median.

    Quartiles come from a histogram with BINS_PER_BIT bins a bit, so that no language is gathered anywhere.
    """
    bins = rows.groupBy("lang", F.floor(F.col("bits") * BINS_PER_BIT).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("lang").orderBy("bin")
    below = bins.select("lang", "bin", F.sum("n").over(running).alias("upto"), F.sum("n").over(Window.partitionBy("lang")).alias("all"))
    quartile = lambda q: (F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) + 0.5) / BINS_PER_BIT
    q = below.groupBy("lang").agg(quartile(0.25).alias("q1"), quartile(0.5).alias("q2"), quartile(0.75).alias("q3"))
    deviation = lambda a, b: F.greatest((F.col(b) - F.col(a)) / 0.6745, F.lit(least))
    return q.select("lang", (F.col("q2") - width * deviation("q1", "q2")).alias("low"), (F.col("q2") + width * deviation("q2", "q3")).alias("high"))


def quality_rules(
    documents: DataFrame, row_id: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | None = None,
    width: float = 5.0, least: float = 0.02, min_words: int = 50, max_repeated: int = 50, from_files: bool = False,
) -> DataFrame:
    """Per row: row_id, the counts of the basic rules, base_failed, kept, bits, and the language's low and high bound.

    `model` is trained on the documents themselves unless given. `from_files` says that `documents` is a table just read, whose splits can
    be read again; any other table is written to the shared folder first.
    """
    if not from_files:
        documents = written(documents.select(F.col(row_id).alias(row_id), F.col(lang).alias(lang), F.col(text).alias(text)))
    grams = written(block_grams(placed(documents, F.col(text).alias("text"))))
    folder = write_arrays(grams, model or fit(grams), model is None)
    rows = checkpointed(measured(documents, folder, row_id, text, lang)).withColumn(
        "base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    )
    limits = bands(rows.filter(~F.col("base_failed")), width, least).withColumnRenamed("lang", "of")
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("of")), "left").drop("of", "lang")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("bits").between(F.col("low"), F.col("high"))).withColumnRenamed("row_id", row_id)
