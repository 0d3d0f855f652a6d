"""Line deduplication by distinct-site spread.

A line that stands on many sites is boilerplate. Each line hash gets a HyperLogLog sketch of its sites; sketches are built per task
and merged by the aggregation, so a line of any frequency costs one sketch per task. Where the estimate is near the
threshold, the sites are counted exactly (distinct pairs first, then one count). Boilerplate is then deleted from every document but the first
one that holds it, so no line leaves the corpus altogether and widely copied documents are not emptied everywhere.

Only DataFrame operations. With `max_words` longer lines count as prose and stay, on however many sites; without (None) lines of every length are judged alike.

Defined results. Lines are cut at U+000A and compared without white space at their ends. Lines of no word or over `max_words` words stay.
A null site is no site, but its documents lose boilerplate like others. A null text stays null; a text whose
lines are all deleted becomes empty. Rows with a null or repeated id are treated by their own lines. Extra columns pass through unless they have an output
column's name (`n_lines`, `n_removed`), which they then lose. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.durable import checkpointed
from offerlens.llm.names import free_name

WORD = r"[^\x20\x09-\x0D]+"
EDGES = " \t\r\x0b\x0c"
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def _key(line: Column) -> Column:
    """128 bits of a line without white space at its ends; the second half starts from another seed, so it does not follow from the first."""
    bare = F.btrim(line, F.lit(EDGES))
    return F.struct(F.xxhash64(bare).alias("k1"), F.xxhash64(F.lit(1), bare).alias("k2"))


def _judged(line: Column, max_words: int | None) -> Column:
    if max_words is None:
        return line.rlike(WORD)
    n = F.regexp_count(line, F.lit(WORD))
    return (n > 0) & (n <= max_words)


def judged_lines(documents: DataFrame, row_id: str, text: str, site: str, max_words: int | None) -> DataFrame:
    """(row_id, site, k1, k2): each distinct judged line of each document."""
    lines = F.filter(F.split(text, "\n"), lambda x: _judged(x, max_words))
    keys = F.array_distinct(F.transform(lines, _key))
    return documents.select(F.col(row_id).alias("row_id"), F.col(site).cast("string").alias("site"), F.explode(keys).alias("key")).select("row_id", "site", "key.*")


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(k1, k2, first_id) of the lines that stand on at least `min_sites` sites."""
    sketched = (
        lines.groupBy("k1", "k2")
        .agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"), F.count("site").alias("n"), F.min("row_id").alias("first_id"))
        .filter(F.col("n") >= min_sites)
        .select("k1", "k2", "first_id", F.hll_sketch_estimate("sketch").alias("sites"))
    )
    margin = max(1.0, 4 * SKETCH_ERROR * min_sites)
    sure = sketched.filter(F.col("sites") > min_sites + margin).select("k1", "k2", "first_id")
    near = sketched.filter(F.col("sites").between(min_sites - margin, min_sites + margin)).select("k1", "k2", "first_id")
    pairs = lines.filter("site IS NOT NULL").join(near.select("k1", "k2"), ["k1", "k2"], "left_semi").select("k1", "k2", "site").distinct()
    exact = pairs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("sites")).filter(F.col("sites") >= min_sites)
    return sure.unionByName(near.join(exact.select("k1", "k2"), ["k1", "k2"], "left_semi"))


def remove_boilerplate(
    documents: DataFrame, row_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = 8, max_words: int | None = None, counts: bool = True,
) -> DataFrame:
    """The documents without boilerplate lines; with `counts` also n_lines and n_removed (long, 0 for a null text)."""
    lines = checkpointed(judged_lines(documents, row_id, text, site, max_words))
    found = checkpointed(boilerplate(lines, min_sites))
    struck = lines.join(found, ["k1", "k2"]).filter(~F.col("row_id").eqNullSafe(F.col("first_id")))
    rest = documents.drop("n_lines", "n_removed") if counts else documents
    keys, owner, kept_lines = (free_name(rest, n) for n in ("struck", "struck_id", "kept_lines"))
    per_row = struck.groupBy(F.col("row_id").alias(owner)).agg(F.collect_set(F.struct("k1", "k2")).alias(keys))  # at most a document's lines
    joined = rest.join(per_row, F.col(row_id).eqNullSafe(F.col(owner)), "left")
    all_lines = F.split(text, "\n")
    kept = F.filter(all_lines, lambda x: ~(_judged(x, max_words) & F.array_contains(F.col(keys), _key(x))))
    hit = F.col(keys).isNotNull() & F.col(text).isNotNull()
    out = joined.withColumn(kept_lines, F.when(hit, kept))
    if counts:
        n = F.when(F.col(text).isNull(), 0).otherwise(F.size(all_lines))
        out = out.withColumn("n_lines", n.cast("long")).withColumn("n_removed", F.when(hit, n - F.size(kept_lines)).otherwise(0).cast("long"))
    return out.withColumn(text, F.when(hit, F.array_join(kept_lines, "\n")).otherwise(F.col(text))).drop(keys, owner, kept_lines)
