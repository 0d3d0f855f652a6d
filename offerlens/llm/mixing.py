"""Mixing sources to target weights by entropy balancing.

Each source is to contribute a target number of words. Among all document rates that reach it, entropy balancing takes those nearest to one copy each
(least Kullback-Leibler divergence, at most `most` copies). The solution tilts a document's rate exponentially with its size:
rate = min(most, exp(lambda * size / mean size of its source)). The convex dual has one unknown per source, found by Newton
iterations on log totals, kept inside a bracket; each iteration is one aggregation over (source, size, number) rows. Rates become whole copies
so that the rounding errors of size classes cancel: classes run from large to small, and each passes the words it missed on to the next.

Only DataFrame operations. The driver sees a few sums; sources and sizes stay distributed. Units of one size class are cut into parts
of about PART rows, so that a hot source is ranked by many tasks.

Defined results. A null text has size 0; rows of size 0 have one copy. A null source is a source, last in order. Rows equal in id, source and text
get the same number of copies each. Ties are broken by a hash of the id. The result is the same in every run. Extra columns pass
through `mixed`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions.durable import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
CLASSES_PER_DOUBLING = 16
PART = 1_000
PRECISION = 1e-9
MOST_ROUNDS = 100


def _numbered(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Sources with a number in code-point order, null last, and the weight of their place."""
    placed = checkpointed(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id()))
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = placed.withColumn("part", part).join(parts, "part").withColumn("number", F.col("start") + inside).drop("part", "start", "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    return checkpointed(number.withColumn("weight", weight))


def targets(sources: DataFrame, most: float) -> DataFrame:
    """Adds `target`: shares of all words by weight, stopped at `most` times the source's words, the excess shared again by weight."""
    total, share = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, cap = (total or 0) / (share or 1), F.col("source_size") * F.lit(float(most))
    while True:
        over = cap <= F.lit(level) * F.col("weight")
        stopped, free = sources.agg(F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        following = (total - stopped) / free if free else level
        if not free or following <= level * (1 + 1e-15):
            return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")).cast("double"))
        level = following


def tilts(sources: DataFrame, histogram: DataFrame, most: float) -> DataFrame:
    """Adds `tilt` per source: the dual solution for rate = min(most, exp(tilt * size / mean)). Null: every document is taken `most` times."""
    x = F.col("size") / F.col("mean")
    free = F.col("source_size") > 0
    start = sources.withColumn("mean", F.when(free, F.col("source_size") / F.col("worded"))).withColumn(
        "tilt", F.when(free & (F.col("target") < F.col("source_size") * most * (1 - 1e-12)), F.lit(0.0))
    )
    state = checkpointed(start.withColumn("low", F.lit(None).cast("double")).withColumn("high", F.lit(None).cast("double")))
    facts = sources.columns
    for _ in range(MOST_ROUNDS):
        rate = F.least(F.lit(float(most)), F.exp(F.least(F.col("tilt") * x, F.lit(50.0))))
        words = F.col("n") * F.col("size") * rate
        slope = F.when(rate < most, words * x).otherwise(0.0)
        sums = (
            histogram.join(state.filter("tilt IS NOT NULL").select("number", "tilt", "mean"), "number")
            .groupBy("number").agg(F.sum(words).alias("reached"), F.sum(slope).alias("slope"))
        )
        short = F.col("reached") < F.col("target")
        low, high = F.when(short, F.col("tilt")).otherwise(F.col("low")), F.when(short, F.col("high")).otherwise(F.col("tilt"))
        newton = F.col("tilt") - F.when(F.col("slope") > 0, (F.log("reached") - F.log("target")) * F.col("reached") / F.col("slope"))
        inside = newton.isNotNull() & (low.isNull() | (newton > low)) & (high.isNull() | (newton < high))
        halved = F.coalesce((low + high) / 2, F.when(short, F.col("tilt") + 1).otherwise(F.col("tilt") - 1))
        done = F.col("reached").isNull() | (F.abs(F.col("reached") - F.col("target")) <= PRECISION * F.col("target"))
        moved = F.when(done, F.col("tilt")).otherwise(F.when(inside, newton).otherwise(halved))
        state = checkpointed(state.join(sums, "number", "left").select(*facts, "mean", moved.alias("tilt"), low.alias("low"), high.alias("high"), done.alias("done")))
        if state.filter(~F.col("done")).limit(1).count() == 0:
            break
    return state.select(*facts, "mean", "tilt")


def _rounded(units: DataFrame) -> DataFrame:
    """Units (number, size, rate, u, ...) with whole copies."""
    whole = F.floor("rate").cast("long")
    units = units.withColumn("whole", whole).withColumn("part_rate", F.col("rate") - whole).withColumn("class", F.floor(F.log2(F.col("size").cast("double")) * CLASSES_PER_DOUBLING))
    exact, open_ = units.filter("size = 0 OR part_rate = 0"), units.filter("size > 0 AND part_rate > 0")
    sub = F.pmod(F.xxhash64("u", F.lit(2)), F.ceil(F.col("members") / PART))
    classes = open_.groupBy("number", "class").agg(F.count(F.lit(1)).alias("members"), F.sum("part_rate").alias("wanted"), F.sum(F.col("part_rate") * F.col("size")).alias("words"))
    # A source has at most CLASSES_PER_DOUBLING rows per doubling of size here, whatever its number of documents.
    per_source = classes.groupBy("number").agg(F.sort_array(F.collect_list(F.struct((-F.col("class")).alias("order"), "members", "wanted", "words"))).alias("rows"))

    def step(state, row):
        mean = row["words"] / row["wanted"]
        k = F.least(row["members"], F.greatest(F.lit(0).cast("long"), F.round((row["words"] + state["missed"]) / mean).cast("long")))
        picks = F.concat(state["picks"], F.array(F.struct((-row["order"]).alias("class"), row["members"].alias("members"), k.alias("picked"))))
        return F.struct((row["words"] + state["missed"] - k * mean).alias("missed"), picks.alias("picks"))

    empty = F.array().cast("array<struct<class:bigint,members:bigint,picked:bigint>>")
    picks = F.aggregate("rows", F.struct(F.lit(0.0).alias("missed"), empty.alias("picks")), step, lambda s: s["picks"])
    quota = checkpointed(per_source.select("number", F.explode(picks).alias("pick")).select("number", "pick.*"))
    parted = checkpointed(open_.join(quota, ["number", "class"]).withColumn("sub", sub))  # written, so that a hot class may be split in the join
    held = parted.groupBy("number", "class", "sub").agg(F.count(F.lit(1)).alias("n"), F.max("picked").alias("picked"), F.max("members").alias("members"))
    upto = F.sum("n").over(Window.partitionBy("number", "class").orderBy("sub"))
    share = lambda n: F.floor(F.col("picked") * n / F.col("members") + 1e-9)
    shares = held.withColumn("upto", upto).select("number", "class", "sub", (share(F.col("upto")) - share(F.col("upto") - F.col("n"))).alias("chosen"))
    rank = F.row_number().over(Window.partitionBy("number", "class", "sub").orderBy(F.col("u") / F.col("part_rate"), "u", "row_id"))
    ranked = parted.withColumn("rank", rank).join(shares, ["number", "class", "sub"])
    extra = (F.col("rank") <= F.col("chosen")).cast("long")
    columns = ["row_id", "text_hash", "number", "size", "repeats", "rate"]
    return exact.select(*columns, F.col("whole").alias("copies")).unionByName(ranked.select(*columns, (F.col("whole") + extra).alias("copies")))


def plan(documents: DataFrame, row_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """One row per distinct (id, source, text): row_id, text_hash, source, size, source_size, target, rate, copies, and repeats, the number of such rows."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = documents.select(F.col(row_id).alias("row_id"), F.col(source).cast("string").alias("source"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), size.alias("size"))
    units = checkpointed(rows.groupBy("row_id", "source", "text_hash", "size").agg(F.count(F.lit(1)).alias("repeats")))
    words = F.col("size") * F.col("repeats")
    summed = units.groupBy("source").agg(F.sum(words).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("repeats")).otherwise(0)).alias("worded"))
    sources = checkpointed(targets(_numbered(summed, weights), most))
    of = sources.select(F.col("source").alias("of"), "number")
    numbered = checkpointed(units.join(of, F.col("source").eqNullSafe(F.col("of"))).drop("source", "of"))
    histogram = checkpointed(numbered.filter("size > 0").groupBy("number", "size").agg(F.sum("repeats").alias("n")))
    solved = tilts(sources, histogram, most)
    x = F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("tilt").isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(x)))
    u = F.pmod(F.xxhash64("row_id", "text_hash", F.lit(1)), F.lit(1 << 53)) / float(1 << 53)
    rated = checkpointed(numbered.join(solved.select("number", "tilt", "mean"), "number").withColumn("rate", rate).withColumn("u", u).drop("tilt", "mean"))  # likewise a hot source
    copied = _rounded(rated)
    return copied.join(sources.select("number", "source", "source_size", "target"), "number").drop("number")


def mixed(documents: DataFrame, row_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: each document as many times as the plan says."""
    made = plan(documents, row_id, text, source, **options).filter("copies > 0").select(
        F.col("row_id").alias("__id"), F.col("source").alias("__source"), F.col("text_hash").alias("__hash"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy")
    )
    same = (
        documents[row_id].eqNullSafe(made["__id"]) & documents[source].cast("string").eqNullSafe(made["__source"])
        & (F.xxhash64(F.coalesce(documents[text], F.lit(""))) == made["__hash"])
    )
    return documents.join(made, same).select(documents["*"])
