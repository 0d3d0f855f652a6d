"""Prefix trie of conversations as a Z-fast trie of Spark tables.

A conversation is a string of turns. The signature of a prefix is 128 bits, the running sum of hashes of (place, role, text), so one string
has a chain of signatures, 24 bytes a turn with the text's length. The trie is compacted: a node stands for the end of a conversation or a place where
conversations part, its edge runs from the parent's depth to its own. Nodes are hashed by the signature at their handle, the two-fattest
depth of the edge (the number in it divisible by the highest power of two).

Locating: fat binary search halves the open depths of every string in one join with the handles, about log2(turns) joins, each
over the strings that are still open. One more join by the first signature of an edge gives the exit edge and the place where string and edge part. Inserting in batches: of the strings
that part at the same place and go on alike one is inserted (the smallest signature, so a random one), all edges are split and all such leaves
attached at once; the others go on from there. As representatives are random, about log(strings) batches are enough for tries of any shape. Copies of a
conversation are combined first and never searched. Every round is a written table.

Then counts are summed over subtrees by pointer doubling, log2(nodes on a path) rounds of map-side combined sums, and edges are
expanded to one row per depth. Ids of conversations that end at a node are joined into pieces of at most 4,096 ids each and hashed
piece by piece in order, so a node with a third of all conversations is never held as one value.

Defined results. A null role or text is empty. Turns go by turn number, null first; turns with the same number by role, then by hash of the text; repeated rows are
turns of their own. Rows with a null conversation id take no part. An empty table gives an empty trie without a root. One conversation is one row of 24 bytes a
turn, however long its texts. Other columns are not used.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions.durable import shared_folder
from offerlens.functions.skew import spread_join

ROOT = bytes(16)
PIECE_BITS = 12
NO_ENDS = hashlib.sha256().hexdigest()
TURN = "array<struct<k1:bigint,k2:bigint,bytes:bigint>>"


class Folder:
    """Tables written by the steps of one build, in the folder that all executors share."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.made = spark, f"{shared_folder(spark)}/trie-{uuid.uuid4().hex}", 0

    def written(self, df: DataFrame) -> DataFrame:
        self.made += 1
        df.write.parquet(f"{self.path}/{self.made}")
        return self.spark.read.parquet(f"{self.path}/{self.made}")


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation as two hashes and the text's bytes per turn, in order."""
    said, by = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    # The second hash starts from another seed, so that it does not follow from the first.
    one = F.struct(F.col(turn).alias("turn"), by.alias("role"), F.xxhash64(by, said).alias("k1"), F.xxhash64(F.lit(1), by, said).alias("k2"), F.octet_length(said).cast("long").alias("bytes"))
    ordered = turns.filter(F.col(conv_id).isNotNull()).groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return ordered.withColumn("turns", F.transform("turns", lambda t: F.struct(t["k1"].alias("k1"), t["k2"].alias("k2"), t["bytes"].alias("bytes"))))


def strings(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, size, chain, cum): signatures (16 bytes each) and summed bytes of all prefixes, the empty one first."""

    def scrambled(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            place = np.arange(len(flat), dtype=np.int64) - np.repeat(starts, sizes)
            lanes = []
            for k, seed in ((0, 0x9E3779B97F4A7C15), (1, 0xC2B2AE3D27D4EB4F)):
                h = flat.field(k).to_numpy(zero_copy_only=False).view(np.uint64)
                lanes.append(scrambled(h ^ scrambled((place + 1).astype(np.uint64) * np.uint64(seed))))
            lengths = flat.field(2).to_numpy(zero_copy_only=False)
            chains, sums = [], []
            for first, n in zip(starts.tolist(), sizes.tolist(), strict=True):
                chain = np.zeros((n + 1, 2), np.uint64)
                for k in (0, 1):
                    np.cumsum(lanes[k][first : first + n], out=chain[1:, k])
                chains.append(chain.tobytes())
                sums.append(np.concatenate(([0], np.cumsum(lengths[first : first + n]))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes.astype(np.int32)), pa.array(chains, pa.binary()), pa.array(sums, pa.list_(pa.int64()))], names=["conv_id", "size", "chain", "cum"])

    id_type = rebuilt.schema["conv_id"].dataType.simpleString()
    return rebuilt.select("conv_id", "turns").mapInArrow(run, f"conv_id {id_type}, size int, chain binary, cum array<bigint>")


def signature(chain: Column, depth: Column, count: Column | int = 1) -> Column:
    """`count` signatures of a chain from a depth on."""
    return F.substring(chain, depth * 16 + 1, (F.lit(count) if isinstance(count, int) else count) * 16)


def two_fattest(above: Column, to: Column) -> Column:
    """The number in (above, to] divisible by the highest power of two."""
    zeros = F.length(F.bin((above.bitwiseXOR(to)).cast("long"))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", to, zeros), zeros)


def _nodes(df: DataFrame) -> DataFrame:
    """Adds the keys of the hash tables: the handle's signature and the edge's first one."""
    handle = two_fattest(F.col("parent_depth"), F.col("depth")) - F.col("parent_depth") - 1
    return df.withColumn("handle", signature(F.col("edge"), handle)).withColumn("name", signature(F.col("edge"), F.lit(0)))


NODE = ["sig", "depth", "parent", "parent_depth", "edge", "cum"]


def locate(folder: Folder, pending: DataFrame, nodes: DataFrame, fresh: bool) -> DataFrame:
    """pending(..., size, chain, low) with the deepest passed node and the exit edge.

    Adds exit (its node's signature, null if none leaves that way), exit_depth, met (depth where string and trie part). Of `low` it is known that the string passes a node of that depth.
    """
    done = pending
    if not fresh:
        table = nodes.select("handle", F.col("sig").alias("n_sig"), F.col("depth").alias("n_depth"), F.col("parent_depth").alias("n_parent"))
        parts, active = [], pending.withColumn("high", F.col("size"))
        while True:
            closed = F.col("low") >= F.col("high")
            parts.append(active.filter(closed).drop("high"))
            open_ = active.filter(~closed)
            if open_.isEmpty():
                break
            probe = open_.withColumn("probe", two_fattest(F.col("low"), F.col("high")))
            met = probe.join(table, signature(F.col("chain"), F.col("probe")) == F.col("handle"), "left")
            passed = F.col("n_sig").isNotNull() & (F.col("n_depth") <= F.col("size")) & (signature(F.col("chain"), F.col("n_depth")) == F.col("n_sig"))
            low = F.when(passed, F.col("n_depth")).when(F.col("n_sig").isNotNull(), F.col("n_parent")).otherwise(F.col("low"))
            high = F.when(passed, F.col("high")).when(F.col("n_sig").isNotNull(), F.col("n_parent")).otherwise(F.col("probe") - 1)
            active = folder.written(met.select(*pending.drop("low").columns, low.alias("low"), high.alias("high")))
        done = parts[0]
        for part in parts[1:]:
            done = done.unionByName(part)
    edges = nodes.select("name", F.col("sig").alias("exit"), F.col("depth").alias("exit_depth"), F.col("edge").alias("exit_edge"))
    onward = F.when(F.col("low") < F.col("size"), signature(F.col("chain"), F.col("low") + 1))
    found = done.withColumn("_onward", F.coalesce(onward, F.col("chain"))).join(edges, F.col("_onward") == F.col("name"), "left")
    shared = F.least(F.col("size"), F.col("exit_depth")) - F.col("low")
    alike = F.filter(F.sequence(F.lit(1), shared), lambda i: signature(F.col("chain"), F.col("low") + i) == signature(F.col("exit_edge"), i - 1))
    met = F.when(F.col("exit").isNull(), F.col("low")).otherwise(F.col("low") + F.size(alike))
    return found.withColumn("met", met).drop("_onward", "name", "exit_edge")


def split(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """Nodes with every edge cut at its places(sig, at): an upper piece per place, the node keeps the rest."""
    cuts = places.groupBy("sig").agg(F.sort_array(F.collect_set("at")).alias("cuts"))
    own = nodes.join(cuts, "sig", "left")
    ends = F.concat(F.coalesce("cuts", F.array().cast("array<int>")), F.array("depth"))
    starts = F.concat(F.array("parent_depth"), F.coalesce("cuts", F.array().cast("array<int>")))
    pieces = own.withColumn("piece", F.explode(F.arrays_zip(starts.alias("above"), ends.alias("to"))))
    above, to, top = F.col("piece.above"), F.col("piece.to"), F.col("parent_depth")
    return pieces.select(
        signature(F.col("edge"), to - top - 1).alias("sig"), to.alias("depth"),
        F.when(above == top, F.col("parent")).otherwise(signature(F.col("edge"), above - top - 1)).alias("parent"), above.alias("parent_depth"),
        signature(F.col("edge"), above - top, to - above).alias("edge"), F.slice("cum", above - top + 1, to - above + 1).alias("cum"),
    )


def build(folder: Folder, texts: DataFrame) -> DataFrame:
    """Compacted nodes (sig, depth, parent, parent_depth, edge, cum, handle, name), without the root, of distinct strings(end, size, chain, cum)."""
    pending = texts.filter("size > 0").select("end", "size", "chain", "cum").withColumn("low", F.lit(0))
    nodes = folder.written(_nodes(folder.spark.createDataFrame([], "sig binary, depth int, parent binary, parent_depth int, edge binary, cum array<bigint>")))
    fresh = True
    while fresh or not pending.isEmpty():
        located = folder.written(locate(folder, pending, nodes, fresh))
        inside = (F.col("met") < F.col("exit_depth")) & F.col("exit").isNotNull()
        cut = split(nodes.select(*NODE), located.filter(inside).select(F.col("exit").alias("sig"), F.col("met").alias("at")))
        longer = located.filter("met < size").withColumn("next", signature(F.col("chain"), F.col("met") + 1))
        chosen = longer.groupBy("next").agg(F.min("end").alias("end"))
        leaves = longer.join(chosen, ["next", "end"]).select(
            F.col("end").alias("sig"), F.col("size").alias("depth"), signature(F.col("chain"), F.col("met")).alias("parent"), F.col("met").alias("parent_depth"),
            signature(F.col("chain"), F.col("met") + 1, F.col("size") - F.col("met")).alias("edge"), F.slice("cum", F.col("met") + 1, F.col("size") - F.col("met") + 1).alias("cum"))
        nodes = folder.written(_nodes(cut.unionByName(leaves)))
        waiting = longer.join(chosen.select(F.col("end")), "end", "left_anti")
        pending = folder.written(waiting.select("end", "size", "chain", "cum", F.col("met").alias("low")))
        fresh = False
    return nodes


SUMS = ["n_convs", "ended_bytes", "edge_bytes", "n_leaves"]


def subtree_sums(folder: Folder, nodes: DataFrame) -> DataFrame:
    """nodes(sig, parent, first_conv, SUMS) with these summed (first_conv: smallest) over each node's subtree, by pointer doubling."""
    total = [F.sum(c).alias(c) for c in SUMS]
    held = folder.written(nodes.withColumn("up", F.col("parent")))
    while not (linked := held.filter("up IS NOT NULL")).isEmpty():
        given = linked.groupBy(F.col("up").alias("sig")).agg(F.min("first_conv").alias("first_conv"), *total)
        merged = held.select("sig", "first_conv", *SUMS).unionByName(given).groupBy("sig").agg(F.min("first_conv").alias("first_conv"), *total)
        # What hangs on the root has no further pointer; all other nodes take that of the node they point to.
        further = held.filter((F.col("up") != ROOT) & F.col("up").isNotNull()).select("sig", "up")
        jumped = spread_join(further, held.select(F.col("sig").alias("up"), F.col("up").alias("next")), ["up"]).select("sig", F.col("next").alias("up"))
        own = held.select("sig", "parent").join(merged, "sig").join(jumped, "sig", "left")
        held = folder.written(own)
    return held.drop("up")


def ends_digests(members: DataFrame) -> DataFrame:
    """(sig, ends_sha256) of members(conv_id, end): hash of the ascending ids of each end, joined by commas."""
    pieces = members.groupBy(F.col("end").alias("sig"), F.shiftright(F.col("conv_id").cast("long"), PIECE_BITS).alias("piece")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        for batch in batches:
            sigs, out = [], []
            for sig, ids in zip(batch.column(0), batch.column(1), strict=True):
                sig, ids = sig.as_py(), ids.as_py()
                if sig != current:
                    if current is not None:
                        sigs.append(current)
                        out.append(digest.hexdigest())
                    current, digest = sig, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), pa.array(out, pa.string())], names=["sig", "ends_sha256"])
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([digest.hexdigest()])], names=["sig", "ends_sha256"])

    ordered = pieces.repartition(F.col("sig")).sortWithinPartitions("sig", "piece").select("sig", "ids")
    return ordered.mapInArrow(run, "sig binary, ends_sha256 string")


def trie(rebuilt: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations in rebuilt(conv_id, turns).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256); a node is named by its smallest member and its depth.
    """
    spark = rebuilt.sparkSession
    folder = Folder(spark)
    members = folder.written(strings(rebuilt).withColumn("end", signature(F.col("chain"), F.col("size"))))
    tally = members.groupBy("end").agg(F.min("conv_id").alias("first_conv"), F.count(F.lit(1)).alias("n_convs"))
    one_each = members.join(tally.select("end", F.col("first_conv").alias("conv_id")), ["end", "conv_id"])
    texts = folder.written(one_each.select("end", "size", "chain", "cum"))
    nodes = build(folder, texts)

    ended = tally.join(texts.select("end", F.element_at("cum", -1).alias("last")), "end").select(F.col("end").alias("sig"), "first_conv", "n_convs", (F.col("n_convs") * F.col("last")).alias("ended_bytes"))
    children = nodes.groupBy(F.col("parent").alias("sig")).agg(F.count(F.lit(1)).alias("n_children"))
    root = members.limit(1).select(F.lit(ROOT).alias("sig"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("edge_bytes"))
    own = nodes.select("sig", "parent", (F.element_at("cum", -1) - F.col("cum")[0]).alias("edge_bytes")).unionByName(root)
    shape = folder.written(own.join(ended, "sig", "left").join(children, "sig", "left").fillna(0, ["n_convs", "ended_bytes", "n_children"]))
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    summed = subtree_sums(folder, shape.withColumn("n_leaves", leaf).select("sig", "parent", "first_conv", *SUMS))

    edges = nodes.select("sig", "depth", "parent_depth", "cum").unionByName(
        root.select("sig", F.lit(0).alias("depth"), F.lit(-1).alias("parent_depth"), F.array(F.lit(0), F.lit(0)).cast("array<bigint>").alias("cum")))
    whole = summed.join(edges, "sig").join(shape.select("sig", "n_children"), "sig").join(ends_digests(members.select("conv_id", "end")), "sig", "left")
    named = summed.select(F.col("sig").alias("parent"), F.col("first_conv").alias("parent_conv"))
    whole = folder.written(spread_join(whole, named, ["parent"], "left"))
    # Along an edge the members are those of its node; an inner place has one child and no ends.
    steps = whole.withColumn("depth_here", F.explode(F.sequence(F.col("parent_depth") + 1, F.col("depth"))))
    last, first = F.col("depth_here") == F.col("depth"), F.col("depth_here") == F.col("parent_depth") + 1
    # Bytes said by every member below the edge's top, less each distinct turn once; then less the part of the edge above this place.
    whole_edge = F.col("ended_bytes") - F.col("n_convs") * F.col("cum")[0] - F.col("edge_bytes")
    above = F.col("cum")[F.col("depth_here") - F.col("parent_depth") - 1] - F.col("cum")[0]
    return steps.select(
        F.col("first_conv").alias("conv_id"), F.col("depth_here").cast("long").alias("depth"),
        F.when(first, F.col("parent_conv")).otherwise(F.col("first_conv")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
        (whole_edge - (F.col("n_convs") - 1) * above).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"),
    )


def with_donor(own: DataFrame, donor: Column, taken: Column, most: int) -> DataFrame:
    """Conversations whose first `taken` turns (at most `most`) come from conversation `donor`, the rest from their own turns after these."""
    asked = own.select("conv_id", "turns", donor.alias("_donor"), taken.cast("int").alias("_taken"))
    given = own.select(F.col("conv_id").alias("_donor"), F.slice("turns", 1, most).alias("_given"))
    # Each donor gives to a fixed number of conversations, so no key is hot.
    joined = asked.join(given, "_donor", "left")
    head = F.slice(F.coalesce("_given", F.array().cast(TURN)), F.lit(1), F.col("_taken"))
    tail = F.slice("turns", F.col("_taken") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.concat(head, tail).alias("turns"))


def own_and_donors(turns: DataFrame, donor: Callable[[Column], Column], taken: Callable[[Column], Column], most: int) -> DataFrame:
    """Rebuilt conversations of a turns table."""
    return with_donor(conversations(turns), donor(F.col("conv_id")), taken(F.col("conv_id")), most)
