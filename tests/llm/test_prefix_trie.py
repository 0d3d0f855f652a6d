"""The prefix trie against a plain one built from dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from offerlens.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, depth string, sig int, low int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:3])] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def plain(convs):
    """Rows of the trie from every prefix of every conversation."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = sum(saved[c] for c in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items())


def found(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def as_conversations(spark, convs):
    """Turns of given conversations, none of them without a turn."""
    return prefix_trie.conversations(table(spark, [(c, i, role, text) for c, ts in convs.items() for i, (role, text) in enumerate(ts)]))


def registered(spark, rows, folder):
    table(spark, rows).write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
    return found(queries.QUERIES["op13_prefix_trie"](spark, str(folder)))


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    rows = spark.createDataFrame(pairs, "a int, b int").withColumn("f", prefix_trie.two_fattest(F.col("a"), F.col("b"))).collect()
    assert all(r["f"] == max(range(r["a"] + 1, r["b"] + 1), key=lambda x: x & -x) for r in rows)


def test_random_conversations(spark, tmp_path):
    rng = random.Random(11)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice("abé")) for c in range(160) if c % 7 for t in range(rng.choice([1, 2, 3, 9, 14]))]
    rows += [(500, t, "user", "a") for t in range(60)] + [(502, t, "user", "a") for t in range(33)]
    rng.shuffle(rows)
    assert registered(spark, rows, tmp_path) == plain(rebuilt(rows))


def test_odd_rows(spark, tmp_path):
    rows = [
        (None, 1, "user", "no id"), (7, None, None, None), (7, 1, "user", "x" * 300_000), (7, 2, "user", ""), (12, 5, "user", "same"), (12, 5, "user", "same"),
        (-3, 0, "user", "negative"), (-1, 0, "user", "negative"), (3, 0, "a", "bc"), (4, 0, "ab", "c"), (9_000_000_000, 1, "user", "東京"), (9_000_000_003, 2, "user", "東京"),
    ]
    assert registered(spark, rows, tmp_path) == plain(rebuilt(rows))
    assert registered(spark, [], tmp_path) == []


def test_nested_chain_and_copies(spark):
    """Conversations that are prefixes of each other, and one that many repeat."""
    line = [("user", f"t{i}") for i in range(70)]
    convs = {i: line[: i + 1] for i in range(70)} | {100 + i: line[:5] for i in range(400)} | {600 + i: [*line[:i], ("user", f"away {i}"), ("user", "tail")] for i in range(40)}
    assert found(prefix_trie.trie(as_conversations(spark, convs))) == plain(convs)


def test_many_ends_are_hashed_in_pieces(spark):
    convs = {i * 37 - 90_000: [("user", "same")] for i in range(9_000)}
    assert found(prefix_trie.trie(as_conversations(spark, convs))) == plain(convs)


def test_compacted_nodes(spark):
    """Nodes only where conversations end or part, each found again by its handle and name."""
    convs = {1: [("u", "a")] * 6, 2: [("u", "a")] * 3 + [("u", "b")], 3: [("u", "a")] * 3, 4: [("u", "c")] * 8}
    folder = prefix_trie.Folder(spark)
    strings = prefix_trie.strings(as_conversations(spark, convs)).withColumn("end", prefix_trie.signature(F.col("chain"), F.col("size")))
    rows = prefix_trie.build(folder, folder.written(strings)).collect()
    assert sorted((r["parent_depth"], r["depth"]) for r in rows) == [(0, 3), (0, 8), (3, 4), (3, 6)]
    for r in rows:
        edge = [bytes(r["edge"][i : i + 16]) for i in range(0, len(r["edge"]), 16)]
        handle = max(range(r["parent_depth"] + 1, r["depth"] + 1), key=lambda x: x & -x)
        assert edge[handle - r["parent_depth"] - 1] == r["handle"] and edge[0] == r["name"] and edge[-1] == r["sig"]
