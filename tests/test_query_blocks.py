"""Queries judged where a document is read equal the definition, in blocks of any size, and move no documents' grams or terms."""

import random

import numpy as np
import pytest
from test_search import distance

from offerlens.functions import text_scan
from offerlens.operators import query_blocks, search


def word(rng, letters="ABCÉЖ", most=9):
    return "".join(rng.choice(letters) for _ in range(rng.randrange(1, most)))


def frames(spark, seed, empty_queries=False):
    """Documents of two values with repeated and missing keys; queries of words and phrases, some of which only stand across two values."""
    rng = random.Random(seed)
    words = [word(rng) for _ in range(60)]
    rows = [(rng.choice([None, *range(25)]), [" ".join(rng.choices(words, k=rng.randrange(0, 12))), rng.choice(words) + "-" + rng.choice(words)]) for _ in range(40)]

    def token():
        return rng.choice([rng.choice(words), word(rng), f'"{rng.choice(words)} {rng.choice(words)}"', f"{rng.choice(words)}."])

    texts = [" ".join([token() for _ in range(rng.randrange(1, 4))] + [f"-{word(rng)}"] * (k % 3 == 0)) for k in range(60)]
    for _, (left, right) in rows[::5]:  # the last word of a value and the first of the next one
        if left:
            texts.append(f'"{left.split()[-1]} {right.split("-")[0]}"')
    texts += ["-A", "-ABC -B", "--"] * empty_queries
    docs = search.build_search_docs(spark.createDataFrame(rows, "entity_key long, values array<string>")).localCheckpoint()
    queries = spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(texts)] + [("q1", texts[1])], "query_id string, query string")
    return docs, search.parse_queries(queries).localCheckpoint(), queries


def close(a, b):
    most = 0 if len(a) <= 2 else 1 if len(a) <= 4 else 2 if len(a) <= 8 else 3
    return bool(most) and abs(len(a) - len(b)) <= most and distance(a, b) <= most


def sides(tokens, queries):
    out = {r["query_id"]: ([], []) for r in queries.collect()}
    for t in tokens.collect():
        out[t["query_id"]][t["exclude"]].append(t)
    return out


def hit(doc, token):
    return token["normalized"] in doc["text"] or token["compact"] in doc["compact_text"]


@pytest.mark.parametrize("block_tokens, cells, many", [(1 << 14, 1 << 24, 32), (7, 100, 1)])
def test_fuzzy_matches_equal_brute_force(spark, monkeypatch, block_tokens, cells, many):
    for name, value in (("BLOCK_TOKENS", block_tokens), ("CELLS", cells), ("MANY", many), ("TERM_PAIRS", cells), ("MATCHES", cells)):
        monkeypatch.setattr(query_blocks, name, value)
    docs, tokens, queries = frames(spark, 3)
    want = sorted((q, d["entity_key"]) for q, (include, exclude) in sides(tokens, queries).items() for d in docs.collect()
                  if d["entity_key"] is not None and not any(hit(d, t) for t in exclude) and all(hit(d, t) or any(close(t["compact"], x) for x in d["terms"]) for t in include))
    assert len(want) > 100
    assert sorted(tuple(r) for r in search.match_queries(docs, tokens, queries, fuzzy=True).collect()) == want


def test_fuzzy_matching_moves_no_grams_or_terms(spark, monkeypatch):
    docs, tokens, queries = frames(spark, 4)
    for name in ("gram_index", "fuzzy_terms"):
        monkeypatch.setattr(search, name, lambda *a: pytest.fail("documents are taken apart and moved"))
    plan = search.match_queries(docs, tokens, queries, fuzzy=True)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_strings_in_texts_equal_brute_force(monkeypatch):
    monkeypatch.setattr(text_scan, "PIECE", 300)
    rng = random.Random(6)
    strings = sorted({word(rng, "AB𝄞\0", 14) for _ in range(300)})
    texts = ["", "A", *(word(rng, "AB𝄞\0", 60) for _ in range(150))]
    got = text_scan.Strings(strings).found_in(texts)
    assert (got == np.array([[s in t for t in texts] for s in strings])).all()
    assert text_scan.Strings([]).found_in(texts).shape == (0, len(texts))


def test_distances_within_limits_equal_brute_force(monkeypatch):
    monkeypatch.setattr(text_scan, "PAIRS", 777)
    rng = random.Random(7)
    left, right = (sorted({word(rng, "AB𝄞", 14) for _ in range(120)} | {"A" * 130, "AB" * 64}, key=len) for _ in range(2))
    sizes, ends = (np.array([len(s) for s in side]) for side in (left, right))
    pairs = np.indices((len(left), len(right))).reshape(2, -1)
    limits = np.minimum(sizes // 3, 3)
    got = text_scan.within(text_scan.padded(left, sizes), sizes, text_scan.padded(right, ends), ends, limits, (pairs[0], pairs[1]), 3)
    true = np.array([distance(left[a], right[b]) for a, b in pairs.T])
    assert (got == (true <= limits[pairs[0]])).all()
    apart = np.bitwise_count(text_scan.signatures(text_scan.padded(left, sizes))[pairs[0]] ^ text_scan.signatures(text_scan.padded(right, ends))[pairs[1]])
    assert (apart + np.abs(sizes[pairs[0]] - ends[pairs[1]]) <= 2 * true).all()


@pytest.mark.parametrize("fuzzy", [False, True])
@pytest.mark.parametrize("block_tokens, cells", [(1 << 14, 1 << 24), (7, 100)])
def test_matches_of_any_token_equal_brute_force(spark, monkeypatch, fuzzy, block_tokens, cells):
    for name, value in (("BLOCK_TOKENS", block_tokens), ("LIST_CELLS", cells), ("MATCHES", cells)):
        monkeypatch.setattr(query_blocks, name, value)
    docs, tokens, queries = frames(spark, 5)
    keyed = docs.filter("entity_key IS NOT NULL")
    by_query, rows = sides(tokens, queries), keyed.collect()

    def met(d, t):
        return hit(d, t) or fuzzy and any(close(t["compact"], x) for x in d["terms"])

    # Rows of one key are judged together: a token excluded in one of them rules the key out.
    out = {(q, d["entity_key"]) for q, (_, exclude) in by_query.items() for d in rows if any(hit(d, t) for t in exclude)}
    want = {(q, d["entity_key"]) for q, (include, _) in by_query.items() for d in rows if any(met(d, t) for t in include)} - out
    got = [tuple(r) for r in search.match_queries(keyed if fuzzy else docs, tokens, queries, mode="OR", fuzzy=fuzzy).collect()]
    assert len(want) > 300 and sorted(got) == sorted(want)


def test_queries_without_included_tokens_match_all_other_documents(spark):
    docs, tokens, queries = frames(spark, 8, empty_queries=True)
    rows = docs.collect()
    bare = {q: exclude for q, (include, exclude) in sides(tokens, queries).items() if not include}
    out = {(q, d["entity_key"]) for q, exclude in bare.items() for d in rows if any(hit(d, t) for t in exclude)}
    want = sorted((q, str(d["entity_key"])) for q in bare for d in rows if d["entity_key"] is None or (q, d["entity_key"]) not in out)
    got = search.match_queries(docs, tokens, queries, mode="OR").collect()
    assert len(bare) == 3 and sorted((r["query_id"], str(r["entity_key"])) for r in got if r["query_id"] in bare) == want


def test_any_moves_lists_of_queries_only(spark, monkeypatch):
    docs, tokens, queries = frames(spark, 4)
    monkeypatch.setattr(search, "gram_index", lambda *a: pytest.fail("documents are taken apart and moved"))
    found = search.match_queries(docs, tokens, queries, mode="OR")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert found.count() > 0


@pytest.mark.parametrize("options", [{"fuzzy": True}, {"mode": "OR"}, {"mode": "OR", "fuzzy": True}])
def test_empty_tables_and_queries_of_exclusions_only(spark, options):
    docs = search.build_search_docs(spark.createDataFrame([(1, ["ab cd"]), (2, ["ef"]), (3, [])], "entity_key long, values array<string>")).localCheckpoint()
    queries = spark.createDataFrame([(1, "-ef"), (2, "--"), (3, "abcd")], "query_id long, query string")

    def got(d, q):
        return sorted(tuple(r) for r in search.match_queries(d, search.parse_queries(q), q, **options).collect())

    assert got(docs, queries) == [(1, 1), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1)]
    assert got(docs.filter("entity_key > 3"), queries) == got(docs, queries.filter("query_id > 3")) == []
