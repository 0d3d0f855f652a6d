"""Saved queries judged where a document is read: blocks of queries against groups of documents.

A task reads the written queries a block at a time, so its memory is bounded by a block and a group however many queries and documents there are. A document's
tokens are found in one pass over its text, and its queries are judged from them without leaving the row.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from offerlens.functions import durable, text_scan
from offerlens.functions.durable import parquet_batches
from offerlens.functions.text_scan import Strings, padded, signatures, within

BLOCK_TOKENS = 1 << 14
GROUP_ROWS = 2048
CELLS = 1 << 24
LIST_CELLS = 1 << 22
TERM_PAIRS = 1 << 21
MATCHES = 1 << 21
MANY = 32
NONE, UNKNOWN = -1, -2


class Block:
    """Some queries with their distinct tokens (normalized, compact)."""

    def __init__(self, ids: pa.Array, include: list[list[tuple[str, str]]], exclude: list[list[tuple[str, str]]]):
        self.ids, numbers = ids, {}
        self.include, self.exclude = ([[numbers.setdefault(t, len(numbers)) for t in dict.fromkeys(tokens)] for tokens in side] for side in (include, exclude))
        self.tokens = list(numbers)
        compacts = {c: k for k, c in enumerate(dict.fromkeys(c for _, c in self.tokens if c))}
        self.compacts = Strings(list(compacts))
        self.compact_of = np.array([compacts.get(c, len(compacts)) for _, c in self.tokens], np.int64)
        # A token without a blank lies within one value, and so does its compact form; only others can reach over the blank between two values.
        spaced: dict[str, list[int]] = {}
        for k, (n, c) in enumerate(self.tokens):
            if c and " " in n:
                spaced.setdefault(c, []).append(k)
        self.spaced, self.over, self.reach = Strings(list(spaced)), list(spaced.values()), max(map(len, spaced), default=0)

    def rows(self, cells: int) -> int:
        """Documents of a group, so that the tables of documents and tokens stay below so many cells."""
        return max(1, min(GROUP_ROWS, cells // max(1, sum(map(len, self.include)) + sum(map(len, self.exclude)) + len(self.ids))))

    def hits(self, texts: list[str], compact_texts: list[str]) -> np.ndarray:
        """Which token (row) a document (column) contains."""
        compact = np.concatenate((self.compacts.found_in(compact_texts), np.zeros((1, len(texts)), bool)))
        out = compact[self.compact_of]
        if self.reach:
            for row, doc in np.argwhere(self._over_blanks(compact_texts)):
                for token in self.over[row]:
                    out[token, doc] = out[token, doc] or self.tokens[token][0] in texts[doc]
        return out

    def _over_blanks(self, compact_texts: list[str]) -> np.ndarray:
        """Which compact form of a token with a blank (row) may reach over the end of a value of a document (column): it stands where the values' ends meet."""
        windows, of = [], []
        for k, text in enumerate(compact_texts):
            ends, whole = [], text.replace(" ", "")
            at = text.find(" ")
            while at >= 0 and 2 * self.reach * len(ends) <= len(whole):
                ends.append(at - len(ends))
                at = text.find(" ", at + 1)
            parts = [whole[max(0, e - self.reach) : e + self.reach] for e in ends] if at < 0 else [whole]
            windows += parts
            of += [k] * len(parts)
        out = np.zeros((len(self.over), len(compact_texts)), bool)
        row, window = np.nonzero(self.spaced.found_in(windows))
        out[row, np.array(of, np.int64)[window]] = True
        return out

    def any_of(self, hits: np.ndarray, side: list[list[int]]) -> np.ndarray:
        """Which query (row) has a token of that side in a document (column)."""
        out = np.zeros((len(self.ids), hits.shape[1]), bool)
        held = [k for k, tokens in enumerate(side) if tokens]
        if held and hits.shape[1]:
            starts = np.cumsum([0, *(len(side[k]) for k in held[:-1])])
            out[held] = np.logical_or.reduceat(hits[np.concatenate([side[k] for k in held])], starts, axis=0)
        return out


def _blocks(path: str) -> Iterator[Block]:
    held: list[pa.RecordBatch] = []
    n = 0

    def block() -> Block:
        t = pa.Table.from_batches(held)
        sides = [[[(x["normalized"], x["compact"]) for x in tokens] for tokens in t[side].to_pylist()] for side in ("include", "exclude")]
        return Block(t["query_id"].combine_chunks(), *sides)

    for batch in parquet_batches(path, ["query_id", "include", "exclude"]):
        sizes = np.cumsum(1 + pc.list_value_length(batch["include"]).to_numpy(False) + pc.list_value_length(batch["exclude"]).to_numpy(False))
        first = 0
        while first < len(sizes):
            before = sizes[first - 1] if first else 0
            last = max(int(np.searchsorted(sizes, BLOCK_TOKENS - n + before, "right")), first + (not held))
            if last > first:
                held.append(batch.slice(first, last - first))
                n += int(sizes[last - 1] - before)
                first = last
            if first < len(sizes):
                yield block()
                held.clear()
                n = 0
    if held:
        yield block()


class Queries:
    """The blocks of the queries written to a folder; a single one is made once."""

    def __init__(self, path: str):
        blocks = _blocks(path)
        self.path, self.first, self.more = path, next(blocks, None), next(blocks, None) is not None

    def __iter__(self) -> Iterator[Block]:
        return _blocks(self.path) if self.more else iter([self.first] if self.first else [])


def _groups(batches: Iterator[pa.RecordBatch], path: str, cells: int) -> Iterator[tuple[Block, pa.RecordBatch, np.ndarray]]:
    queries = Queries(path)
    for batch, block in ((batch, block) for batch in batches for block in queries):
        rows = block.rows(cells)
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            texts, compact_texts = (pc.fill_null(part[c], "").to_pylist() for c in ("text", "compact_text"))
            yield block, part, block.hits(texts, compact_texts)
        pa.default_memory_pool().release_unused()


def met(batches: Iterator[pa.RecordBatch], path: str, kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Per document with hits the queries that have an included token in it, how many these are, and after them those that have an excluded one."""
    for block, part, hits in _groups(batches, path, LIST_CELLS):
        both = np.concatenate((block.any_of(hits, block.include), block.any_of(hits, block.exclude)))
        rows = max(1, MATCHES // len(both))
        for start in range(0, part.num_rows, rows):
            yield _lists(block, part["entity_key"].slice(start, rows).cast(kinds[0]), both[:, start : start + rows], kinds[1])


def _lists(block: Block, keys: pa.Array, both: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    place = np.nonzero(np.ascontiguousarray(both.T))[1]
    offsets = np.concatenate(([0], np.cumsum(both.sum(axis=0)))).astype(np.int32)
    queries = pa.ListArray.from_arrays(offsets, block.ids.take(pa.array(place % len(block.ids))).cast(kind))
    included = pa.array(both[: len(block.ids)].sum(axis=0).astype(np.int32))
    return pa.RecordBatch.from_arrays([keys, queries, included], ["entity_key", "met", "included"]).filter(pa.array(np.diff(offsets) > 0))


class Terms:
    """Distinct terms of a group of documents by length, and each document's terms in that order."""

    def __init__(self, lists: pa.ListArray, least: int, most: int):
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(False)
        flat, doc = lists.flatten(), np.repeat(np.arange(len(sizes)), sizes)
        length = pc.fill_null(pc.utf8_length(flat), 0).to_numpy(False)
        kept = (length >= least) & (length <= most)
        coded = flat.filter(pa.array(kept)).dictionary_encode()
        lengths = pc.utf8_length(coded.dictionary).to_numpy(False).astype(np.int64)
        order = np.argsort(lengths, kind="stable")
        self.lengths, self.strings = lengths[order], coded.dictionary.take(pa.array(order))
        self.sizes = self.lengths.astype(np.int32)
        self.points = padded(self.strings.to_pylist(), self.lengths)
        self.signatures = signatures(self.points)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        width = most + 2
        pairs = np.sort(doc[kept] * max(1, len(order)) + place[coded.indices.to_numpy(False)])
        doc, self.of_doc = np.divmod(pairs, max(1, len(order)))
        counts = np.bincount(doc * width + self.lengths[self.of_doc], minlength=len(sizes) * width)
        self.starts = np.concatenate(([0], np.cumsum(counts)))  # of a document's terms of a length, at document * width + length
        self.width = width
        by_term = np.argsort(self.of_doc, kind="stable")
        self.docs, self.docs_at = doc[by_term], np.concatenate(([0], np.cumsum(np.bincount(self.of_doc, minlength=len(order)))))

    def of_length(self, least: int, most: int) -> tuple[int, int]:
        return int(np.searchsorted(self.lengths, least)), int(np.searchsorted(self.lengths, most, "right"))


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the range and place of every element of the ranges."""
    sizes = ends - starts
    number = np.repeat(np.arange(len(sizes)), sizes)
    return number, np.arange(len(number)) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


class Tokens:
    """The tokens of a block as the search for near terms needs them; a token without a distance has no near terms."""

    def __init__(self, block: Block, limits: tuple[tuple[int, int], ...], most: int):
        compacts = [c for _, c in block.tokens]
        lengths = np.array([len(c) for c in compacts], np.int64)
        allowed = np.full(len(compacts), most, np.int64)
        for length, distance in reversed(limits):
            allowed[lengths <= length] = distance
        order = np.argsort(lengths, kind="stable")
        self.lengths, self.allowed, self.most, self.compacts = lengths, allowed, most, pa.array(compacts, pa.string())
        self.sizes, self.bits = lengths.astype(np.int32), (2 * allowed).astype(np.int32)
        self.points = np.empty((int(lengths.max(initial=0)), len(compacts)), np.uint32)
        self.points[:, order] = padded([compacts[k] for k in order], lengths[order])
        self.signatures = signatures(self.points)
        fuzzy = np.flatnonzero(allowed > 0)
        self.least = int((lengths - allowed)[fuzzy].min(initial=1 << 30))
        self.longest = int((lengths + allowed)[fuzzy].max(initial=0))
        # The longest tokens meet the fewest documents; a query's other tokens are only looked for where these are.
        self.sides = [sorted(tokens, key=lambda t: (-lengths[t], t)) for tokens in block.include]

    def _close(self, terms: Terms, token: np.ndarray, term: np.ndarray) -> np.ndarray:
        return within(self.points, self.lengths, terms.points, terms.lengths, self.allowed, (token, term), self.most)

    def _alike(self, terms: Terms, token, term) -> np.ndarray:
        apart = np.abs(terms.sizes[term] - self.sizes[token])
        return np.bitwise_count(terms.signatures[term] ^ self.signatures[token]) + apart <= self.bits[token]

    def near_anywhere(self, terms: Terms, tokens: list[int], n_docs: int) -> np.ndarray:
        """For each of the tokens (row) and each document (column) a term near it, or NONE."""
        out = np.full((len(tokens), n_docs), NONE, np.int32)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for row, token in enumerate(tokens):
            if self.allowed[token]:
                lo, hi = terms.of_length(self.lengths[token] - self.allowed[token], self.lengths[token] + self.allowed[token])
                found = lo + np.flatnonzero(self._alike(terms, token, slice(lo, hi)))
                held.append((np.full(len(found), row), found))
                size += len(found)
            if held and (size > TERM_PAIRS or row == len(tokens) - 1):
                rows, found = (np.concatenate(x) for x in zip(*held, strict=True))
                close = self._close(terms, np.array(tokens)[rows], found)
                rows, found = rows[close], found[close]
                number, place = _ranges(terms.docs_at[found], terms.docs_at[found + 1])
                out[rows[number], terms.docs[place]] = found[number]
                held, size = [], 0
        return out

    def near_in(self, terms: Terms, token: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """For each pair of a token and a document a term of the document near the token, or NONE."""
        out = np.full(len(token), NONE, np.int32)
        at, fuzzy = doc * terms.width, self.allowed[token] > 0
        least = np.maximum(self.lengths[token] - self.allowed[token], 0)
        most = self.lengths[token] + self.allowed[token]
        starts = terms.starts[at + np.minimum(least, terms.width - 1)]
        ends = np.where(fuzzy, terms.starts[at + np.minimum(most + 1, terms.width)], starts)
        done = np.cumsum(ends - starts)
        first = 0
        while first < len(token):
            last = max(first + 1, int(np.searchsorted(done, (done[first - 1] if first else 0) + TERM_PAIRS, "right")))
            number, place = _ranges(starts[first:last], ends[first:last])
            number, term = number + first, terms.of_doc[place]
            alike = self._alike(terms, token[number], term)
            number, term = number[alike], term[alike]
            close = self._close(terms, token[number], term)
            out[number[close]] = term[close]
            first = last
        return out


def met_in_full(batches: Iterator[pa.RecordBatch], path: str, kinds: list[pa.DataType], limits: tuple[tuple[int, int], ...], most: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a document and a query of which every included token is in the document or near a term of it, and no excluded one in it.

    With a pair come the tokens that are only near, each with such a term.
    """
    made: tuple[Block, Tokens] | None = None
    for block, part, hits in _groups(batches, path, CELLS):
        if made is None or made[0] is not block:
            made = block, Tokens(block, limits, most)
        judge = _Judge(block, made[1], hits, part["terms"])
        query, doc = judge.candidates()
        for start in range(0, len(query), MATCHES):
            query_in, doc_in = judge.in_full(query[start : start + MATCHES], doc[start : start + MATCHES])
            yield pa.RecordBatch.from_arrays(
                [part["entity_key"].take(pa.array(doc_in)).cast(kinds[0]), block.ids.take(pa.array(query_in)).cast(kinds[1]), judge.witnesses(query_in, doc_in)],
                ["entity_key", "query_id", "near"])


class _Judge:
    """The queries of a block on a group of documents."""

    def __init__(self, block: Block, tokens: Tokens, hits: np.ndarray, terms: pa.ListArray):
        self.block, self.tokens, self.hits, self.n_docs = block, tokens, hits, hits.shape[1]
        self.terms = Terms(terms, tokens.least, tokens.longest)
        # Per token and document a near term, NONE, or UNKNOWN; asked only where the token is no hit.
        self.near = np.full(hits.size, UNKNOWN, np.int32)
        self.sizes = np.array([len(side) for side in tokens.sides], np.int64)
        self.flat = np.array([t for side in tokens.sides for t in side], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose longest included token is in the document or near a term of it, without excluded tokens."""
        block, hits = self.block, self.hits
        asked = np.flatnonzero(self.sizes)
        firsts = self.flat[self.begin[asked]]
        self._look_up(np.unique(firsts))
        may = hits[firsts] | (self.near.reshape(hits.shape)[firsts] >= 0)
        # A token too short to be near anything has to be in the document.
        strict = [[t for t in side if not self.tokens.allowed[t]] for side in block.include]
        may &= ~(block.any_of(~hits, strict) | block.any_of(hits, block.exclude))[asked]
        at, doc = np.nonzero(may)
        return asked[at], doc

    def _look_up(self, tokens: np.ndarray) -> None:
        self.near.reshape(self.hits.shape)[tokens] = self.tokens.near_anywhere(self.terms, tokens.tolist(), self.n_docs)

    def in_full(self, query: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the candidates those whose other tokens are met too, one token of each at a time."""
        out, near, n_docs = [], self.near, self.n_docs
        step = 1
        while len(query):
            over = self.sizes[query] == step
            out.append((query[over], doc[over]))
            query, doc = query[~over], doc[~over]
            token = self.flat[self.begin[query] + step]
            missing = np.flatnonzero(~self.hits[token, doc])
            key = token[missing] * n_docs + doc[missing]
            new = key[near[key] == UNKNOWN]
            near[new] = np.arange(len(new))
            new = new[near[new] == np.arange(len(new))]  # each once
            # Tokens wanted in many documents are compared with the distinct terms of the group, others with those of their documents.
            asking = np.bincount(new // n_docs, minlength=len(self.hits))
            self._look_up(np.flatnonzero(asking >= MANY))
            new = new[asking[new // n_docs] < MANY]
            near[new] = self.tokens.near_in(self.terms, new // n_docs, new % n_docs)
            kept = np.ones(len(query), bool)
            kept[missing] = near[key] != NONE
            query, doc, step = query[kept], doc[kept], step + 1
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (query, doc)

    def witnesses(self, query: np.ndarray, doc: np.ndarray) -> pa.ListArray:
        """Per pair its tokens that are not in the document, each with a term near it."""
        number, place = _ranges(self.begin[query], self.begin[query] + self.sizes[query])
        token = self.flat[place]
        missing = ~self.hits[token, doc[number]]
        number, token = number[missing], token[missing]
        term = self.near[token * self.n_docs + doc[number]]
        offsets = np.concatenate(([0], np.cumsum(np.bincount(number, minlength=len(query))))).astype(np.int32)
        pairs = [self.tokens.compacts.take(pa.array(token)), self.terms.strings.take(pa.array(term)).cast(pa.string())]
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(pairs, fields=[pa.field("compact", pa.string()), pa.field("term", pa.string())]))


# Tasks get these functions with the job, so that the executors need not have the library.
for _module in (durable, text_scan, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)
