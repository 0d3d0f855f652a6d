"""Byte-level BPE over Arrow batches with the tokenizers library.

A rank file gives the vocabulary as byte strings. Every byte is written as one printable character (the usual byte
table of byte-level BPE), so that the library's BPE model can work on text; ids, offsets and decoded bytes are mapped back
through the same table. A text is cut into pieces by the pattern, and each distinct piece goes through the model once per worker
while it stays in a bounded cache. Encoding and decoding are row by row: no shuffle, a lost task is simply run again.

Defined results. A null text is the empty text: no ids, empty offsets, empty bytes. Any text length is encoded whole; a
batch is cut into slices of about `SLICE_BYTES` of text so that memory does not depend on how rows were batched. Repeated rows and
empty tables need no special case. Only the named columns are used: an input column with the name of an output column is
replaced, all others pass through.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

SLICE_BYTES = 1 << 20
CACHED_CHARACTERS = 1_500_000


def read_ranks(path: str) -> bytes:
    """Content of a rank file (base64 token and rank on each line); small, so it travels inside the task."""
    with open(path, "rb") as file:
        return file.read()


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, extra = {b: chr(b) for b in printable}, 0
    for b in range(256):
        if b not in table:
            table[b], extra = chr(0x100 + extra), extra + 1
    return [table[b] for b in range(256)]


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


def tokens_by_rank(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


@lru_cache(maxsize=None)
def character_class(name: str, last: int) -> str:
    """Members up to code point `last` of the class L, N or S (letters, numbers, white space) as ranges for a bracket.

    They are read off the tokenizers library's own pattern engine, so that both agree on every character.
    """
    from tokenizers import Regex, pre_tokenizers

    outside = {"L": r"\P{L}+", "N": r"\P{N}+", "S": r"\S+"}[name]
    everything = "".join(chr(c) for c in range(last + 1) if not 0xD800 <= c < 0xE000)
    runs = [run for run, _ in pre_tokenizers.Split(Regex(outside), behavior="removed").pre_tokenize_str(everything)]
    return "".join(f"\\U{ord(run[0]):08x}-\\U{ord(run[-1]):08x}" for run in runs)


@lru_cache(maxsize=None)
def written_pattern(pattern: str, last: int = 0x10FFFF) -> str:
    """The splitting pattern with its Unicode classes written out for the standard `re` module.

    It is right for texts of characters up to `last`.
    """
    out, inside, k = [], False, 0
    while k < len(pattern):
        if found := re.match(r"\\p\{([LN])\}|\\(s|S)", pattern[k:]):
            if inside and found[2] == "S":
                raise ValueError("a negated class inside brackets is not supported")
            ranges = character_class((found[1] or found[2]).upper(), last)
            out.append(ranges if inside else f"[{'^' if found[2] == 'S' else ''}{ranges}]")
            k += len(found[0])
            continue
        if pattern[k] == "\\":
            out.append(pattern[k : k + 2])
            k += 2
            continue
        inside = pattern[k] == "[" or inside and pattern[k] != "]"
        out.append(pattern[k])
        k += 1
    return "".join(out)


class Codec:
    """Encoder and decoder of one rank file in one Python worker."""

    def __init__(self, content: bytes, any_pattern: str, plane_pattern: str):
        from tokenizers import models

        ranks = parse_ranks(content)
        characters = byte_characters()
        written = {token: "".join(characters[b] for b in token) for token in ranks}
        # Two neighbours merge whenever their bytes together are a token, earlier ranks first: every way to cut a
        # token into two tokens is therefore a merge with that token's rank.
        merges = [
            (written[token[:cut]], written[token[cut:]])
            for token in sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__)
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        self.model = models.BPE(vocab={written[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0)
        self.any_pieces = re.compile(any_pattern).findall
        self.plane_pieces = re.compile(plane_pattern).findall  # the same matches, found faster
        self.beyond_plane = re.compile("[\U00010000-\U0010ffff]").search
        self.characters = dict(enumerate(characters))
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.length = np.array([len(t) for t in tokens_by_rank(ranks)], dtype=np.int64)

    def encode(self, text: str) -> bytes:
        """Packed ids of a text: those of its pieces, one after the other."""
        pieces = (self.any_pieces if self.beyond_plane(text) else self.plane_pieces)(text)
        if self.held > CACHED_CHARACTERS:
            self.known.clear()
            self.held = 0
        for piece in set(pieces).difference(self.known):
            tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.characters))
            self.known[piece] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
            self.held += len(piece)
        return b"".join(map(self.known.__getitem__, pieces))

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and end character of each token; a character cut by several tokens lies in all of them."""
        if not len(ids):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        data = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        end = np.cumsum(self.length[ids])
        start = end - self.length[ids]
        return character[start].astype(np.int32), (character[end - 1] + 1).astype(np.int32)


class Decoder:
    """The tokens of one rank file, written in byte characters, and the reversed byte table."""

    def __init__(self, content: bytes):
        characters = byte_characters()
        self.by_rank = ["".join(characters[b] for b in token) for token in tokens_by_rank(parse_ranks(content))]
        self.bytes = {ord(c): b for b, c in enumerate(characters)}

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, whether or not they start and end between characters of the text."""
        if len(ids) and int(ids.max()) >= len(self.by_rank):
            raise ValueError(f"id {int(ids.max())} is not in the vocabulary of {len(self.by_rank)}")
        # Each byte character becomes the Latin-1 character of its byte.
        return "".join(map(self.by_rank.__getitem__, ids.tolist())).translate(self.bytes).encode("latin-1")


@lru_cache(maxsize=2)
def decoder(content: bytes) -> Decoder:
    return Decoder(content)


@lru_cache(maxsize=2)
def codec(content: bytes, *patterns: str) -> Codec:
    return Codec(content, *patterns)


def patterns(pattern: str) -> tuple[str, str]:
    """The pattern for all texts, and the one for texts within the first plane; made once, on the driver."""
    return written_pattern(pattern), written_pattern(pattern, 0xFFFF)


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_BYTES each (a longer row is a range of its own)."""
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if i > first and held + size > SLICE_BYTES:
            yield first, i
            first, held = i, 0
        held += int(size)
    if first < len(sizes):
        yield first, len(sizes)


def _replaced(df: DataFrame, fields: list[StructField]) -> tuple[list[str], StructType]:
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names]
    return [f.name for f in kept], StructType([*kept, *fields])


def encode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", offsets: bool = False, decoded: bool = False) -> DataFrame:
    """Adds `n_tokens` (long) and `ids` (binary: the token ids as little-endian unsigned 32-bit integers).

    With `offsets` also `token_starts` and `token_ends`, the characters each token covers; with `decoded` also `decoded`, the bytes
    that the ids give again (as `decode` would, but in the same worker and pass).
    """
    fields = [StructField("n_tokens", LongType()), StructField("ids", BinaryType())]
    if offsets:
        fields += [StructField(n, ArrayType(IntegerType())) for n in ("token_starts", "token_ends")]
    if decoded:
        fields.append(StructField("decoded", BinaryType()))
    kept, schema = _replaced(df, fields)
    written = patterns(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks, *written)
        back = decoder(ranks) if decoded else None
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            sizes = np.array([len(s) if s is not None else 0 for s in column.cast(pa.binary()).to_pylist()], np.int64)
            for first, end in _slices(sizes):
                texts = [t or "" for t in column.slice(first, end - first).to_pylist()]
                ids = [coder.encode(t) for t in texts]
                out = [batch.column(batch.schema.get_field_index(c)).slice(first, end - first) for c in kept]
                out += [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if offsets:
                    spans = [coder.offsets(t, np.frombuffer(x, "<u4")) for t, x in zip(texts, ids, strict=True)]
                    out += [pa.array([s[k] for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
                if decoded:
                    out.append(pa.array([back.decode(np.frombuffer(x, "<u4")) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks: bytes, ids: str = "ids", text: bool = False) -> DataFrame:
    """Adds `decoded` (binary) for a column of packed ids; with `text` also `decoded_text`.

    A sequence that starts or ends inside a character still gives its exact bytes; in `decoded_text` the broken character
    becomes U+FFFD. An id outside the vocabulary is an error.
    """
    fields = [StructField("decoded", BinaryType()), *([StructField("decoded_text", StringType())] if text else [])]
    kept, schema = _replaced(df, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = decoder(ranks)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            sizes = np.array([len(s) if s is not None else 0 for s in column.to_pylist()], np.int64)
            for first, end in _slices(sizes):
                packed = column.slice(first, end - first).to_pylist()
                data = [coder.decode(np.frombuffer(p or b"", "<u4")) for p in packed]
                out = [batch.column(batch.schema.get_field_index(c)).slice(first, end - first) for c in kept]
                out.append(pa.array(data, pa.binary()))
                if text:
                    out.append(pa.array([d.decode(errors="replace") for d in data], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return df.mapInArrow(run, schema)
