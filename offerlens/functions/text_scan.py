"""Many strings looked up in many texts at once, and edit distances of many pairs, on arrays of code points.

Texts stand in one array with a mark between them. A polynomial hash of every stretch of a length is two array operations away from
running sums, so a pass over the texts costs the same however many strings there are. Stretches whose hash is a string's are compared by their code points.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

END = 0x110000  # between texts; no code point
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)
STEM = 6
PIECE = 1 << 18
PAIRS = 1 << 17
FAR = 100


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by END, and where each text's END stands."""
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32).copy()
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    points[ends] = END
    return points, ends


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as they were asked for."""

    def __init__(self):
        self.held = np.ones((2, 0), np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.held.shape[1]:
            self.held = np.empty((2, 1 << n.bit_length()), np.uint64)
            for row, base in zip(self.held, (BASE, pow(BASE, -1, 1 << 64)), strict=True):
                row[:] = base
                row[0] = 1
                np.cumprod(row, out=row)
        return self.held[0], self.held[1]


class _Group:
    """Strings of one length, in the order of their hashes."""

    def __init__(self, ids: list[int], strings: list[str], powers: Powers):
        length = len(strings[0])
        matrix = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).reshape(-1, length)
        hashes = (matrix * powers(length)[0][:length]).sum(axis=1, dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        again = np.concatenate(([False], hashes[order][1:] == hashes[order][:-1]))
        # Strings of equal hash, should there ever be any, are looked up one by one.
        self.rest = [(ids[k], strings[k]) for k in order[again]]
        order = order[~again]
        self.ids, self.matrix = np.array(ids)[order], np.ascontiguousarray(matrix[order].T)
        self.table = SlotTable(hashes[order])


class SlotTable:
    """Slots of a small table by the upper bits of a mixed hash, and which hash stands in a slot where no slot has two."""

    def __init__(self, hashes: np.ndarray):
        self.shift, self.hashes = np.uint64(64 - min(22, max(12, len(hashes).bit_length() + 6))), hashes
        slots = self._slots(hashes)
        self.held = np.zeros(1 << (64 - int(self.shift)), bool)
        self.held[slots] = True
        self.place = None
        if len(np.unique(slots)) == len(slots):
            self.place = np.zeros(len(self.held), np.int32)
            self.place[slots] = np.arange(len(slots))

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        slots = hashes * MIX
        slots >>= self.shift
        return slots.view(np.int64)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        return self.held[self._slots(hashes)]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these hashes are held, and their places among the held ones."""
        k = np.searchsorted(self.hashes, hashes) if self.place is None else self.place[self._slots(hashes)]
        k[k == len(self.hashes)] = 0
        same = self.hashes[k] == hashes
        return same, k[same]


class Strings:
    """Distinct strings, none of them empty, to be found in texts."""

    def __init__(self, strings: list[str]):
        self.size, self.powers, by_length = len(strings), Powers(), defaultdict(list)
        for k, s in enumerate(strings):
            by_length[len(s)].append(k)
        self.groups = {n: _Group(ids, [strings[k] for k in ids], self.powers) for n, ids in sorted(by_length.items())}
        stems = sorted({s[:STEM] for s in strings if len(s) > STEM})
        self.stems = _Group([*range(len(stems))], stems, self.powers).table if stems else None

    def found_in(self, texts: list[str]) -> np.ndarray:
        """Which string (row) stands in which text (column)."""
        out = np.zeros((self.size, len(texts)), bool)
        if not self.size:
            return out
        first = size = 0
        for k, text in enumerate(texts):
            size += len(text) + 1
            if size >= PIECE or k == len(texts) - 1:
                self._mark(texts[first : k + 1], out[:, first : k + 1])
                first, size = k + 1, 0
        return out

    def _mark(self, texts: list[str], out: np.ndarray) -> None:
        points, ends = code_points(texts)
        n = len(points)
        powers, inverse = self.powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(points * powers[:n], out=sums[1:])
        text_of = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=-1))

        def hashes(length: int) -> np.ndarray:
            h = sums[length:] - sums[:-length]
            h *= inverse[: len(h)]
            return h

        stemmed = None
        for length, group in self.groups.items():
            if length > n:
                break
            if length <= STEM:
                h = hashes(length)
                at = np.flatnonzero(group.table.may_hold(h))
                h = h[at]
            else:
                if stemmed is None:
                    stemmed = np.flatnonzero(self.stems.may_hold(hashes(STEM)))
                at = stemmed[: np.searchsorted(stemmed, n - length, "right")]
                h = (sums[at + length] - sums[at]) * inverse[at]
                near = group.table.may_hold(h)
                at, h = at[near], h[near]
            same, k = group.table.find(h)
            at = at[same]
            same = np.ones(len(at), bool)
            for j in range(length):
                same &= points[at + j] == group.matrix[j][k]
            out[group.ids[k[same]], text_of[at[same]]] = True
            for row, string in group.rest:
                out[row] |= np.fromiter((string in t for t in texts), bool, len(texts))


def padded(strings: list[str], lengths: np.ndarray) -> np.ndarray:
    """Code points of strings given by ascending length: one row per position, END behind a string's end."""
    out = np.full((int(lengths[-1]) if len(lengths) else 0, len(strings)), END, np.uint32)
    for length in np.unique(lengths):
        if length:
            lo, hi = np.searchsorted(lengths, length), np.searchsorted(lengths, length, "right")
            out[:length, lo:hi] = np.frombuffer("".join(strings[lo:hi]).encode("utf-32-le"), np.uint32).reshape(hi - lo, length).T
    return out


def signatures(points: np.ndarray) -> np.ndarray:
    """64 bits per string: which of 32 classes of characters it has once, and which twice. An edit changes at most a bit per character it adds or takes."""
    once, twice = np.zeros((2, points.shape[1]), np.uint64)
    for row in points:
        bit = np.where(row == END, np.uint64(0), np.uint64(1) << (row & 31).astype(np.uint64))
        twice |= once & bit
        once |= bit
    return once | twice << np.uint64(32)


def within(left: np.ndarray, left_sizes: np.ndarray, right: np.ndarray, right_sizes: np.ndarray, limits: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], most: int) -> np.ndarray:
    """Which pairs (place in left, place in right) have an edit distance of at most limits[place in left], itself at most `most`.

    Only the 2 * most + 1 diagonals that such a distance can reach are filled.
    """
    out = np.zeros(len(pairs[0]), bool)
    by_size = np.argsort(left_sizes[pairs[0]], kind="stable")
    for start in range(0, len(by_size), PAIRS):
        part = by_size[start : start + PAIRS]
        a, b = pairs[0][part], pairs[1][part]
        sizes, ends = left_sizes[a], right_sizes[b]
        inside = np.abs(ends - sizes) <= most
        result, nowhere = np.full(len(a), FAR, np.uint8), np.full(len(a), END, np.uint32)

        def column(j: int) -> np.ndarray:
            return right[j - 1][b] if 1 <= j <= len(right) else nowhere

        previous = np.full((2 * most + 3, len(a)), FAR, np.uint8)  # a border on both sides stays far
        for j in range(most + 1):
            previous[1 + most + j] = j
        columns = {j: column(j) for j in range(1, most + 1)}
        for i in range(1, int(sizes[-1]) + 1 if len(sizes) else 1):
            columns[i + most] = column(i + most)
            columns.pop(i - most - 1, None)
            own, current = left[i - 1][a], np.full_like(previous, FAR)
            for d in range(2 * most + 1):
                j = i + d - most
                if j == 0:
                    current[1 + d] = min(i, FAR)
                elif j > 0:
                    cell = previous[1 + d] + (own != columns[j])
                    np.minimum(cell, previous[2 + d] + np.uint8(1), out=cell)
                    np.minimum(cell, current[d] + np.uint8(1), out=cell)
                    np.minimum(cell, FAR, out=current[1 + d])
            previous = current
            lo, hi = np.searchsorted(sizes, i), np.searchsorted(sizes, i, "right")
            if hi > lo:
                at = np.arange(lo, hi)[inside[lo:hi]]
                result[at] = previous[1 + most + ends[at] - i, at]
        out[part] = result <= limits[a]
    return out
