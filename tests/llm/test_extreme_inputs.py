"""Pages with broken markup, deep nesting and very many lines; vectors of any finite size."""

import random
import time
from fractions import Fraction

import pytest

from offerlens.llm import block_knn, page_diff


def text_of(page):
    return [line.text for line in page_diff.read_lines(page)]


@pytest.mark.parametrize("page, lines", [
    ('<p title="a"b">Hello</p><p>World', ["Hello", "World"]),
    ('<p title="a>b" class=x>Hello</p>', ["Hello"]),
    ("<p title='a\"b'>One</p><p data-x=a\"b>Two</p>", ["One", "Two"]),
    ('<p title="open>One</p><p>Two</p>', ["One", "Two"]),
    ('<p title = "a" hidden>gone</p><p =x y= z>Kept</p>', ["Kept"]),
    ("<a href=x/y/>link</a> text", ["link text"]),
    ('<div class="first" class="footer">kept</div><div class="footer" class="x">gone</div>', ["kept"]),
    ("<p>a <b>bold<div>in</b>side</div>", ["a bold", "in", "side"]),
    ("text <p", ["text"]),
])
def test_broken_markup(page, lines):
    assert text_of(page) == lines


def test_deep_nesting_in_linear_time():
    began = time.monotonic()
    assert text_of("<div>" * 20_000 + "x" + "</span>" * 20_000 + "<b>y</b>" * 20_000 + "</div>" * 20_000) == ["x" + "y" * 20_000]
    assert text_of('<p a="' * 20_000 + "x" + "='" * 20_000) is not None
    assert time.monotonic() - began < 10


def longest(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for k, y in enumerate(b):
            row.append(rows[-1][k] + 1 if x == y else max(rows[-1][k + 1], row[k]))
        rows.append(row)
    return rows[-1][-1]


def test_common_lines_are_a_longest_subsequence():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcdef"[: rng.randint(1, 6)]) for _ in range(rng.randint(0, 40))] for _ in range(2))
        chosen = [x for x, s in zip(a, page_diff.common(a, b), strict=True) if s]
        rest = iter(b)
        assert len(chosen) == longest(a, b) and all(x in rest for x in chosen)
    frequent = ["m", "x"] * 200
    assert page_diff.common(frequent, ["m"] * 150 + ["y"]).count(True) == 150


def test_pages_of_very_many_lines():
    menu = [f"menu {k}" for k in range(25_000)]
    a, b = (menu + [f"{name} {k}" for k in range(25_000)] + ["end"] for name in "ab")
    began = time.monotonic()
    shared = page_diff.common(a, b)
    assert shared == [True] * 25_000 + [False] * 25_000 + [True] and time.monotonic() - began < 60


def test_vectors_of_any_finite_size(spark):
    big, small = 1e160, 1e-170
    vectors = [[big, 1.0], [-big, 2.0], [big, -big], [small, small], [1.0, 2.0], [small, -1.0], [3.0, 0.25], [1e308, 1e308], [big, big], [-1e-308, 0.0]]
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    found = block_knn.nearest(rows, rows.vec_id < 100, k=4, query_block=3, row_block=4).orderBy("query_id", "rank").collect()

    def score(x, y):
        exact = sum(Fraction(p) * Fraction(q) for p, q in zip(x, y, strict=True))
        try:
            return float(exact)
        except OverflowError:
            return float("inf") if exact > 0 else float("-inf")

    for q, x in enumerate(vectors):
        best = sorted((-score(x, y), k) for k, y in enumerate(vectors) if k != q)[:4]
        mine = [r for r in found if r["query_id"] == q]
        assert [r["vec_id"] for r in mine] == [k for _, k in best]
        assert [r["score"] for r in mine] == pytest.approx([-s for s, _ in best], rel=1e-12, abs=0)
