"""Main text of web pages by differencing pages with near URLs.

Pages are ordered by host and URL path, and cut into blocks of neighbours; a host of any size is many blocks. In its block each page is
paired with the one whose path shares the longest beginning. Both are read as lines (the text of their blocks), the lines
are aligned by a longest common subsequence, and lines they share are deleted: menus, notices and footers repeat, the article does not.

What markup says goes before: scripts, forms, navigation and parts named as adverts, comments, notices and the like are left out. All lines that are left, of
every page, are aligned. Where a page marks articles, the lines that survive say which of them is its own: the one with a first-level heading or, of several, with
the most text that its neighbour does not have. The page's text is that article whole, with the lines it shares, because sentences do repeat between articles; all
around it is deleted. Where only an element named as content is marked, its lines are differenced like those of a whole page without marks; neither is differenced by the article
of a neighbour.

For the alignment only fingerprints of the lines travel; the texts meet the runs of lines that are kept once.

A neighbour that is a copy shows nothing; then the next nearest of the block is used, or none. How much of a page is shared tells nothing about copies, because
menus and notices may outweigh any article; what stands on few pages of the block does (see `_is_copy`).

Defined results. A null page is empty; so is one without text. A null or broken URL belongs to the host "". The only page of a host is not differenced. Pages
equal in id, URL and content give equal rows. Unclosed and stray tags are read like browsers do, roughly: an end tag closes
everything up to its start tag. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from offerlens.functions.durable import checkpointed

BLOCK_PAGES = 16
COPY_SHARE = 0.5
NEARLY_ALL = 0.9
FEW_PLACES = 64

# Elements of HTML by their role here, and words that name parts around an article.
BREAKING = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea noscript template iframe object svg math canvas audio video select title noframes xmp".split())
AROUND = frozenset("nav footer aside form button menu dialog head label".split())
NAMED = frozenset(
    "ad ads adv advert advertisement adverts adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login menu menubar modal nav navbar "
    "navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended related replies reply respond share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
PAGE_HEADS = frozenset("header masthead topbar".split())
CONTENT_NAMES = frozenset(("article", "article-body", "article-content", "articlebody", "content", "entry-content", "main", "main-content", "post", "post-body", "post-content", "story", "story-body"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

# A quote begins a value only after an equals sign, and its pair ends it; what follows is the next attribute. A quote without pair is a character.
_NAME = r"[^\s/>][^\s/>=]*"
_VALUE = r"\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|(?>{_NAME}(?:\s*=\s*(?:{_VALUE})?)?))*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(rf"({_NAME})(?:\s*=\s*({_VALUE})?)?", re.S)


@dataclass
class Line:
    text: str
    article: int  # number of the marked article around it, 0 if none
    container: bool  # inside another element named as content
    heading: bool


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return found


def _left_out(name: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether markup says that an element is no part of the article."""
    if name in AROUND or (name == "header" and not in_article):
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    if attributes.get("role", "").lower() in ROLES:
        return True
    words = re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{attributes.get('class', '')} {attributes.get('id', '')}").lower())
    if name in ("html", "body", "main"):
        return False
    if name == "article":
        return not {"comment", "comments", "reply"}.isdisjoint(words)
    return not NAMED.isdisjoint(words) or (not in_article and not PAGE_HEADS.isdisjoint(words))


def read_lines(page: str) -> list[Line]:
    """The page's lines of text in order, without what markup leaves out."""
    lines: list[Line] = []
    words: list[str] = []
    stack: list[tuple[str, bool, int, bool]] = []  # name, left out, article, container
    depth: Counter[str] = Counter()  # open elements by name
    articles = 0
    heading = False

    def end_line() -> None:
        nonlocal heading
        text = " ".join(html.unescape("".join(words)).split())
        if text:
            _, _, article, container = stack[-1] if stack else ("", False, 0, False)
            lines.append(Line(text, article, container, heading))
        words.clear()
        heading = False

    at = 0
    while True:
        tag = TOKEN.search(page, at)
        here = page[at : tag.start() if tag else len(page)]
        if here and not (stack and stack[-1][1]):
            words.append(here)
        if not tag:
            break
        at = tag.end()
        closing, name = tag[1], (tag[2] or "").lower()
        if not name:
            if tag[0].startswith("<![CDATA[") and not (stack and stack[-1][1]):
                words.append(html.escape(tag[0][9:].removesuffix("]]>")))
            continue
        if name in BREAKING:
            end_line()
        if closing:
            if depth[name]:
                upto = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name)  # all of these are closed now
                if name not in BREAKING and any(s[0] in BREAKING for s in stack[upto:]):
                    end_line()
                depth.subtract(s[0] for s in stack[upto:])
                del stack[upto:]
            continue
        if name in RAW and not tag[0].endswith("/>"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID or (tag[0].endswith("/>") and name not in BREAKING):
            continue
        while stack and (name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == name or stack[-1][0] == "p" and name in BREAKING):
            depth[stack.pop()[0]] -= 1
        _, out, article, container = stack[-1] if stack else ("", False, 0, False)
        attributes = _attributes(tag[3]) if tag[3].strip() else {}
        if name == "article" and not article and not out:
            articles += 1
            inside = articles
        else:
            inside = article
        out = out or _left_out(name, attributes, bool(article))
        names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
        container = container or name == "main" or attributes.get("role") == "main" or attributes.get("itemprop") == "articleBody" or not CONTENT_NAMES.isdisjoint(names)
        stack.append((name, out, inside, container))
        depth[name] += 1
        heading = heading or name == "h1"
    end_line()
    return lines


def _mask(places: list[int]) -> int:
    """A whole number with the bits of these places."""
    if len(places) == 1:
        return 1 << places[0]
    held = bytearray(places[-1] // 8 + 1)
    for k in places:
        held[k >> 3] |= 1 << (k & 7)
    return int.from_bytes(held, "little")


def common(a: list[str], b: list[str]) -> list[bool]:
    """Which lines of `a` are in a longest common subsequence with `b` (row vectors as whole numbers, one bit per line of `b`).

    Of n rows about sqrt(n) are kept, those between are made again where the way back needs them. Masks of lines that stand
    on many places are kept, which are few.
    """
    places: dict[str, list[int]] = {}
    for k, line in enumerate(b):
        places.setdefault(line, []).append(k)
    many = {line: _mask(at) for line, at in places.items() if len(at) > FEW_PLACES}
    full = (1 << len(b)) - 1

    def after(v: int, line: str) -> int:
        if line not in places:
            return v
        match = v & (many[line] if line in many else _mask(places[line]))
        return (v + match | v - match) & full

    stride = math.isqrt(len(a)) + 1
    kept, v = [full], full
    for k, line in enumerate(a, 1):
        v = after(v, line)
        if k % stride == 0:
            kept.append(v)
    out = [False] * len(a)
    rows, first = [v], len(a)  # rows[k] is the vector after first + k lines
    row, column = len(a), len(b)

    def bit(r: int) -> int:
        nonlocal rows, first
        if r < first:
            first = r // stride * stride
            rows = [kept[r // stride]]
            for line in a[first:r]:
                rows.append(after(rows[-1], line))
        return rows[r - first] >> (column - 1) & 1

    while row and column:
        if bit(row):
            column -= 1
        else:
            row -= 1
            if bit(row):
                out[row] = True
                column -= 1
    return out


def _near(a: str, b: str) -> int:
    """Length of the common beginning of two paths."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _is_copy(own: list[int], shared: list[bool], sizes: dict[int, int], pages: Counter[int], n: int) -> bool:
    """Whether the neighbour that shares these lines is a copy; `pages` counts the pages of the block (n in all) that hold a line.

    Copies share most of the lines that stand on at most two pages, or nearly all of those that stand on at most half of
    the block. Of two pages alone, only nearly all lines can tell.
    """

    def part(most: float) -> float:
        size = sum(sizes[t] for t in own if pages[t] <= most)
        return sum(sizes[t] for t, s in zip(own, shared, strict=True) if s and pages[t] <= most) / size if size else 0.0

    return part(max(2, n / 2)) >= NEARLY_ALL or (n > 2 and part(2) > COPY_SHARE)


@dataclass
class Page:
    """A page among its neighbours: fingerprint, length, article number and content mark of each line, and the articles of its first-level headings."""

    path: str
    lines: list[int]
    sizes: list[int]
    articles: list[int]
    inside: list[bool] | None
    headings: list[int]


def _difference(k: int, own: list[int], paths: list[str], lines: list[list[int]], sizes: dict[int, int], same: list[bool], pages: Counter[int]) -> list[bool]:
    """Which of the page's own lines the nearest neighbour shares that is no copy (see `_is_copy`); none without such a neighbour. `same` marks neighbours with the same lines."""
    held = set(own)
    for other in sorted((j for j in range(len(lines)) if j != k and not same[j]), key=lambda j: (-_near(paths[k], paths[j]), abs(j - k), j)):
        shared = [False] * len(own) if held.isdisjoint(lines[other]) else common(own, lines[other])
        if not _is_copy(own, shared, sizes, pages, len(lines)):
            return shared
    return [False] * len(own)


def own_article(page: Page, shared: list[bool]) -> int:
    """The marked article that is the page's own: with first-level headings, then with most text that is not shared, then the longest and first."""
    own: Counter[int] = Counter()
    whole: Counter[int] = Counter()
    for article, size, s in zip(page.articles, page.sizes, shared, strict=True):
        if article:
            whole[article] += size
            own[article] += 0 if s else size
    return max(whole, key=lambda a: (page.headings.count(a), own[a], whole[a], -a))


def block_kept(block: list[Page]) -> list[list[int]]:
    """Places of the lines that make the main text of each page among neighbours of one host, in URL order."""
    paths, n = [page.path for page in block], len(block)
    sizes = {line: size for page in block for line, size in zip(page.lines, page.sizes, strict=True)}
    lines = [page.lines for page in block]
    sets = [set(held) for held in lines]
    pages = Counter(line for held in sets for line in held)
    chosen = [0] * n
    for k, page in enumerate(block):
        if any(page.articles):
            shared = _difference(k, page.lines, paths, lines, sizes, [sets[j] == sets[k] for j in range(n)], pages)
            chosen[k] = own_article(page, shared)
    kept = [[at for at, article in enumerate(page.articles) if article == best] if best else [] for page, best in zip(block, chosen, strict=True)]
    if all(chosen):
        return kept
    # Pages without mark: articles of others delete none of their lines.
    lines = [[line for line, article in zip(page.lines, page.articles, strict=True) if not best or article != best] for page, best in zip(block, chosen, strict=True)]
    sets = [set(held) for held in lines]
    pages = Counter(line for held in sets for line in held)
    for k, page in enumerate(block):
        if not chosen[k]:
            at = [place for place in range(len(page.lines)) if not page.inside or page.inside[place]]
            same = [not chosen[j] and sets[j] == sets[k] for j in range(n)]
            shared = _difference(k, [page.lines[place] for place in at], paths, lines, sizes, same, pages)
            kept[k] = [place for place, s in zip(at, shared, strict=True) if not s]
    return kept


def _runs(places: list[int]) -> list[tuple[int, int]]:
    """(first, number) of each run of neighbouring places."""
    runs: list[tuple[int, int]] = []
    for place in places:
        if runs and place == sum(runs[-1]):
            runs[-1] = (runs[-1][0], runs[-1][1] + 1)
        else:
            runs.append((place, 1))
    return runs


def _blocks(keys: DataFrame) -> DataFrame:
    """Adds `block` and `place` to rows of (host, path, ...): runs of BLOCK_PAGES to twice as many neighbours within a host."""
    order = [c for c in ("host", "path", *keys.columns) if c in keys.columns]
    ordered = checkpointed(keys.orderBy(*dict.fromkeys(order)).withColumn("row", F.monotonically_increasing_id()))
    part = F.shiftright("row", 33)
    spans = ordered.groupBy("host", part.alias("part")).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    # At most one row per host and partition of the sort.
    before = Window.partitionBy("host").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.select("host", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("host")).alias("pages"))
    place = F.col("start") + F.col("row") - F.col("first")
    last = F.greatest(F.floor(F.col("pages") / BLOCK_PAGES) - 1, F.lit(0))
    joined = ordered.withColumn("part", part).join(starts, ["host", "part"]).withColumn("place", place)
    return joined.withColumn("block", F.least(F.floor(F.col("place") / BLOCK_PAGES), last)).drop("part", "row", "first", "start", "pages")


FINGERPRINTS = {
    "lines": ("array<long>", pa.list_(pa.int64())), "sizes": ("array<int>", pa.list_(pa.int32())), "articles": ("array<int>", pa.list_(pa.int32())),
    "inside": ("array<boolean>", pa.list_(pa.bool_())), "headings": ("array<int>", pa.list_(pa.int32())),
}


def _fingerprints(lines: list[Line]) -> dict[str, list | None]:
    return {
        "lines": [int.from_bytes(hashlib.blake2b(line.text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for line in lines],
        "sizes": [len(line.text) for line in lines],
        "articles": [line.article for line in lines],
        "inside": [line.container for line in lines] if any(line.container for line in lines) else None,
        "headings": [line.article for line in lines if line.article and line.heading],
    }


def _parsed(rows: DataFrame, columns: dict[str, tuple[str, pa.DataType]], read) -> DataFrame:
    """Rows of (..., page) with these columns of read(lines) instead of the page."""
    names = [c for c in rows.columns if c != "page"]
    schema = StructType([*[rows.schema[c] for c in names], *StructType.fromDDL(", ".join(f"{c} {kind}" for c, (kind, _) in columns.items()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                found = [read(read_lines(page)) for page in part.column(part.schema.get_field_index("page")).to_pylist()]
                made = [pa.array([f[c] for f in found], t) for c, (_, t) in columns.items()]
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in names], *made], names=schema.names)

    return rows.mapInArrow(run, schema)


def main_texts(pages: DataFrame, row_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(row_id, url, text): main text of every page."""
    address = F.coalesce(F.col(url), F.lit(""))
    rows = pages.select(
        F.col(row_id).alias("row_id"), F.col(url).alias("url"), F.coalesce(F.col(page), F.lit("")).alias("page"),
        F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path"),
    ).withColumn("print", F.xxhash64("page"))
    blocks = _blocks(rows.select("host", "path", "row_id", "url", "print").distinct())
    placed = blocks.select(*[F.col(c).alias(f"_{c}") for c in ("row_id", "url", "print")], "host", "path", "block", "place")

    def same(df: DataFrame, other: DataFrame):
        return (df["print"] == other["_print"]) & df["row_id"].eqNullSafe(other["_row_id"]) & df["url"].eqNullSafe(other["_url"])

    keys = ("row_id", "url", "print")
    lines = _parsed(rows.select(*keys, "page"), FINGERPRINTS, _fingerprints)
    ready = (
        lines.join(placed, same(lines, placed)).select("host", "block", "place", "path", *keys, *FINGERPRINTS)
        .repartition("host", "block").sortWithinPartitions("host", "block", "place")
    )
    kind = rows.schema["row_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, id_type = None, {}, None

        def done() -> pa.RecordBatch:
            out = list(held.values())  # repeated rows share a place
            kept = block_kept([Page(row["path"], *(row[c] for c in FINGERPRINTS)) for row in out])
            runs = [[{"first": first, "n": n} for first, n in _runs(places)] for places in kept]
            return pa.RecordBatch.from_arrays(
                [pa.array([r["row_id"] for r in out], id_type), pa.array([r["url"] for r in out], pa.string()), pa.array([r["print"] for r in out], pa.int64()),
                 pa.array(runs, pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())])))],
                names=["_row_id", "_url", "_print", "runs"],
            )

        for batch in batches:
            id_type = batch.schema.field("row_id").type
            for k in range(0, batch.num_rows, BLOCK_PAGES):
                for row in batch.slice(k, BLOCK_PAGES).to_pylist():
                    if (row["host"], row["block"]) != now:
                        if held:
                            yield done()
                        now, held = (row["host"], row["block"]), {}
                    held.setdefault(row["place"], row)
        if held:
            yield done()

    kept = ready.mapInArrow(run, f"_row_id {kind}, _url string, _print long, runs array<struct<first:int,n:int>>")
    # Lines hold no line feeds.
    whole = _parsed(rows.select(*keys, "page"), {"text": ("string", pa.string())}, lambda lines: {"text": "\n".join(line.text for line in lines)})
    split = F.array(F.split("text", "\n"))  # bound by a transform, so that a text is split once
    text = F.transform(split, lambda lines: F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(lines, r["first"] + 1, r["n"]))), " "))
    return whole.join(kept, same(whole, kept)).select("row_id", "url", text[0].alias("text"))
