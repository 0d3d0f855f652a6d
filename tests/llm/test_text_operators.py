"""Token ids, perplexity rules, pseudonyms, classifier and pages: brute force, round trips and odd input."""

import math
import html
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from offerlens.llm import bpe, page_diff, perplexity, pseudonyms, quality_knn, queries

from . import cases

SF = "/root/testdata/sf0.001"
RANKS = bpe.read_ranks(public_tokenizers.path(queries.RANK_FILE))


@pytest.fixture(scope="module")
def exact():
    return tiktoken.Encoding("exact", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(RANKS), special_tokens={})


def test_bpe_equals_the_rank_rule(exact):
    coder, rng = bpe.codec(RANKS, *bpe.patterns(public_tokenizers.PATTERN)), random.Random(3)
    tokens = list(bpe.parse_ranks(RANKS))
    texts = ["", " ", "a\r\n b", "aaaaaaa", "x" * 3_000, "\U0001f600‍\U0001f600 1١²"]
    texts += ["".join(rng.choice("ab-= \n.'s") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    texts += [b"".join(rng.choices(tokens, k=8)).decode(errors="replace") for _ in range(300)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(15)) for _ in range(300)]
    for text in texts:
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == exact.encode_ordinary(text)


def test_bpe_round_trip_and_offsets(spark, exact):
    encoded = bpe.encode(cases.documents(spark), RANKS, public_tokenizers.PATTERN, offsets=True)
    out = bpe.decode(encoded, RANKS, text=True).collect()
    assert len(out) == len(cases.rows()) and set(cases.documents(spark).columns) < set(encoded.columns)
    for row in out:
        text = row["text"] or ""
        ids = np.frombuffer(bytes(row["ids"]), "<u4").tolist()
        assert ids == exact.encode_ordinary(text) and row["n_tokens"] == len(ids)
        assert bytes(row["decoded"]) == text.encode() and row["decoded_text"] == text
        for token, start, end in zip(ids, row["token_starts"], row["token_ends"], strict=True):
            assert exact.decode_single_token_bytes(token) in text[start:end].encode()


def test_bpe_split_characters(spark):
    ids = bpe.codec(RANKS, *bpe.patterns(public_tokenizers.PATTERN)).encode("\U0001f986")
    assert len(ids) > 4
    out = bpe.decode(spark.createDataFrame([(bytearray(ids[:4]),), (None,)], "ids binary"), RANKS, text=True).collect()
    assert "\U0001f986".encode().startswith(bytes(out[0]["decoded"])) and out[0]["decoded_text"].strip("�") == "" and out[1]["decoded_text"] == ""
    assert bpe.encode(cases.empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_basic_counts():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["a", "bé", " ", "\n", "c ", "\x1c", "#|", " ", "a b a b "]) for _ in range(rng.randint(0, 40)))
        assert perplexity.basic_counts(text.encode()) == brute_counts(text)


def spaced(text):
    return " " * (perplexity.ORDER - 1) + re.sub(r"[\t-\r \x85\xa0\u2028\u2029\u3000]+", " ", text).removeprefix(" ")


def test_grams_and_lookup():
    texts = ["", " a  b\n\tc", "x", "naïve — 東京 \U0001f600", "a" * 30, "\n"]
    points, counts = perplexity.symbols(texts)
    code, at = perplexity.hashes(points, counts)
    want = [g[k - 3 : k + 1] for g in map(spaced, texts) for k in range(3, len(g))]
    got = ["".join(map(chr, points[k : k + perplexity.ORDER])) for k in at]
    assert got == want and len(set(code.tolist())) == len(set(want)) and list(counts) == [len(spaced(t)) - 3 for t in texts]
    table = np.unique(code)[::2]
    places = {c: k for k, c in enumerate(table.tolist())}
    assert perplexity.lookup(table, code).tolist() == [places.get(c, -1) for c in code.tolist()]
    assert perplexity.lookup(table[:0], code).tolist() == [-1] * len(code)


def test_kneser_ney_by_definition(spark):
    texts = [cases.PROSE, cases.PROSE + " again", "Zwölf Boxkämpfer jagen Viktor  quer über den Sylter Deich!", "東京 \U0001f600", None]
    count = {}
    for g in (spaced(t) for t in texts if t):
        for k in range(3, len(g)):
            count[g[k - 3 : k + 1]] = count.get(g[k - 3 : k + 1], 0) + 1

    def discounts(counts):
        n1, n2, n3, n4 = (sum(c == k for c in counts) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        raw = [k - (k + 1) * y * b / a if a else k / 2 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        return [0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))]

    levels = [count]
    for _ in range(3):  # in how many ways each shorter gram is preceded
        shorter = {}
        for g in levels[0]:
            shorter[g[1:]] = shorter.get(g[1:], 0) + 1
        levels.insert(0, shorter)

    def p(gram):
        if not gram:
            return 1 / (len(levels[0]) + 1)
        counts = levels[len(gram) - 1]
        d = discounts(counts.values())
        same = [c for g, c in counts.items() if g[:-1] == gram[:-1]]
        if not same:
            return p(gram[1:])
        own = counts.get(gram, 0)
        return (own - d[min(own, 3)] + sum(d[min(c, 3)] for c in same) * p(gram[1:])) / sum(same)

    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    model = perplexity.train(frame)
    rng = random.Random(1)
    unseen = ["zzzz", "he q", "xe q", "\u4eac \U0001f600q", "ox  ", *("".join(rng.choices("thequick ", k=4)) for _ in range(30))]
    asked = [*count, *(g for g in unseen if g not in count)]
    rows = spark.createDataFrame([tuple(map(ord, g)) for g in sorted(set(asked))], ", ".join(f"{s} int" for s in perplexity.SYMBOLS))
    got = {"".join(chr(r[s]) for s in perplexity.SYMBOLS): r["p"] for r in model.probabilities(rows).collect()}
    assert len(got) == len(set(asked))
    for gram in got:
        assert got[gram] == pytest.approx(p(gram), rel=1e-9)
    every = spark.createDataFrame([(*map(ord, "the"), ord(c)) for c in [*levels[0], "\u0001"]], rows.schema)  # all symbols and one that was never seen
    assert sum(r["p"] for r in model.probabilities(every).collect()) == pytest.approx(1, abs=1e-9)
    scored = {r["doc_id"]: r["bits"] for r in perplexity.quality_rules(spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")).collect()}
    for k, t in enumerate(texts):
        g = spaced(t) if t else ""
        want = -sum(math.log2(p(g[j - 3 : j + 1])) for j in range(3, len(g))) / max(len(g) - 3, 1)
        assert scored[k] is None if not t else scored[k] == pytest.approx(want, rel=1e-5)


def test_blocks_smaller_than_a_table(spark, monkeypatch):
    texts = [(k, cases.PROSE[k : k + 60] * (1 + k % 3), "en") for k in range(30)]
    points = iter(pa.Table.from_pylist([{"split": 5, "text": t} for _, t, _ in texts]).to_batches(max_chunksize=7))
    monkeypatch.setattr(perplexity, "BLOCK", 300)
    monkeypatch.setattr(perplexity, "CHUNK", 100)
    found = [(block, rows.num_rows, held) for block, rows, held in perplexity.pieces(points, 0, 1)]
    assert [t for _, _, held in found for t in held] == [t for _, t, _ in texts] and all(n == len(held) for _, n, held in found)
    sizes = {}
    for block, _, held in found:
        sizes[block] = sizes.get(block, 0) + sum(map(len, held))
    assert len(sizes) > 5 and max(sizes.values()) <= 300
    again = iter(pa.Table.from_pylist([{"split": 5, "text": t} for _, t, _ in texts]).to_batches(max_chunksize=4))
    blocks = lambda parts: [block for block, _, held in parts for _ in held]
    assert blocks(perplexity.pieces(again, 0, 1)) == blocks(found)


def test_perplexity_rules(spark):
    out = {r["doc_id"]: r for r in perplexity.quality_rules(cases.documents(spark)).collect()}
    assert perplexity.quality_rules(cases.documents(spark)).count() == len(cases.rows())
    assert all(out[k]["base_failed"] and not out[k]["kept"] for k in (4, 5, 6, 8)) and out[4]["n_words"] == 0 and out[7]["n_words"] == 40_000
    assert perplexity.quality_rules(cases.empty(spark)).count() == 0
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 7))) for _ in range(300)]
    good = [(k, " ".join(rng.choices(vocabulary, k=120)), "en") for k in range(60)]
    noise = " ".join("".join(rng.choices("abcdfgjklmpquvwxyz", k=6)) for _ in range(120))
    flat = " ".join("e" * rng.randint(20, 90) for _ in range(80))
    junk = [(100, noise, "en"), (101, flat, "en")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rows = perplexity.quality_rules(frame(good + junk), model=perplexity.train(frame(good))).collect()
    assert {r["doc_id"] for r in rows if not r["kept"]} == {100, 101}


def test_perplexity_query_counts_every_document(spark):
    rows = queries.QUERIES["op1_perplexity_rules"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, SF, "documents").collect()}
    assert len(rows) == len(texts)
    for r in rows[:60]:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_counts(texts[r["doc_id"]])
    assert sum(r["kept"] for r in rows) > 0.7 * len(rows)


def luhn(number):
    digits = [int(c) for c in reversed(number)]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


VALUES = [
    "4111 1111 1111 1111", "4111-1111-1111-1111", "5500005555555559", "378282246310005", "123-45-6789", "899-99-9999", "10.0.0.1", "255.255.255.255", "+1 (212) 555-0187", "212-555-0187", "+442071838750",
    "2001-02-28", "28.2.2001", "02/28/2001", "GB82WEST12345698765432", "DE89370400440532013000", "jane.doe-7@example.org",
]
WRONG = ["4111 1111 1111 1112", "666-12-3456", "123-00-4567", "10.0.0.256", "2001-02-30", "31.4.2001", "112-555-0187", "GB83WEST12345698765432", "1.2.3", "1234567"]


def replaced(spark, values, key="k"):
    rows = [(k, f"x {v}, y") for k, v in enumerate(values)]
    out = {r["id"]: r for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, "id int, text string"), key).collect()}
    return [out[k]["text"][2:-3] for k in range(len(values))], [out[k]["n_found"] for k in range(len(values))]


def test_pseudonyms_keep_format_and_link(spark):
    new, found = replaced(spark, VALUES)
    assert found == [1] * len(VALUES) and all(a != b for a, b in zip(VALUES, new, strict=True))
    for old, made in zip(VALUES[:15], new, strict=False):
        assert len(made) == len(old) or old in VALUES[6:8] + VALUES[12:13]
        assert re.sub(r"\d+", "9", made) == re.sub(r"\d+", "9", old)
    assert new[0].replace(" ", "") == new[1].replace("-", "") and all(luhn(re.sub(r"\D", "", v)) for v in new[:4])
    assert new[8][4:].replace("(", "").replace(") ", "-") == new[9]
    day = [re.sub(r"\b0", "", "-".join(p)) for p in (new[11].split("-"), new[12].split(".")[::-1], [new[13][6:], new[13][:2], new[13][3:5]])]
    assert day[0] == day[1] == day[2]
    assert new[16].endswith("@example.org") and replaced(spark, VALUES)[0] == new and replaced(spark, VALUES, "other")[0] != new
    again, counted = replaced(spark, new)
    assert counted == found and replaced(spark, WRONG) == (WRONG, [0] * len(WRONG))


def test_pseudonyms_are_one_to_one(spark):
    pairs = spark.range(189 * 773).select((F.col("id") % 189).alias("l"), F.floor(F.col("id") / 189).alias("r"))
    moved = pairs.select(pseudonyms._permuted(F.col("l"), F.col("r"), F.lit(189), F.lit(773), "k", F.lit("t")).alias("p"))
    assert moved.distinct().count() == 189 * 773 and moved.filter("p.l NOT BETWEEN 0 AND 188 OR p.r NOT BETWEEN 0 AND 772").count() == 0


def test_pseudonyms_of_low_area_codes_and_groups(spark):
    values = ["+1 (017) 555-7713", "+10175557713", "(212) 155-0187", "+12125551234", "+1 212 555 1234", "+44 20 7946 0958", "+442079460958", "+44-20-7946-0958", "+44 20 7946-0958", "+49 30 123456",
              "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "ES91 2100 0418 4502 0005 1332"]
    new, found = replaced(spark, values)
    assert found == [1] * len(values) and all(a != b for a, b in zip(values, new, strict=True))
    bare = [re.sub("[^0-9A-Z]", "", v) for v in new]
    assert bare[0] == bare[1] and bare[3] == bare[4] and bare[5] == bare[6] == bare[7] == bare[8] and bare[10] == bare[11]
    assert [re.sub(r"\d", "9", v) for v in new] == [re.sub(r"\d", "9", v) for v in values] and replaced(spark, new)[1] == found
    follow = ["+44 20 7946 0958 12.05.2001", "+49 30 123456 10.0.0.1", "+49 30 123456 2001-05-12", "ES91 2100 0418 4502 0005 1332 SEND"]
    new, found = replaced(spark, follow)
    assert found == [2, 2, 2, 1] and new[3].endswith(" SEND") and bare[7] == re.sub(r"\D", "", new[0])[:12]


def test_pseudonyms_of_low_area_codes_are_one_to_one(spark):
    # Both sides of each border of the classes.
    numbers = [f"+1 ({a:03}) {e:03}-{n:04}" for a in (0, 1, 17, 199, 200, 201, 999) for e in (0, 199, 200, 999) for n in (0, 1, 9999)]
    new, _ = replaced(spark, numbers)
    low = lambda v: int(v[4:7]) < 200 or int(v[9:12]) < 200
    assert len(set(new)) == len(numbers) and [low(v) for v in new] == [low(v) for v in numbers]


def test_pseudonyms_odd_input(spark):
    out = pseudonyms.pseudonymise(cases.documents(spark), "k")
    assert [r["text"] for r in out.orderBy("doc_id", "source").collect()] == [r["text"] for r in cases.documents(spark).orderBy("doc_id", "source").collect()]
    assert out.columns == [*cases.documents(spark).columns, "n_found"] and pseudonyms.pseudonymise(cases.empty(spark), "k").count() == 0
    many = " ".join(f"10.1.{k // 250}.{k % 250}" for k in range(5_000))
    row = pseudonyms.pseudonymise(spark.createDataFrame([(many,)], "text string"), "k").first()
    assert row["n_found"] == 5_000 and len(set(row["text"].split())) == 5_000


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op4_quality_knn"](spark, sf).join(queries.table(spark, sf, "labels"), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.93 * len(rows)
    assert sum(r["predicted"] for r in rows if r["quality"]) >= 0.97 * sum(r["quality"] for r in rows)


def test_classifier_odd_input(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (3, 0), (4, 1), (None, 1), (7, None), (99, 0)], "doc_id long, quality int")
    model = quality_knn.train(cases.documents(spark), labels, most_labelled=4)
    out = quality_knn.score(cases.documents(spark), model).collect()
    assert len(out) == len(cases.rows()) and all(0 <= r["score"] <= 1 for r in out)
    none = quality_knn.train(cases.documents(spark), labels.limit(0))
    assert {r["score"] for r in quality_knn.score(cases.documents(spark), none).collect()} == {0.5}
    assert quality_knn.score(cases.empty(spark), model).count() == 0


def test_votes_by_brute_force():
    rng = np.random.default_rng(4)
    rows, label = np.abs(rng.standard_normal((60, quality_knn.TRIGRAMS + quality_knn.SHAPES))).astype(np.float32), rng.integers(0, 2, 60)
    model = quality_knn.fit(rows, label, 8, 5)
    where = model.place(rows)
    for k, got in enumerate(model.score(rows)):
        cosine = where[k] @ model.labelled.T
        best = np.argsort(-cosine)[:5]
        assert got == pytest.approx((np.maximum(cosine[best], 0) * label[best]).sum() / np.maximum(cosine[best], 0).sum(), abs=1e-5)


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        following = [0]
        for k, y in enumerate(b):
            following.append(row[k] + 1 if x == y else max(following[k], row[k + 1]))
        row = following
    return row[-1]


def test_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        picked = [x for x, c in zip(a, page_diff.common(a, b), strict=True) if c]
        rest = iter(b)
        assert len(picked) == lcs_length(a, b) and all(x in rest for x in picked)


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a>Menu</a></nav>"
    "<div class='cookie-notice'>We use cookies</div>%s<aside>Other</aside><form><label>Name</label><input></form><div id=comments><p>First!</div><footer>End &copy;</footer></body></html>"
)


def test_pages(spark):
    body = "<article><h1>A &amp; B</h1><p>One<b>two</b>\n three<br>four<p>five&nbsp;<div class='ad'>Buy</div><ul><li>x<li>y</ul></article>"
    plain = [f"<div>Shared top</div><div>Only {k} here</div><p>More of {k}</p><div>Shared end</div>" for k in ("alpha", "beta", "gamma")]
    rows = [(1, "http://h/a/1", PAGE % body, "x"), (1, "http://h/a/1", PAGE % body, "x"), (2, None, None, "x"), (3, "not a url", "", "x"), (4, "http://only/1", PAGE % plain[0], "x")]
    rows += [(10 + k, f"http://g/p/{k}", PAGE % p, "x") for k, p in enumerate(plain)] + [(20, "http://g/p/0?q=1", PAGE % plain[0], "x"), (30, "http://l/", "<p>" + "w " * 100_000, "x")]
    out = page_diff.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    text = {r["row_id"]: r["text"] for r in out}
    assert len(out) == len(rows) and text[1] == "A & B Onetwo three four five x y" and text[2] == text[3] == ""
    assert text[4] == "Shared top Only alpha here More of alpha Shared end" and len(text[30]) == 199_999
    assert text[11] == "Only beta here More of beta" and text[12] == "Only gamma here More of gamma" and text[10] == text[20]
    assert page_diff.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_whose_menus_outweigh_the_article(spark):
    menu = "".join(f"<div>Menu entry number {k} of this site</div>" for k in range(30))
    article = lambda k: f"<p>Short news {k}.</p><p>More of it, {k}.</p>"
    bodies = {f"http://a/{k}": menu + article(k) for k in range(5)} | {f"http://b/{k}": f"<div class=content>{menu}{article(k)}</div>" for k in range(5)}
    # Copies that differ by a line: none may delete the article of another.
    bodies |= {f"http://c/{k}": menu + (article(0) if k < 2 else article(k)) + f"<p>#{k}</p>" for k in range(5)}
    rows = [(url, f"<html><body>{body}</body></html>") for url, body in bodies.items()]
    text = {r["url"]: r["text"] for r in page_diff.main_texts(spark.createDataFrame(rows, "url string, html string"), row_id="url").collect()}
    for k in range(5):
        assert text[f"http://a/{k}"] == text[f"http://b/{k}"] == f"Short news {k}. More of it, {k}."
        assert text[f"http://c/{k}"] == (f"Short news {0 if k < 2 else k}. More of it, {0 if k < 2 else k}. #{k}")


def test_alignment_chooses_among_marked_articles(spark):
    teaser = "<article><p>The long teaser of the host that stands on every page, below or above the news.</p><p>Its second line.</p></article>"
    news = lambda k: f"<article><p>News {k}.</p><p>Said by all.</p><p>End {k}.</p></article>"
    bodies = {f"http://a/{k}": teaser + news(k) if k % 2 else news(k) + teaser for k in range(5)}
    # A first-level heading still decides, and an only article is whole although its neighbour has the same lines.
    bodies |= {f"http://b/{k}": teaser.replace("<p>The", f"<h1>Head</h1><p>{k} the") + news(k) for k in range(3)}
    bodies |= {f"http://c/{k}": f"<article><p>Said by all.</p><p>Only {k}.</p></article>" for k in range(3)}
    rows = [(url, f"<html><body>{body}</body></html>") for url, body in bodies.items()] + [("http://a/1", f"<html><body>{bodies['http://a/1']}</body></html>")]
    out = page_diff.main_texts(spark.createDataFrame(rows, "url string, html string"), row_id="url").collect()
    text = {r["url"]: r["text"] for r in out}
    assert len(out) == len(rows)
    assert [text[f"http://a/{k}"] for k in range(5)] == [f"News {k}. Said by all. End {k}." for k in range(5)]
    assert all(text[f"http://b/{k}"].startswith(f"Head {k} the long teaser") for k in range(3))
    assert [text[f"http://c/{k}"] for k in range(3)] == [f"Said by all. Only {k}." for k in range(3)]


def test_page_query_against_the_marked_article(spark):
    pages = {r["page_id"]: r["html"] for r in queries.table(spark, SF, "pages").collect()}
    rows = queries.QUERIES["op5_page_diff"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        bare = re.sub("<[^>]*>", "", re.sub("</?(?:p|h1|br)>", " ", inner))
        assert r["text"] == " ".join(html.unescape(bare).split())


def test_blocks_hold_all_neighbours(spark):
    keys = spark.range(203).select(F.when(F.col("id") < 150, "hot").otherwise("cold").alias("host"), F.format_string("/p/%05d", "id").alias("path"), "id")
    rows = sorted(page_diff._blocks(keys).collect(), key=lambda r: (r["host"], r["path"]))
    for host in ("hot", "cold"):
        places = [(r["place"], r["block"]) for r in rows if r["host"] == host]
        assert [p for p, _ in places] == list(range(len(places)))
        sizes = [sum(b == k for _, b in places) for k in range(places[-1][1] + 1)]
        assert all(page_diff.BLOCK_PAGES <= n < 2 * page_diff.BLOCK_PAGES for n in sizes)
