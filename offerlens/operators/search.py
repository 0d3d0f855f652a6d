"""Keyword search: documents, a table of saved queries, exact and fuzzy matching.

Exact matching of all tokens never pairs every document with every query: queries are looked up by their rarest gram in an inverted index of the
grams that queries want, the same way for any number of them, and only the (document, query) pairs found are tested in full. Matching of any token, which most
pairs may pass, and fuzzy matching judge blocks of queries where a document is read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from offerlens.functions.durable import written
from offerlens.functions.skew import spread_join
from offerlens.functions.unicode import letters_and_digits, search_fold
from offerlens.operators.query_blocks import met, met_in_full

NOT_WORD = r"[^\p{L}\p{N}]+"
UNIT = "\x01"
GRAM_SIZES = (1, 2, 4, 6)
LOOKUPS = 3
BITMAP_BITS = 1 << 20
MATCHES_A_TASK = 1 << 19
# Token grammar of a query text, and the edit distances allowed up to a token length.
QUERY_TOKEN = r'(?U)[-－−]?(?:"[^"]+"|“[^”]+”|\S+)'
FUZZY_LIMITS = ((2, 0), (4, 1), (8, 2))
FUZZY_MAX = 3


def search_values(items: DataFrame, offers: DataFrame) -> DataFrame:
    """Searchable texts per item: own texts, details if attached, and the shops' names for it.

    items(entity_key, name, model_no[, details struct]); an item has at most one offer per shop.
    """
    detail_fields = ["card_name", "furigana", "effect_text", "trigger", "attribute", "card_type", "rarity", "series_title"]
    shops = offers.groupBy("entity_key").agg(F.array_sort(F.collect_list(F.struct("ordinal", "source_name", "shop_name"))).alias("s"))
    names = F.flatten(F.transform("s", lambda x: F.array(x["source_name"], x["shop_name"])))
    own = [F.col("name"), F.col("model_no")]
    features = F.array().cast("array<string>")
    if "details" in items.columns:
        have = items.schema["details"].dataType.names
        own += [F.col(f"details.{c}") for c in detail_fields if c in have]
        features = F.coalesce("details.features", features) if "features" in have else features
    values = F.concat(F.array(*own), features, F.coalesce(names, F.array().cast("array<string>")))
    return items.join(shops, "entity_key", "left").select("entity_key", F.filter(values, lambda v: F.coalesce(v, F.lit("")) != "").alias("values"))


def build_search_docs(values: DataFrame) -> DataFrame:
    """(entity_key, text, compact_text, terms) from (entity_key, values array).

    All values of a row pass the Python folding in one string.
    """
    folded = values.select("entity_key", F.split(search_fold(F.array_join("values", UNIT)), UNIT).alias("v"))
    compact = folded.withColumn("c", F.transform("v", letters_and_digits))
    words = F.flatten(F.transform("v", lambda v: F.split(v, NOT_WORD)))
    return compact.select(
        "entity_key", F.array_join("v", " ").alias("text"), F.array_join("c", " ").alias("compact_text"),
        F.array_distinct(F.filter(F.concat("c", words), lambda t: F.length(t) >= 2)).alias("terms"))


def balanced_search_docs(values: DataFrame, columns: tuple[str, ...] = ("text", "compact_text", "terms")) -> DataFrame:
    """The same columns or some of them, folded in balanced tasks however the values were split."""
    return build_search_docs(values.repartition("entity_key")).select("entity_key", *columns)


def parse_queries(queries: DataFrame) -> DataFrame:
    """Tokens (query_id, position, exclude, normalized, compact) of the texts in queries(query_id, query)."""
    source = F.trim(F.replace("query", F.lit("　"), F.lit(" ")))
    raw = queries.select("query_id", F.posexplode(F.regexp_extract_all(source, F.lit(f"({QUERY_TOKEN})"))).alias("position", "raw"))
    exclude = F.col("raw").rlike("^[-－−]")
    bare = F.when(exclude, F.expr("substring(raw, 2, length(raw))")).otherwise(F.col("raw"))
    bare = F.trim(F.regexp_replace(bare, '^["“]|["”]$', ""))
    folded = raw.select("query_id", "position", exclude.alias("exclude"), search_fold(bare).alias("normalized"))
    return folded.withColumn("compact", letters_and_digits(F.col("normalized"))).filter(F.col("compact") != "")


def allowed_distance(length: Column) -> Column:
    out = F
    for most, distance in FUZZY_LIMITS:
        out = out.when(length <= most, distance)
    return out.otherwise(FUZZY_MAX)


SHORT_TERM = 5
# (token length, term length) of the pairs with a short term that the limits allow.
SHORT_PAIRS = tuple((n, m) for n in range(3, SHORT_TERM + 3) for m in range(2, SHORT_TERM + 1) if abs(n - m) <= (1 if n <= 4 else 2))


def _less(text: Column, length: Column) -> Column:
    """The text without one of its characters, for each."""
    return F.transform(F.sequence(F.lit(1), length), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, length)))


def _shorter(text: Column, length: int, by: int) -> Column:
    """The distinct texts left when `by` characters of a text of that length are taken out."""
    def without_one(texts, size):
        return F.flatten(F.transform(texts, lambda t: _less(t, F.lit(size))))

    out = F.array(text)
    for gone in range(by):
        out = without_one(out, length - gone)
    return F.array_distinct(out)


def _short_keys(text: Column, length: Column, token: bool) -> Column:
    """Keys (n, m, side, text) of pairs of a token of length n and a term of length m up to SHORT_TERM.

    Two texts within distance k have a common subsequence k shorter than the longer one; the keys are all of that length.
    """
    none = F.array().cast("array<struct<n:int,m:int,side:int,text:string>>")

    def of_pair(n, m):
        own, common = (n if token else m), max(n, m) - (1 if n <= 4 else 2)
        keys = F.transform(_shorter(text, own, own - common), lambda t: F.struct(F.lit(n).alias("n"), F.lit(m).alias("m"), F.lit(0).alias("side"), t.alias("text")))
        return F.when(length == own, keys).otherwise(none)

    return F.flatten(F.array(*[of_pair(n, m) for n, m in SHORT_PAIRS]))


def _half_keys(term: Column, length: Column) -> Column:
    """Keys of a longer term: each half, whole and without one character."""
    head = F.floor(length / 2).cast("int")

    def side(number, part, size):
        return F.transform(F.concat(F.array(part), _less(part, size)), lambda t: F.struct(F.lit(0).alias("n"), length.alias("m"), F.lit(number).alias("side"), t.alias("text")))

    return F.array_distinct(F.concat(side(1, F.substring(term, F.lit(1), head), head), side(2, F.substring(term, head + 1, length), length - head)))


def _half_probes(token: Column, length: Column, allowed: Column) -> Column:
    """Keys under which a longer term within the allowed distance stands: of its halves one is within distance 1 of a prefix or suffix."""
    longer = F.sequence(F.greatest(length - allowed, F.lit(SHORT_TERM + 1)), F.greatest(length + allowed, F.lit(SHORT_TERM + 1)))

    def of_length(m):
        head = F.floor(m / 2).cast("int")

        def side(number, half):
            def piece(size):
                return F.substring(token, F.lit(1), size) if number == 1 else F.substring(token, length - size + 1, size)

            none = F.array().cast("array<string>")
            kept = F.concat(
                F.when(half - 1 <= length, F.array(piece(half - 1))).otherwise(none),
                F.when(half <= length, _less(piece(half), half)).otherwise(none),
                F.when(half + 1 <= length, _less(piece(half + 1), half + 1)).otherwise(none))
            return F.transform(kept, lambda t: F.struct(F.lit(0).alias("n"), m.alias("m"), F.lit(number).alias("side"), t.alias("text")))

        return F.concat(side(1, head), side(2, m - head))

    return F.array_distinct(F.flatten(F.transform(F.filter(longer, lambda m: m <= length + allowed), of_length)))


def fuzzy_terms(vocabulary: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pairs (compact, term, distance) of query tokens and vocabulary terms within the allowed distance.

    Pairs are found by equality joins and then measured. Terms of up to SHORT_TERM characters are indexed by what is left of them when characters are
    deleted: a key of a term of m characters less d is shared by at most C(m, d) * a^d terms over an alphabet of a, however large the vocabulary.
    Of a longer term, cut in halves, one half is within distance 1 of the token's beginning or end, so that
    a key keeps all but one character of a half. A term gives about as many keys as it has characters, however many tokens there are.
    """
    length = F.col("l")
    probes = tokens.select("compact").distinct().withColumn("l", F.length("compact")).filter(length > FUZZY_LIMITS[0][0]).withColumn("allowed", allowed_distance(length))
    keyed = F.concat(_short_keys(F.col("compact"), length, True), F.when(length >= SHORT_TERM, _half_probes(F.col("compact"), length, F.col("allowed"))).otherwise(F.array().cast("array<struct<n:int,m:int,side:int,text:string>>")))
    probes = probes.select("compact", "allowed", F.explode(keyed).alias("p")).select("compact", "allowed", "p.*")
    # Terms longer than any token can reach, such as whole texts, are left out before anything is shuffled.
    longest = tokens.agg((F.max(F.length("compact")) + FUZZY_MAX).alias("n")).scalar()
    terms = vocabulary.filter(F.length("term") <= longest).select("term").distinct().withColumn("l", F.length("term"))
    keys = F.when(length <= SHORT_TERM, _short_keys(F.col("term"), length, False)).otherwise(_half_keys(F.col("term"), length))
    parts = terms.select("term", F.explode(keys).alias("p")).select("term", "p.*")
    pairs = parts.join(probes, ["n", "m", "side", "text"])
    # Most pairs fail, so they are measured before the few that stay are made distinct.
    return (
        pairs.withColumn("distance", F.expr("levenshtein(term, compact, allowed)"))
        .filter(F.col("distance") >= 0).select("compact", "term", "distance").distinct()
    )


def _query_plans(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query its include and exclude tokens; a query has few tokens."""
    token = F.struct("normalized", "compact", _longest_run(F.col("normalized")).alias("run"))
    sides = tokens.groupBy("query_id").agg(
        F.collect_list(F.when(~F.col("exclude"), token)).alias("include"),
        F.collect_list(F.when(F.col("exclude"), token)).alias("exclude"))
    empty = F.array().cast("array<struct<normalized:string,compact:string,run:string>>")
    return queries.select("query_id").distinct().join(sides, "query_id", "left").select(
        "query_id", F.coalesce("include", empty).alias("include"), F.coalesce("exclude", empty).alias("exclude"))


def _longest_run(normalized: Column) -> Column:
    runs = F.regexp_extract_all(normalized, F.lit(r"([\p{L}\p{N}]+)"))
    return F.try_element_at(F.array_sort(runs, lambda a, b: F.length(b) - F.length(a)), F.lit(1))


def _contains(token: Column) -> Column:
    return F.contains(F.col("text"), token["normalized"]) | F.contains(F.col("compact_text"), token["compact"])


def _near(token: Column) -> Column:
    length = F.length(token["compact"])
    allowed = allowed_distance(length)

    def close(term: Column) -> Column:
        # With a limit only the cells of the distance table within it are filled.
        return (F.abs(F.length(term) - length) <= allowed) & (F.call_function("levenshtein", term, token["compact"], allowed) >= 0)

    return (length > FUZZY_LIMITS[0][0]) & F.exists("terms", close)


def _own_grams(normalized: Column) -> Column:
    """First and last gram, of the largest size that fits, of a token's longest run of letters and digits.

    Whichever way a token occurs in a document, its runs stand unbroken in the compact text.
    """
    run = _longest_run(normalized)
    size = F
    for n in sorted(GRAM_SIZES, reverse=True):
        size = size.when(F.length(run) >= n, n)
    return F.array_distinct(F.array(F.substring(run, F.lit(1), size), F.substring(run, F.length(run) - size + 1, size)))


def _bitmap(grams: DataFrame) -> Column:
    """A constant array of longs, 128 KB whatever the input, with a bit for the hash of every gram."""
    place = F.pmod(F.xxhash64("gram"), F.lit(BITMAP_BITS))
    words = grams.select(F.floor(place / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    held = [0] * (BITMAP_BITS // 64)
    for r in words.collect():
        held[r["word"]] = r["bits"]
    return F.from_json(F.lit(json.dumps(held)), "array<bigint>")


def gram_index(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(gram, entity_key): a written inverted index of the documents' compact texts for the wanted grams.

    A bitmap of fixed size drops other grams before any row is made of them; a fuller bitmap only drops fewer, the join is exact.
    """
    wanted = written(grams.select("gram").distinct())
    # The sizes in use, at most all of them: documents give no grams of other sizes.
    sizes = [r["n"] for r in wanted.select(F.length("gram").alias("n")).distinct().collect()]
    bits = _bitmap(wanted)

    def held(gram):
        place = F.pmod(F.xxhash64(gram), F.lit(BITMAP_BITS))
        return F.call_function("shiftright", bits[F.floor(place / 64).cast("int")], (place % 64).cast("int")).bitwiseAND(1) == 1

    of_doc = [F.filter(F.regexp_extract_all("compact_text", F.lit(rf"(?=(\S{{{n}}}))")), held) for n in sizes]
    found = docs.select("entity_key", F.explode(F.array_distinct(F.flatten(F.array(*of_doc, F.array().cast("array<string>"))))).alias("gram"))
    return written(found.join(wanted, "gram", "left_semi"))


def _rarest(lookups: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Of the lookups(keys, normalized, compact, grams) of each key the one with the fewest documents, with its gram."""
    frequency = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n_docs"))
    each = lookups.withColumn("gram", F.explode("grams")).join(frequency, "gram", "left")
    rank = F.struct(F.coalesce("n_docs", F.lit(0)), "gram", "normalized")
    return each.groupBy(*keys).agg(F.min_by(F.struct("normalized", "compact", "gram"), rank).alias("best"))


def _all_documents(docs: DataFrame, queries: DataFrame, spread: int = 64) -> DataFrame:
    """(query_id, entity_key) of queries that every document meets; such pairs are the result itself, spread over `spread` keys."""
    here = docs.select("entity_key", F.pmod(F.xxhash64("entity_key"), F.lit(spread)).alias("_salt"))
    there = queries.select("query_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))).alias("_salt"))
    return here.join(there, "_salt").select("query_id", "entity_key")


def _near_documents(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(compact, entity_key) of documents with a term near the token."""
    longest = tokens.agg((F.max(F.length("compact")) + FUZZY_MAX).alias("n")).scalar()
    terms = docs.select("entity_key", F.explode("terms").alias("term")).filter(F.length("term") <= longest)
    return terms.join(fuzzy_terms(terms, tokens).select("compact", "term"), "term").select("compact", "entity_key").distinct()


def match_queries(docs: DataFrame, tokens: DataFrame, queries: DataFrame, mode: str = "AND", fuzzy: bool = False) -> DataFrame:
    """(query_id, entity_key) of every match.

    A token hits a document if the text contains its normalized or the compact text its compact form,
    or, if fuzzy, some term is near it. Any excluded token found (never fuzzily) rules the document out; a
    query without included tokens matches all others. Under AND without fuzzy, written documents are looked up in a gram index, a query by the rarest gram
    of its longest tokens, then tested in full. Else the queries are judged where a document is read (`query_blocks`), and no document is written
    unless some query has no included token.
    """
    if mode not in ("AND", "OR"):
        raise ValueError(f"unknown mode: {mode}")
    plans = written(_query_plans(tokens, queries))
    docs = docs.select("entity_key", "text", "compact_text", *(["terms"] if fuzzy else []))
    bare = plans.filter(F.size("include") == 0)
    if mode == "AND" and not fuzzy or mode == "OR" and fuzzy or not bare.isEmpty():
        docs = written(docs)
    if mode == "OR":
        return _match_any(docs, plans, fuzzy)
    return _match_near(docs, plans) if fuzzy else _match_all(docs, plans)


def _match_all(docs: DataFrame, plans: DataFrame) -> DataFrame:
    # The longest tokens; next to one with a long gram a token with a shorter gram is of no use.
    longest = F.slice(F.array_sort("include", lambda a, b: F.length(b["run"]) - F.length(a["run"])), 1, LOOKUPS)
    useful = F.filter(longest, lambda t: F.length(t["run"]) >= F.least(F.length(longest[0]["run"]), F.lit(max(GRAM_SIZES))))
    lookups = plans.select("query_id", F.explode(useful).alias("t")).select("query_id", "t.normalized", "t.compact", _own_grams(F.col("t.normalized")).alias("grams"))
    index = gram_index(docs, lookups.select(F.explode("grams").alias("gram")))
    chosen = written(_rarest(lookups, index, ["query_id"]).select("query_id", "best.*"))
    pairs = spread_join(index, chosen.select("query_id", "gram"), ["gram"]).select("query_id", "entity_key")
    return _in_full(docs, pairs.unionByName(_all_documents(docs, plans.filter(F.size("include") == 0))), plans)


def _in_full(docs: DataFrame, pairs: DataFrame, plans: DataFrame) -> DataFrame:
    """The pairs (query_id, entity_key) whose documents contain all included tokens and no excluded one."""
    found = docs.join(pairs, "entity_key").join(plans, "query_id")
    return found.filter(~F.exists("exclude", _contains) & F.forall("include", _contains)).select("query_id", "entity_key")


def _kinds(docs: DataFrame, plans: DataFrame) -> list:
    return [to_arrow_type(docs.schema["entity_key"].dataType), to_arrow_type(plans.schema["query_id"].dataType)]


def _match_near(docs: DataFrame, plans: DataFrame) -> DataFrame:
    """Matches of AND with fuzzy tokens; each token that is only near was found with a term, which is measured here."""
    path, kinds = plans._written, _kinds(docs, plans)

    def run(batches):
        return met_in_full(batches, path, kinds, FUZZY_LIMITS, FUZZY_MAX)

    near = ArrayType(StructType([StructField("compact", StringType()), StructField("term", StringType())]))
    schema = StructType([docs.schema["entity_key"], plans.schema["query_id"], StructField("near", near)])
    found = docs.filter("entity_key IS NOT NULL").mapInArrow(run, schema)

    def measured(pair: Column) -> Column:
        return F.call_function("levenshtein", pair["term"], pair["compact"], allowed_distance(F.length(pair["compact"]))) >= 0

    bare = plans.filter(F.size("include") == 0)
    matched = found.filter(F.forall("near", measured)).select("query_id", "entity_key")
    return matched if bare.isEmpty() else matched.unionByName(_in_full(docs, _all_documents(docs, bare), plans))


def _met_queries(docs: DataFrame, plans: DataFrame) -> DataFrame:
    """(entity_key, met, included): the queries that have a token in a document, the first `included` of them an included one, the others an excluded one."""
    path, kinds = plans._written, _kinds(docs, plans)

    def run(batches):
        return met(batches, path, kinds)

    schema = StructType([docs.schema["entity_key"], StructField("met", ArrayType(plans.schema["query_id"].dataType)), StructField("included", IntegerType())])
    return docs.filter("entity_key IS NOT NULL").mapInArrow(run, schema)


def _match_any(docs: DataFrame, plans: DataFrame, fuzzy: bool) -> DataFrame:
    of_doc = written(_met_queries(docs, plans))
    # Lists of queries are short to move; a document's matches are only counted out in a task that has them all, of a bounded number of matches.
    matches = of_doc.agg(F.coalesce(F.sum(F.size("met")), F.lit(0)).alias("n")).first()["n"]
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-matches // MATCHES_A_TASK))
    listed = of_doc.repartition(tasks, "entity_key").select("entity_key", "included", F.posexplode("met").alias("place", "query_id"))
    judging = listed.select("query_id", "entity_key", (F.col("place") >= F.col("included")).alias("exclude"))
    if fuzzy:
        asked = plans.select("query_id", F.explode("include").alias("t")).select("query_id", "t.compact").distinct()
        near = _near_documents(docs, asked.select("compact")).join(asked, "compact")
        judging = judging.unionByName(near.select("query_id", "entity_key", F.lit(False).alias("exclude")))
    judged = judging.groupBy("entity_key", "query_id").agg(F.max("exclude").alias("out"))
    bare = plans.filter(F.size("include") == 0).select("query_id")
    found = judged.filter("NOT out").select("query_id", "entity_key")
    if bare.isEmpty():
        return found
    # Queries without included tokens are only met by what they exclude.
    out = judging.filter("exclude").join(bare, "query_id", "left_semi").select("query_id", "entity_key").distinct()
    return found.unionByName(_all_documents(docs, bare).join(out, ["query_id", "entity_key"], "left_anti"))
