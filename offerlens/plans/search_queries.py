"""Queries for search on the documents, and for filters and paging on part listings."""

from pyspark.sql import functions as F

from offerlens.operators import listing_filters as lf
from offerlens.operators import search, views
from offerlens.operators.listing_filters import DetailFilter
from offerlens.plans import listing as pages
from offerlens.plans.history_queries import LISTING_CTES, listing
from offerlens.plans.registry import query


def docs(i):
    """The documents with their text and source as searchable values."""
    return search.build_search_docs(i.documents.select(F.col("doc_id").alias("entity_key"), F.array("text", "source").alias("values")))


def balanced_docs(i, *columns):
    return search.balanced_search_docs(i.documents.select(F.col("doc_id").alias("entity_key"), F.array("text", "source").alias("values")), columns)


# German sharp s folds to SS, as everywhere in the search.
DOCS = """
base AS (SELECT doc_id AS entity_key, upper(replace(text, 'ß', 'ss')) AS t, upper(source) AS s FROM documents),
docs AS (SELECT entity_key, t || ' ' || s AS text, regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g') || ' ' || s AS compact_text, regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g') AS c, t, s FROM base),
doc_terms AS (SELECT DISTINCT entity_key, term FROM (SELECT entity_key, unnest(list_concat([c, s], regexp_split_to_array(t, '[^\\p{L}\\p{N}]+'))) AS term FROM docs) WHERE length(term) >= 2)
"""


@query("se1_build_search_docs", f"""WITH {DOCS}
SELECT d.entity_key, md5(d.text) AS text_md5, md5(d.compact_text) AS compact_md5, count(*) AS n_terms, md5(string_agg(term, '|' ORDER BY term)) AS terms_md5
FROM docs d JOIN doc_terms USING (entity_key) GROUP BY d.entity_key, d.text, d.compact_text""")
def build_search_docs(i):
    return docs(i).select("entity_key", F.md5("text").alias("text_md5"), F.md5("compact_text").alias("compact_md5"),
                          F.size("terms").cast("long").alias("n_terms"), F.md5(F.array_join(F.array_sort("terms"), "|")).alias("terms_md5"))


def saved_queries(i):
    """A saved query per benchmark sentence: its first two words as a phrase, the other words, and in every
    second sentence the last word reversed as an exclusion."""
    sentence = i.benchmark.select("item_id", F.posexplode(F.split("text", r"\.")).alias("n", "s"))
    words = sentence.withColumn("w", F.split(F.trim(F.regexp_replace("s", r"\s+", " ")), " ")).filter(F.size("w") >= 3)
    phrase = F.concat(F.lit('"'), F.array_join(F.slice("w", 1, 2), " "), F.lit('"　'))
    rest = F.array_join(F.slice(F.col("w"), F.lit(3), F.size("w")), "  ")
    minus = F.when(F.col("n") % 2 == 1, F.concat(F.lit(" -"), F.reverse(F.element_at("w", -1)))).otherwise("")
    return words.select((F.col("item_id") * 1000 + F.col("n")).alias("query_id"), F.concat(phrase, rest, minus).alias("query"))


TOKENS = """
sentences AS (SELECT item_id, unnest(str_split(text, '.')) AS s, generate_subscripts(str_split(text, '.'), 1) - 1 AS n FROM benchmark),
words AS (SELECT item_id * 1000 + n AS query_id, n, str_split(trim(regexp_replace(s, '\\s+', ' ', 'g')), ' ') AS w FROM sentences),
raw AS (SELECT query_id, 0 AS position, false AS exclude, w[1] || ' ' || w[2] AS word FROM words WHERE len(w) >= 3
  UNION ALL SELECT query_id, unnest(range(1, len(w) - 1)), false, unnest(w[3:]) FROM words WHERE len(w) >= 3
  UNION ALL SELECT query_id, len(w) - 1, true, reverse(w[len(w)]) FROM words WHERE len(w) >= 3 AND n % 2 = 1),
tokens AS (SELECT query_id, position, exclude, upper(replace(word, 'ß', 'ss')) AS normalized, regexp_replace(upper(replace(word, 'ß', 'ss')), '[^\\p{L}\\p{N}]', '', 'g') AS compact FROM raw)
"""


@query("se2_parse_queries", f"WITH {TOKENS} SELECT query_id, CAST(position AS BIGINT) AS position, exclude, normalized, compact FROM tokens WHERE compact <> ''")
def parse_queries(i):
    return search.parse_queries(saved_queries(i)).withColumn("position", F.col("position").cast("long"))


MATCH = f"""WITH {DOCS}, {TOKENS},
distinct_tokens AS (SELECT DISTINCT normalized, compact FROM tokens WHERE compact <> ''),
hits AS (SELECT entity_key, normalized, compact FROM docs, distinct_tokens WHERE contains(text, normalized) OR contains(compact_text, compact)),
per AS (SELECT t.query_id, h.entity_key, count(*) FILTER (NOT exclude) AS inc, count(*) FILTER (exclude) AS exc FROM tokens t JOIN hits h USING (normalized, compact) GROUP BY ALL),
need AS (SELECT query_id, count(*) FILTER (NOT exclude) AS n FROM tokens WHERE compact <> '' GROUP BY 1)
"""


def _match(i, **options):
    saved = saved_queries(i)
    columns = ("text", "compact_text", "terms") if options.get("fuzzy") else ("text", "compact_text")
    return search.match_queries(balanced_docs(i, *columns), search.parse_queries(saved), saved, **options)


@query("se3_match_queries", MATCH + "SELECT query_id, entity_key FROM per JOIN need USING (query_id) WHERE inc = n AND exc = 0")
def match_queries(i):
    return _match(i)


@query("se3_match_queries_by_grams", MATCH + "SELECT query_id, entity_key FROM per JOIN need USING (query_id) WHERE inc = n AND exc = 0")
def match_queries_by_grams(i):
    """The same on documents that are folded as they are read, in the tasks of the file."""
    saved = saved_queries(i)
    return search.match_queries(docs(i), search.parse_queries(saved), saved)


@query("se3_match_queries_any", MATCH + "SELECT query_id, entity_key FROM per WHERE inc > 0 AND exc = 0")
def match_queries_any(i):
    return _match(i, mode="OR")


FUZZY = f"""WITH {DOCS}, {TOKENS},
vocabulary AS (SELECT DISTINCT term FROM doc_terms),
needles AS (SELECT DISTINCT compact, CASE WHEN length(compact) <= 4 THEN 1 WHEN length(compact) <= 8 THEN 2 ELSE 3 END AS k FROM tokens WHERE length(compact) > 2),
-- DuckDB measures bytes: the accented letters become one-byte ones first (the texts are upper case).
needles1 AS (SELECT *, translate(compact, 'ÄÇÈÉÊÍÑÓÖÜ', 'abcdefghij') AS c1 FROM needles),
vocabulary1 AS (SELECT *, translate(term, 'ÄÇÈÉÊÍÑÓÖÜ', 'abcdefghij') AS t1 FROM vocabulary),
near AS (SELECT compact, term, levenshtein(c1, t1) AS distance FROM needles1 JOIN vocabulary1 ON abs(length(compact) - length(term)) <= k WHERE levenshtein(c1, t1) <= k)
"""


@query("se4_fuzzy_terms", FUZZY + "SELECT compact, term, distance FROM near")
def fuzzy_terms(i):
    terms = balanced_docs(i, "terms").select(F.explode("terms").alias("term"))
    return search.fuzzy_terms(terms, search.parse_queries(saved_queries(i))).withColumn("distance", F.col("distance").cast("long"))


@query("se4_match_queries_fuzzy", FUZZY + """,
distinct_tokens AS (SELECT DISTINCT normalized, compact FROM tokens WHERE compact <> ''),
exact AS (SELECT entity_key, normalized, compact FROM docs, distinct_tokens WHERE contains(text, normalized) OR contains(compact_text, compact)),
hits AS (SELECT * FROM exact UNION SELECT entity_key, normalized, compact FROM doc_terms JOIN near USING (term) JOIN distinct_tokens USING (compact)),
per AS (SELECT t.query_id, h.entity_key, count(*) AS inc FROM tokens t JOIN hits h USING (normalized, compact) WHERE NOT exclude GROUP BY ALL),
bad AS (SELECT DISTINCT t.query_id, h.entity_key FROM tokens t JOIN exact h USING (normalized, compact) WHERE exclude),
need AS (SELECT query_id, count(*) FILTER (NOT exclude) AS n FROM tokens WHERE compact <> '' GROUP BY 1)
SELECT query_id, entity_key FROM per JOIN need USING (query_id) WHERE inc = n AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.query_id = per.query_id AND b.entity_key = per.entity_key)""")
def match_queries_fuzzy(i):
    return _match(i, fuzzy=True)


MOVEMENTS = ("all", "allTimeHigh", "surge", "crash", "high", "dailyUp", "dailyDown", "weeklyUp", "weeklyDown")


@query("se5_movement_filter", LISTING_CTES + """,
idx AS (SELECT l.entity_key, l.latest_price AS p, s.* EXCLUDE (entity_key, shop_id, latest_price) FROM listing l JOIN summary s ON s.entity_key = l.entity_key AND s.shop_id = l.best_shop_id)
SELECT 'all' AS movement, entity_key FROM idx UNION ALL SELECT 'allTimeHigh', entity_key FROM idx WHERE p > 0 AND p >= max_price
UNION ALL SELECT 'surge', entity_key FROM idx WHERE day_pct >= 5 UNION ALL SELECT 'crash', entity_key FROM idx WHERE day_pct <= -5
UNION ALL SELECT 'high', entity_key FROM idx WHERE p >= 400 UNION ALL SELECT 'dailyUp', entity_key FROM idx WHERE day_diff > 0
UNION ALL SELECT 'dailyDown', entity_key FROM idx WHERE day_diff < 0 UNION ALL SELECT 'weeklyUp', entity_key FROM idx WHERE week_diff > 0
UNION ALL SELECT 'weeklyDown', entity_key FROM idx WHERE week_diff < 0
UNION ALL SELECT 'owned', entity_key FROM idx WHERE entity_key IN (SELECT entity_key FROM holdings WHERE qty > 0)
UNION ALL SELECT 'favorites', entity_key FROM idx WHERE entity_key IN (SELECT entity_key FROM favorites)""")
def movement_filter(i):
    index = pages.movement_index(*listing(i))
    named = F.array_compact(F.array(*[F.when(views.movement_filter(m, high_price=400), F.lit(m)) for m in MOVEMENTS]))
    out = index.select(F.explode(named).alias("movement"), "entity_key")
    owned = views.owned_only(index, i.holdings).select(F.lit("owned").alias("movement"), "entity_key")
    faved = views.favorites_only(index, i.favorites).select(F.lit("favorites").alias("movement"), "entity_key")
    return out.unionByName(owned).unionByName(faved)


def detail_dimension(i):
    return i.detail_rows.withColumns({
        "color": F.array_compact(F.array("color1", "color2")), "features": F.array("card_name", "attribute"),
    }).drop("color1", "color2")


def detailed_items(i):
    items = i.part_items.withColumn("name", F.trim(F.concat_ws(" ", "name", "name_code")))
    return lf.attach_details(items, detail_dimension(i))


ITEMS = "items2 AS (SELECT p.* REPLACE (trim(name || ' ' || name_code) AS name), d.* FROM part_items p LEFT JOIN detail_rows d ON d.card_number = p.code)"

FILTERS = {
    "colors": DetailFilter(colors=("red", "blue")),
    "costs": DetailFilter(costs=("0", "5")),
    "powers": DetailFilter(powers=("0", "400", "700"), counters=("-",)),
    "attributes": DetailFilter(attributes=("strike",), types=("LEADER", "EVENT", "STANDARD")),
    "blocks": DetailFilter(rarities=("L", "ZZ"), blocks=("1", "2"), min_price=1200, max_price=900),
    "extras": DetailFilter(extras=("trigger", "vanilla")),
    "art": DetailFilter(extras=("alternate",), series="OP00"),
    "blocker": DetailFilter(extras=("blocker",), max_price=1000),
}


@query("se6_detail_filter", f"""WITH {ITEMS}
SELECT 'colors' AS filter, entity_key FROM items2 WHERE color1 IN ('red', 'blue') OR color2 IN ('red', 'blue')
UNION ALL SELECT 'costs', entity_key FROM items2 WHERE cost_type = 'コスト' AND replace(coalesce(cost_value, '0'), '-', '0') IN ('0', '5')
UNION ALL SELECT 'powers', entity_key FROM items2 WHERE replace(coalesce(power, '0'), '-', '0') IN ('0', '400', '700') AND coalesce(counter, '-') = '-'
UNION ALL SELECT 'attributes', entity_key FROM items2 WHERE attribute = 'slash/strike' AND card_type IN ('LEADER', 'EVENT', 'STANDARD')
UNION ALL SELECT 'blocks', entity_key FROM items2 WHERE rarity IN ('L', 'ZZ') AND block IN ('1', '2') AND active_price BETWEEN 900 AND 1200
UNION ALL SELECT 'extras', entity_key FROM items2 WHERE trigger = 'draw' AND coalesce(effect_text, '') IN ('', '-')
UNION ALL SELECT 'art', entity_key FROM items2 WHERE entity_key % 10 = 0 AND starts_with(code, 'OP00-')
UNION ALL SELECT 'blocker', entity_key FROM items2 WHERE starts_with(effect_text, '【ブロッカー】') AND active_price <= 1000""")
def detail_filter(i):
    """Several filter settings in one pass over the items."""
    named = F.array_compact(F.array(*[F.when(lf.detail_predicate(f), F.lit(n)) for n, f in FILTERS.items()]))
    return detailed_items(i).select(F.explode(named).alias("filter"), "entity_key")


@query("se7_facet_values", f"""WITH {ITEMS},
f AS (SELECT 'colors' AS facet, color1 AS value FROM items2 UNION ALL SELECT 'colors', color2 FROM items2
  UNION ALL SELECT 'costs', replace(cost_value, '-', '0') FROM items2 WHERE cost_type = 'コスト' UNION ALL SELECT 'powers', replace(power, '-', '0') FROM items2
  UNION ALL SELECT 'counters', counter FROM items2 UNION ALL SELECT 'attributes', unnest(str_split(attribute, '/')) FROM items2 WHERE attribute <> '-'
  UNION ALL SELECT 'types', card_type FROM items2 WHERE card_type <> 'ドン!!' UNION ALL SELECT 'rarities', nullif(rarity, '') FROM items2
  UNION ALL SELECT 'blocks', block FROM items2 UNION ALL SELECT 'series', split_part(code, '-', 1) FROM items2),
firsts AS (SELECT split_part(code, '-', 1) AS value, CASE WHEN min_by(coalesce(series_title, ''), ordinal) = '' THEN split_part(code, '-', 1)
  ELSE split_part(code, '-', 1) || ' - ' || min_by(coalesce(series_title, ''), ordinal) END AS label FROM items2 GROUP BY 1),
v AS (SELECT DISTINCT facet, value FROM f WHERE value IS NOT NULL)
SELECT facet, v.value, CASE WHEN facet = 'series' THEN label ELSE v.value END AS label, row_number() OVER (PARTITION BY facet ORDER BY
  CASE facet WHEN 'types' THEN coalesce(nullif(list_position(['LEADER', 'CHARACTER', 'EVENT', 'STAGE'], v.value), 0), 99) WHEN 'rarities' THEN CASE v.value WHEN 'L' THEN 1 WHEN 'SR' THEN 4 ELSE 99 END ELSE 99 END,
  CASE WHEN v.value = '-' THEN -1 ELSE try_cast(v.value AS DOUBLE) END NULLS LAST, v.value) AS position
FROM v LEFT JOIN firsts ON facet = 'series' AND firsts.value = v.value""")
def facet_values(i):
    return lf.facet_values(detailed_items(i)).withColumn("position", F.col("position").cast("long"))


@query("se8_series_of", f"WITH {ITEMS} SELECT entity_key, split_part(code, '-', 1) AS series, starts_with(code, 'OP0') AS in_button FROM items2")
def series_of(i):
    series = lf.series_of(F.col("model_no"), F.col("name"), F.col("details.card_number"))
    return detailed_items(i).select("entity_key", series.alias("series"), lf.series_filter(series, "OP-0").alias("in_button"))


@query("se9_sort_listing", "SELECT entity_key, active_price, week_diff, model_no FROM part_items")
def sort_listing(i):
    return lf.sort_listing(i.part_items.select("entity_key", "active_price", "week_diff", "model_no"), "weeklyDesc")


@query("se9_sorted_heads", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{mode}' AS sort, entity_key, row_number() OVER (ORDER BY {column} {'ASC' if asc else 'DESC'}, entity_key) AS position FROM part_items) x WHERE position <= 300"
    for mode, (column, asc) in lf.SORTS.items()))
def sorted_heads(i):
    """First page of each of the seven orders."""
    parts = [lf.page(i.part_items, mode).select(F.lit(mode).alias("sort"), "entity_key", F.col("position").cast("long").alias("position")) for mode in lf.SORTS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("se10_page", """SELECT * FROM (SELECT entity_key, active_price, row_number() OVER (ORDER BY active_price DESC, entity_key) AS position,
  (SELECT count(*) FROM part_items) AS total FROM part_items) x WHERE position <= 600""")
def page(i):
    out = lf.page(i.part_items.select("entity_key", "active_price"), "priceDesc", 600)
    return out.withColumn("position", F.col("position").cast("long"))


@query("se11_attach_details", f"WITH {ITEMS} SELECT entity_key, name, model_no, card_number, card_name, cost_value, series_title FROM items2")
def attach_details(i):
    return detailed_items(i).select("entity_key", "name", "model_no", *[f"details.{c}" for c in ("card_number", "card_name", "cost_value", "series_title")])


@query("se12_query_listing", f"""WITH {ITEMS},
hit AS (SELECT * FROM items2 WHERE active_price > 0 AND week_diff > 0 AND starts_with(code, 'OP0') AND block IN ('0', '1')
  AND (contains(upper(name), 'RED') OR contains(upper(name), 'GEAR') OR contains(upper(coalesce(card_name, '')), 'RED') OR contains(upper(coalesce(card_name, '')), 'GEAR') OR contains(upper(coalesce(series_title, '')), 'RED')
    OR contains(upper(coalesce(effect_text, '')), 'RED') OR contains(upper(coalesce(effect_text, '')), 'GEAR'))
  AND NOT contains(upper(name), 'RING') AND NOT contains(upper(coalesce(card_name, '')), 'RING'))
SELECT * FROM (SELECT entity_key, name, active_price, row_number() OVER (ORDER BY active_price DESC, entity_key) AS position, (SELECT count(*) FROM hit) AS total FROM hit) x WHERE position <= 300""")
def query_listing(i):
    """Risen items of a series button and two blocks that match a saved search, by price."""
    items = detailed_items(i)
    offers = i.listings.select(F.col("p_partkey").alias("entity_key"), "ordinal", F.col("shop_id").alias("source_name"), F.concat(F.lit("Shop "), "shop_id").alias("shop_name"))
    found = search.build_search_docs(search.search_values(items, offers))
    saved = i.spark.sql("SELECT 'q' AS query_id, 'red gear -ring' AS query")
    out = pages.query_listing(items, found, search.parse_queries(saved), saved, mode="OR", movement="weeklyUp", series="OP-0", details=DetailFilter(blocks=("0", "1")))
    return out.select("entity_key", "name", "active_price", F.col("position").cast("long").alias("position"), "total")


@query("flagship_weekly_risers", LISTING_CTES + """,
hit AS (SELECT l.*, s.week_diff, s.week_pct FROM listing l JOIN summary s ON s.entity_key = l.entity_key AND s.shop_id = l.best_shop_id WHERE week_diff > 0)
SELECT * FROM (SELECT entity_key, name, best_shop_id, latest_price AS active_price, week_diff, week_pct, row_number() OVER (ORDER BY week_diff DESC, entity_key) AS position,
  (SELECT count(*) FROM hit) AS total FROM hit) x WHERE position <= 300""")
def weekly_risers(i):
    """Observations to change log to listing index to the page of items that rose within a week."""
    out = pages.query_listing(pages.movement_index(*listing(i)), movement="weeklyUp", sort="weeklyDesc")
    return out.select("entity_key", "name", "best_shop_id", "active_price", "week_diff", F.round("week_pct", 6).alias("week_pct"),
                      F.col("position").cast("long").alias("position"), "total")
