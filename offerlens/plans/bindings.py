"""Operator inputs derived from the benchmark tables.

Each binding is one SELECT that Spark and DuckDB both understand; Spark runs it on the
parquet tables, the oracles use the same text as a common table expression.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from offerlens.functions.durable import written

BINDINGS: dict[str, str] = {}

# --- observations of five shops, from the event stream -------------------------------------
BINDINGS["shops"] = """
SELECT * FROM (VALUES
  ('click', 'Click Shop', 0, true), ('error', 'Error Shop', 1, false), ('purchase', 'Purchase Shop', 2, true),
  ('signup', 'Signup Shop', 3, true), ('view', 'View Shop', 4, true)) AS t(shop_id, shop_name, ordinal, enabled)"""
BINDINGS["obs"] = """
SELECT user_id AS entity_key, event_type AS shop_id, CAST(ts AS DATE) AS obs_date, event_id AS obs_seq,
       CAST(floor(value / 50) * 100 + 100 AS BIGINT) AS price
FROM events"""
BINDINGS["daily"] = """
SELECT entity_key, shop_id, obs_date AS date, max_by(price, obs_seq) AS price, min(price) AS low, max(price) AS high
FROM obs GROUP BY entity_key, shop_id, obs_date"""
BINDINGS["hist"] = """
SELECT entity_key, shop_id, date, price FROM (
  SELECT d.*, lag(price) OVER (PARTITION BY entity_key, shop_id ORDER BY date) AS prev FROM daily d) x
WHERE prev IS NULL OR low <> prev OR high <> prev"""
BINDINGS["offers"] = """
SELECT entity_key, shop_id, max_by(price, obs_seq) AS latest_price,
       CASE WHEN (entity_key + length(shop_id)) % 4 = 0 THEN ''
            ELSE concat('https://img.example/', shop_id, '/', entity_key, '.png') END AS image_url,
       concat(shop_id, ' listing ', entity_key) AS source_name,
       concat('https://', shop_id, '.example/list') AS source_url
FROM obs GROUP BY entity_key, shop_id"""
BINDINGS["items"] = """
SELECT entity_key, concat('Item ', entity_key) AS name,
       concat('OP', lpad(CAST(entity_key % 37 AS VARCHAR(20)), 2, '0'), '-', lpad(CAST(entity_key % 1000 AS VARCHAR(20)), 3, '0')) AS model_no,
       '' AS image_url
FROM (SELECT DISTINCT user_id AS entity_key FROM events) u"""
BINDINGS["last_day"] = "SELECT max(obs_date) AS last_day FROM obs"
BINDINGS["batch"] = "SELECT * FROM obs WHERE obs_date = (SELECT last_day FROM last_day)"
BINDINGS["earlier"] = "SELECT * FROM obs WHERE obs_date < (SELECT last_day FROM last_day)"
BINDINGS["stored"] = "SELECT DISTINCT entity_key, shop_id FROM earlier"
# One item-level history per item: the day's best price of any shop, as a change log.
BINDINGS["item_hist"] = """
SELECT entity_key, date, price FROM (
  SELECT m.*, lag(price) OVER (PARTITION BY entity_key ORDER BY date) AS prev
  FROM (SELECT entity_key, date, max(price) AS price FROM daily GROUP BY entity_key, date) m) x
WHERE prev IS NULL OR prev <> price"""

# --- price lots: one row per part, return flag (as shop) and ship day -------------------------
BINDINGS["lots"] = """
SELECT l_partkey AS entity_key, l_returnflag AS shop_id, CAST(l_shipdate AS DATE) AS date,
       max(CAST(round(l_extendedprice / l_quantity) AS BIGINT)) AS price
FROM lineitem GROUP BY 1, 2, 3"""

# --- listings: every part as three shops spell it; six parts share a product code ---------------
BINDINGS["parts"] = """
SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, adj, vtag, concat(prefix, lpad(CAST(CAST(floor(g / 1000) AS BIGINT) % 100 AS VARCHAR(20)), 2, '0'), '-',
         lpad(CAST(g % 1000 AS VARCHAR(20)), 3, '0')) AS code
FROM (SELECT p.*, split_part(p_name, ' ', 1) AS adj, CAST(floor(p_partkey / 6) AS BIGINT) AS g,
        CASE CAST(floor(p_partkey / 600000) AS BIGINT) % 3 WHEN 0 THEN 'OP' WHEN 1 THEN 'ST' ELSE 'EB' END AS prefix,
        CASE p_partkey % 6 WHEN 2 THEN 'parallel' WHEN 3 THEN 'serial' WHEN 4 THEN 'opened' WHEN 5 THEN 'unopened' ELSE '' END AS vtag
      FROM part p) x"""
BINDINGS["lot_offers"] = """
SELECT entity_key, shop_id, max_by(price, date) AS latest_price, max(date) AS last_date FROM lots GROUP BY entity_key, shop_id"""
BINDINGS["listings"] = """
SELECT p.p_partkey, o.shop_id, o.latest_price, o.last_date, p.code, p.adj, p.vtag, p.p_name, p.p_size,
  p_partkey * 3 + CASE o.shop_id WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS ordinal,
  CASE o.shop_id
    WHEN 'A' THEN concat(p_name, ' [', CASE vtag WHEN 'parallel' THEN 'Parallel Foil' WHEN 'serial' THEN 'Serial' WHEN 'opened' THEN 'Opened' WHEN 'unopened' THEN 'UNOPENED' ELSE 'R' END, '] (', adj, ')')
    WHEN 'N' THEN concat(p_name, ' ', lower(code), ' (', upper(adj), '/R/2024)')
    ELSE concat('[', adj, ']', p_name, CASE vtag WHEN 'opened' THEN ' ※opened' WHEN 'unopened' THEN ' unopened' ELSE '' END) END AS name,
  CASE o.shop_id WHEN 'A' THEN code WHEN 'N' THEN concat('No: ', vtag) ELSE concat(code, CASE vtag WHEN 'parallel' THEN '※parallel' WHEN 'serial' THEN '※serial' ELSE '' END) END AS model_no
FROM parts p JOIN lot_offers o ON p.p_partkey = o.entity_key"""
BINDINGS["identities"] = """
SELECT p_partkey, code, concat(lower(code), '@', CASE WHEN vtag = '' THEN adj WHEN vtag < adj THEN concat(vtag, '+', adj) ELSE concat(adj, '+', vtag) END) AS identity_key
FROM parts"""
# The same listings with one item each; shop N names the noun where the others name the adjective.
BINDINGS["er"] = """
SELECT l.*, concat('k', p_partkey, shop_id) AS source_key, CASE WHEN p_size = 50 THEN concat('canon', p_partkey) END AS canonical_id,
  CASE shop_id WHEN 'N' THEN split_part(p_name, ' ', 2) ELSE adj END AS soft,
  CASE shop_id WHEN 'N' THEN concat(p_name, ' ', lower(code), ' (', upper(split_part(p_name, ' ', 2)), '/R/2024)') ELSE name END AS er_name,
  CASE WHEN p_size % 7 = 0 THEN '' WHEN shop_id = 'R' AND p_size % 2 = 1 THEN concat('http://img/', p_partkey + 1) ELSE concat('http://img/', p_partkey) END AS img
FROM listings l"""
BINDINGS["img_vectors"] = """
SELECT concat('http://img/', p.p_partkey) AS url, p.p_size AS priority, e.embedding
FROM part p JOIN embeddings e ON e.vec_id = p.p_partkey"""
BINDINGS["reviewed"] = """
SELECT concat('candidate_', code, '_serial') AS candidate_id, p_partkey AS position FROM parts WHERE vtag = 'serial' AND p_size <= 25"""
BINDINGS["lot_shops"] = """
SELECT * FROM (VALUES ('A', 'Shop A', 0, true), ('N', 'Shop N', 1, true), ('R', 'Shop R', 2, true)) AS t(shop_id, shop_name, ordinal, enabled)"""

# --- attribute dimension: one row per product code whose smallest part is not too large ----------
BINDINGS["detail_rows"] = """
SELECT code AS card_number, p_name AS card_name, adj AS color1, CASE WHEN p_size % 9 = 0 THEN 'blue' END AS color2,
  CASE WHEN p_size % 3 = 0 THEN 'ライフ' ELSE 'コスト' END AS cost_type,
  CASE WHEN p_size % 7 = 0 THEN '-' WHEN p_size % 13 = 0 THEN NULL ELSE CAST(p_size % 12 AS VARCHAR(9)) END AS cost_value,
  CASE WHEN p_size % 5 = 0 THEN '-' WHEN p_size % 11 = 0 THEN NULL ELSE CAST(p_size * 100 AS VARCHAR(9)) END AS power,
  CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN '-' ELSE '1000' END AS counter,
  CASE WHEN p_size % 6 = 0 THEN '-' WHEN p_size % 6 = 1 THEN 'slash/strike' ELSE 'wisdom' END AS attribute,
  CASE p_type WHEN 'PROMO' THEN 'LEADER' WHEN 'LARGE' THEN 'EVENT' WHEN 'SMALL' THEN 'ドン!!' ELSE p_type END AS card_type,
  CASE p_size % 4 WHEN 0 THEN 'L' WHEN 1 THEN 'SR' WHEN 2 THEN 'ZZ' ELSE '' END AS rarity, CAST(p_size % 3 AS VARCHAR(9)) AS block,
  CASE WHEN p_size % 5 = 1 THEN concat('【ブロッカー】', p_name) WHEN p_size % 5 = 2 THEN '-' ELSE '' END AS effect_text,
  CASE WHEN p_size % 7 = 2 THEN 'draw' WHEN p_size % 7 = 3 THEN '-' END AS trigger,
  CASE WHEN p_size % 2 = 0 THEN concat('Set of ', adj) END AS series_title
FROM (SELECT p.*, row_number() OVER (PARTITION BY code ORDER BY p_partkey) AS rn FROM parts p) x WHERE rn = 1 AND p_size <= 45"""
BINDINGS["part_items"] = """
SELECT p_partkey AS entity_key, CASE WHEN p_partkey % 10 = 0 THEN concat(p_name, ' SP') ELSE p_name END AS name,
  CASE WHEN p_partkey % 4 = 0 THEN concat('no ', lower(code), ' x') WHEN p_partkey % 4 = 1 THEN '' ELSE code END AS model_no,
  CASE WHEN p_partkey % 4 = 1 THEN code ELSE '' END AS name_code, code, p_partkey AS ordinal,
  CAST(round(p_retailprice) AS BIGINT) % 1500 AS active_price, p_size % 7 - 3 AS day_diff, p_size % 5 - 2 AS week_diff
FROM parts"""

# --- holdings from the order book ------------------------------------------------------------
BINDINGS["holdings"] = """
SELECT o_custkey AS owner_id, o_orderkey % (SELECT max(user_id) + 1 FROM events) AS entity_key, count(*) AS qty
FROM orders GROUP BY 1, 2"""
BINDINGS["favorites"] = """
SELECT DISTINCT o_custkey AS owner_id, o_orderkey % (SELECT max(user_id) + 1 FROM events) AS entity_key
FROM orders WHERE o_orderpriority = '1-URGENT'"""

# Bindings that a query reads many times, in different columns: they are written once per query instead of being aggregated and joined again.
WRITTEN = ("parts", "lots", "listings")

_REF = re.compile(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(_REF.findall(sql)))


def with_bindings(sql: str, local: tuple[str, ...] = ()) -> str:
    """DuckDB text: the query with every binding it uses, in dependency order, as CTEs."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in BINDINGS and name not in order:
            for dep in _needs(BINDINGS[name]):
                visit(dep)
            order.append(name)

    for name in _needs(sql):
        visit(name)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({BINDINGS[n]})" for n in order)
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Inputs:
    """Named inputs of a scale-factor folder: tables and bindings by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in self._made:
            return self._made[name]
        if name in BINDINGS:
            sql = BINDINGS[name]
            refs = [n for n in _needs(sql) if n in BINDINGS or n in TABLES]
            text = _REF.sub(lambda m: m[0] if m[1] not in refs else m[0].replace(m[1], "{" + m[1] + "}"), sql)
            made = self.spark.sql(text, **{n: getattr(self, n) for n in refs})
            if name == "parts":  # one small file is one task for all that follows
                made = made.repartition(self.spark.sparkContext.defaultParallelism)
            if name in WRITTEN:
                made = written(made)
        elif name in TABLES:
            made = table(self.spark, self.sf_dir, name)
        else:
            raise AttributeError(name)
        self._made[name] = made
        return made
