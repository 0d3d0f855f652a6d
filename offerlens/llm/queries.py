"""The registered query of each operator in this subpackage, on whole tables, and its SQL oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm import block_knn, bpe, licence_scan, line_spread, minhash_join, mixing, page_diff, perplexity, prefix_trie, pseudonyms, quality_knn, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PSEUDONYM_KEY = "example key; production passes its own"
LEAST_QUALITY = 0.7
LEAST_TOXIC = 0.5
RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basic rules and language bands of n-gram perplexity over every document."""
    rows = perplexity.quality_rules(table(spark, sf_dir, "documents"), from_files=True)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bits")


@query
def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence wordings in every document: lines, paragraphs and whole texts."""
    return licence_scan.scan(table(spark, sf_dir, "documents"))


@query
def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text with personal data replaced."""
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


def learnable(row_id: str) -> Column:
    """Rows whose labels may be learned from."""
    return F.crc32(F.col(row_id).cast("string")) % 4 != 2


@query
def op4_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document from labels outside the held-out quarter."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_knn.train(documents, table(spark, sf_dir, "labels"), learnable("row_id"))
    scored = quality_knn.score(documents, model)
    return scored.select("doc_id", (~learnable("doc_id")).alias("held_out"), "score", (F.col("score") >= LEAST_QUALITY).cast("int").alias("predicted"))


@query
def op5_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    texts = page_diff.main_texts(table(spark, sf_dir, "pages"))
    return texts.select(F.col("row_id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and their decoded bytes, as digests."""
    ranks = bpe.read_ranks(public_tokenizers.path(RANK_FILE))
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(documents, ranks, public_tokenizers.PATTERN, offsets=True, decoded=True)
    spans = F.concat_ws(",", F.col("token_starts").cast("array<string>"), F.col("token_ends").cast("array<string>"))
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.sha2(spans, 256).alias("offsets_sha256"))


@query
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, for source weights 5, 2, 1."""
    units = mixing.plan(table(spark, sf_dir, "documents"))
    rows = units.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    return rows.select(F.col("row_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query
def op8_block_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all other vectors for every twentieth vector."""
    found = block_knn.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query
def op9_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and number of similar documents of every document."""
    groups = minhash_join.jaccard_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("row_id").alias("doc_id"), "class_id", "n_links")


@query
def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that stand on many sources."""
    rows = line_spread.remove_boilerplate(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", "text")


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document from labels outside the held-out fifth."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.train(documents, table(spark, sf_dir, "labels"), F.crc32(F.col("row_id").cast("string")) % 5 != 0)
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= LEAST_TOXIC).cast("int").alias("predicted"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every embedding."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("row_id", "vec_id")


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of all conversations, each begun with turns of its family's first."""
    turns = table(spark, sf_dir, "conversations")
    rebuilt = prefix_trie.own_and_donors(turns, lambda c: c - c % 5, lambda c: F.crc32(c.cast("string")) % 9, most=8)
    return prefix_trie.trie(rebuilt)


ORACLES["op10_line_spread"] = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, trim(line, E' \t\r\x0b\x0c') AS k, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 1 AS judged FROM lines
), spread AS (
  SELECT k, min(doc_id) AS first_id FROM keyed WHERE judged GROUP BY k HAVING count(DISTINCT source) >= 8
), marked AS (
  SELECT keyed.*, coalesce(judged AND keyed.doc_id <> first_id, FALSE) AS struck FROM keyed LEFT JOIN spread USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(struck AS INT)) AS BIGINT) AS n_removed,
  coalesce(string_agg(CASE WHEN NOT struck THEN line END, chr(10) ORDER BY pos), '') AS text
FROM marked GROUP BY doc_id
"""
ORACLES["op2_licence_scan"] = r"""
WITH template AS (
  SELECT unnest(['@NAMES@']) AS template, unnest(['@WORDINGS@']) AS content
), texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), unit AS (
  SELECT doc_id, row, generate_subscripts(string_split(text, chr(10)), 1) AS unit, unnest(string_split(text, chr(10))) AS content FROM texts
  UNION ALL
  SELECT * FROM (
    SELECT doc_id, row, -generate_subscripts(p, 1) AS unit, unnest(p) AS content FROM (SELECT *, string_split_regex(text, '\n[ \t\r]*\n') AS p FROM texts) WHERE len(p) > 1
  ) WHERE contains(content, chr(10))
  UNION ALL
  SELECT doc_id, row, 0, text FROM texts WHERE contains(text, chr(10))
), worded AS (
  SELECT 'u' AS kind, doc_id, row, unit, NULL AS template, regexp_extract_all(lower(content), '[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*') AS w FROM unit
  UNION ALL
  SELECT 't', NULL, NULL, NULL, template, regexp_extract_all(lower(content), '[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*') FROM template
), sized AS (
  SELECT *, greatest(len(w) - 1, 1) AS size FROM worded WHERE len(w) > 0
), pair AS (
  SELECT kind, doc_id, row, unit, template, size, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS bigram FROM sized
), counted AS (
  SELECT kind, doc_id, row, unit, template, size, bigram, count(*) AS n FROM pair GROUP BY ALL
), dice AS (
  SELECT u.doc_id, u.row, u.unit, t.template, CAST(2 * sum(least(u.n, t.n)) AS DOUBLE) / (any_value(u.size) + any_value(t.size)) AS dice
  FROM counted u JOIN counted t ON u.kind = 'u' AND t.kind = 't' AND u.bigram = t.bigram GROUP BY u.doc_id, u.row, u.unit, t.template
), best AS (
  SELECT *, row_number() OVER (PARTITION BY row, unit ORDER BY dice DESC, template) AS place FROM dice WHERE dice >= 0.8 - 1e-9
)
SELECT doc_id, CAST(unit AS INT) AS unit, split_part(template, '/', 1) AS licence, template, dice FROM best WHERE place = 1
""".replace("@NAMES@", "', '".join(licence_scan.TEMPLATES)).replace("@WORDINGS@", "', '".join(licence_scan.TEMPLATES.values()))
ORACLES["op8_block_knn"] = """
WITH usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 20
"""
