"""External collection files matched to priced items."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.columns import CODE_PATTERN, first_code, nonblank, variant_type_of
from offerlens.functions.durable import checkpointed
from offerlens.functions.skew import spread_join
from offerlens.functions.unicode import nfkc
from offerlens.operators import catalog as cat
from offerlens.sources.text_files import csv_header, csv_line, write_csv, write_lines

# The supported envelope version, and the confirmations a provisional variant needs.
# The format name is that of the collecting application and can be set per call.
FORMAT, VERSION = "card-collection", 1
CONFIRMED = ("manual", "image-hash", "image-path")
ENVELOPE = "format string, version string, items array<string>"


class InvalidCollection(ValueError):
    """A collection file breaks its format."""


def _parsed(payloads: DataFrame, format_name: str) -> DataFrame:
    version = F.col("doc.version").try_cast("double")
    return payloads.withColumn("doc", F.from_json("body", ENVELOPE)).withColumn(
        "violation",
        F.when(F.col("doc").isNull() | ~F.ltrim("body").startswith("{"), "not an object")
        .when(~F.col("doc.format").eqNullSafe(format_name), "unsupported format")
        .when(version.isNull() | (version != F.floor(version)), "version is no whole number")
        .when(version > VERSION, "version too new").when(version < 1, "version unsupported")
        .when(F.col("doc.items").isNull(), "no items list"))


def _items(payloads: DataFrame, code_pattern: str, format_name: str) -> DataFrame:
    """Items of well-formed envelopes with their violation, if any."""
    raw = _parsed(payloads, format_name).filter(F.col("violation").isNull()).select("payload_id", F.posexplode("doc.items").alias("position", "raw"))

    def text(name):
        return F.get_json_object("raw", f"$.{name}")

    read = raw.select(
        "payload_id", "position", "raw", nfkc(F.coalesce(text("cardNumber"), F.lit(""))).alias("n"), F.trim(nfkc(F.coalesce(text("variantId"), F.lit("")))).alias("variant_id"),
        text("id").alias("given_id"), text("variantType").alias("given_type"), text("cardName").alias("card_name"), text("count").alias("count_text"))
    numbered = read.withColumn("card_number", first_code(F.col("n"), code_pattern)).withColumn(
        "id", cat.variant_key_of(F.col("card_number"), F.col("variant_id")))
    whole = F.coalesce(F.col("count_text").rlike(r"^\d{1,15}(\.0+)?$"), F.lit(False))
    return numbered.withColumn(
        "violation",
        F.when(~F.col("raw").startswith("{"), "item is no object").when(F.col("card_number").isNull(), "cardNumber invalid")
        .when(F.col("variant_id") == "", "variantId missing").when(~whole, "count is no whole number of at least 0")
        .when(F.coalesce(nonblank("given_id"), F.col("id")) != F.col("id"), "id does not fit cardNumber and variantId"))


def collection_violations(payloads: DataFrame, code_pattern: str = CODE_PATTERN, format_name: str = FORMAT) -> DataFrame:
    """First violation per payload: (payload_id, position, violation), position null for the envelope."""
    envelope = _parsed(payloads, format_name).filter(F.col("violation").isNotNull()).select("payload_id", F.lit(None).cast("int").alias("position"), "violation")
    items = _items(payloads, code_pattern, format_name).filter(F.col("violation").isNotNull()).groupBy("payload_id").agg(
        F.min("position").alias("position"), F.min_by("violation", "position").alias("violation"))
    return envelope.unionByName(items)


def assert_collection(payloads: DataFrame, code_pattern: str = CODE_PATTERN, format_name: str = FORMAT) -> None:
    first = collection_violations(payloads, code_pattern, format_name).head()
    if first is not None:
        raise InvalidCollection(f"{first['payload_id']} item {first['position']}: {first['violation']}")


def collection_items(payloads: DataFrame, code_pattern: str = CODE_PATTERN, format_name: str = FORMAT) -> DataFrame:
    """Items of payloads(payload_id, body) without any violation in their payload."""
    bad = collection_violations(payloads, code_pattern, format_name).select("payload_id")
    return _items(payloads.join(bad, "payload_id", "left_anti"), code_pattern, format_name).select(
        "payload_id", "position", "id", "card_number", F.coalesce("card_name", F.lit("")).alias("card_name"), "variant_id",
        variant_type_of(F.col("given_type"), F.col("variant_id")).alias("variant_type"), F.col("count_text").cast("double").cast("long").alias("count"))


def match_collection(items: DataFrame, index: tuple[DataFrame, DataFrame, DataFrame], catalog: DataFrame, manual: DataFrame, generated: DataFrame,
                     restricted: tuple[str, ...] = ()) -> DataFrame:
    """Owned items with status, method or reason and price key.

    In order: a manual, then a generated mapping (must exist with the same number; provisional variants need a
    confirmation); the image hash among eligible entries; equal tags; the only entry of the number. Several
    hits by hash or tags end as ambiguous. `group_kind` names the candidates meant: by hash, tags or number.
    manual and generated: (variant_key, price_key, confirmed_by).
    """
    entries, _, hashes = index
    owned = items.filter(F.col("count") > 0)
    variants = catalog.groupBy("variant_key").agg(F.max(F.struct("provisional", "image_hash", "identity_tags")).alias("v"))
    by_key = entries.groupBy("price_key").agg(F.max_by("card_number", "entry_id").alias("mapped_number"))

    def mapping(table, name):
        """The mapped price key per variant whose entry has the number `name_number`."""
        one = table.groupBy("variant_key").agg(F.max(F.struct("price_key", "confirmed_by")).alias("m"))
        return one.select(F.col("variant_key").alias("id"), F.col("m.price_key").alias("price_key"), F.coalesce(nonblank("m.confirmed_by"), F.lit("manual")).alias("c")).join(
            by_key, "price_key").select("id", F.col("price_key").alias(name), F.col("mapped_number").alias(f"{name}_number"), F.col("c").isin(*CONFIRMED).alias(f"{name}_confirmed"))

    row = ["payload_id", "position"]
    # Everything known of an id in one written table: items, of which an id may have very many, are joined once and may be split.
    known = checkpointed(
        variants.withColumnRenamed("variant_key", "id").join(mapping(manual, "manual"), "id", "full").join(mapping(generated, "generated"), "id", "full"))
    wide = checkpointed(spread_join(owned, known, ["id"], "left").select(
        "*", F.coalesce("v.provisional", F.lit(False)).alias("provisional"), F.col("v.image_hash").alias("hash"),
        F.coalesce("v.identity_tags", F.array().cast("array<string>")).alias("expected")).drop("v"))
    by_hash = cat.eligible_extent(wide.filter("hash <> ''").select(*row, "card_number", "hash", "variant_type", "expected"), entries, hashes, "hash", row, restricted, "hash")
    wide = cat.with_tag_and_number_extents(wide, entries).join(by_hash, row, "left")

    def mapped(name):
        return F.coalesce((F.col(f"{name}_number") == F.col("card_number")) & (~F.col("provisional") | F.col(f"{name}_confirmed")), F.lit(False))

    sure, normal = ~F.col("provisional"), F.col("variant_type") == "normal"
    tags_asked = sure & (normal | (F.size("expected") > 0))
    only = sure & normal & cat.exactly_one("number") & cat.eligible(F.col("variant_type"), F.col("number_sig"), F.col("expected"), restricted)
    steps = [
        (mapped("manual"), "matched", "manual-alias", F.col("manual"), ""),
        (mapped("generated"), "matched", "generated-map", F.col("generated"), ""),
        (cat.exactly_one("hash"), "matched", "image-hash", F.col("hash_lo.price_key"), ""),
        (cat.several("hash"), "ambiguous", "image-hash-multiple", None, "hash"),
        (tags_asked & cat.exactly_one("tags"), "matched", "variant-tags", F.col("tags_lo.price_key"), ""),
        (tags_asked & cat.several("tags"), "ambiguous", "variant-tags-multiple", None, "tags"),
        (only, "matched", "unique-card-number", F.col("number_lo.price_key"), ""),
        (F.col("provisional"), "unmatched", "provisional-unconfirmed", None, "number"),
        (cat.several("number"), "ambiguous", "card-number-multiple", None, "number"),
        (F.col("number_lo").isNotNull(), "unmatched", "variant-unconfirmed", None, "number"),
        (F.lit(True), "unmatched", "card-number-not-found", None, "number"),
    ]

    def first(pick) -> Column:
        out = F
        for step in steps:
            value = pick(step)
            out = out.when(step[0], value if value is not None else F.lit(None).cast("string"))
        return out

    return wide.select(
        *items.columns, first(lambda s: F.lit(s[1])).alias("status"), first(lambda s: F.lit(s[2]) if s[1] == "matched" else None).alias("method"),
        first(lambda s: F.lit(s[2]) if s[1] != "matched" else None).alias("reason"), first(lambda s: s[3]).alias("price_key"),
        first(lambda s: F.lit(s[4])).alias("group_kind"), "expected_sig", "hash", "expected")


def collection_summary(results: DataFrame) -> DataFrame:
    """One row of totals."""
    def kinds(status):
        return F.count_if(F.col("status") == status)

    return results.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_cards"), F.count(F.lit(1)).alias("total_kinds"), kinds("matched").alias("matched_kinds"),
        F.coalesce(F.sum(F.when(F.col("status") == "matched", F.col("count"))), F.lit(0)).alias("matched_cards"),
        kinds("ambiguous").alias("ambiguous_kinds"), kinds("unmatched").alias("unmatched_kinds"))


def matches_by_key(results: DataFrame, owner: str = "payload_id") -> DataFrame:
    """Matched pieces and item kinds per owner and price key."""
    return results.filter(F.col("status") == "matched").groupBy(owner, "price_key").agg(F.sum("count").alias("count"), F.count(F.lit(1)).alias("kinds"))


def apply_matches(holdings: DataFrame, matches: DataFrame, mode: str = "replace-matched") -> DataFrame:
    """Holdings (owner_id, entity_key, qty) after matches(owner_id, entity_key, count) replace or add to them."""
    if mode not in ("replace-matched", "add"):
        raise ValueError(f"unknown mode: {mode}")
    both = holdings.join(matches.select("owner_id", "entity_key", "count"), ["owner_id", "entity_key"], "full")
    count = F.greatest(F.lit(0), "count")
    base = F.greatest(F.lit(0), F.coalesce("qty", F.lit(0))) if mode == "add" else F.lit(0)
    return both.select("owner_id", "entity_key", F.when(F.col("count").isNull(), F.col("qty")).otherwise(base + count).cast("long").alias("qty"))


def unresolved_candidates(results: DataFrame, index: tuple[DataFrame, DataFrame, DataFrame], restricted: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(unresolved items with group_id, candidates as (group_id, entry_id, price_key)).

    Items naming the same candidates share a group, so the lists are stored once.
    """
    entries, _, hashes = index
    eligibility = F.concat_ws("/", "variant_type", "expected_sig")
    group = F.concat_ws("|", "group_kind", "card_number", F.when(F.col("group_kind") == "hash", F.concat_ws("/", "hash", eligibility)).when(
        F.col("group_kind") == "tags", F.col("expected_sig")).otherwise(""))
    open_rows = results.filter(F.col("status") != "matched").withColumn("group_id", group)
    groups = open_rows.groupBy("group_id").agg(*[F.first(c).alias(c) for c in ("group_kind", "card_number", "expected_sig", "hash", "variant_type", "expected")])
    slim = entries.select("card_number", "entry_id", "price_key", "tag_sig")
    by_number = groups.filter("group_kind = 'number'").select("group_id", "card_number").join(slim, "card_number")
    by_tags = groups.filter("group_kind = 'tags'").select("group_id", "card_number", F.col("expected_sig").alias("tag_sig")).join(slim, ["card_number", "tag_sig"])
    by_hash = groups.filter("group_kind = 'hash'").drop("group_kind", "expected_sig").join(slim.join(hashes, "entry_id"), ["card_number", "hash"]).filter(
        cat.eligible(F.col("variant_type"), F.col("tag_sig"), F.col("expected"), restricted))
    cols = ["group_id", "entry_id", "price_key"]
    return open_rows, by_number.select(*cols).unionByName(by_tags.select(*cols)).unionByName(by_hash.select(*cols))


def unresolved_export(results: DataFrame, index, restricted: tuple[str, ...] = ()) -> DataFrame:
    """File rows of the unresolved items, candidate keys joined by a bar; ambiguous ones come first."""
    open_rows, candidates = unresolved_candidates(results, index, restricted)
    keys = candidates.groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry_id", "price_key"))), lambda x: x["price_key"]), "|").alias("candidate_keys"))
    return spread_join(open_rows, keys, ["group_id"], "left").select(
        "payload_id", "position", "card_number", "card_name", "variant_id", "variant_type", "count", "status", "reason",
        F.coalesce("candidate_keys", F.lit("")).alias("candidate_keys")).orderBy("payload_id", "status", "position")


def write_unresolved(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """CSV with every cell quoted, quotes doubled and a byte order mark, or JSON lines."""
    if fmt == "csv":
        write_csv(rows, path)
    else:
        rows.write.mode("overwrite").json(path)


PLACE = ("payload_id", "status", "position")
CSV_NAMES = ("cardNumber", "cardName", "variantId", "variantType", "count", "status", "reason", "candidateKeys")


def unresolved_pieces(results: DataFrame, index: tuple[DataFrame, DataFrame, DataFrame], restricted: tuple[str, ...] = (), fmt: str = "csv") -> DataFrame:
    """Text pieces of the unresolved file in long form: (payload_id, status, position, entry_id, opening, middle, closing, candidate, option).

    An item has one row without entry_id, with the text before, between and after its lists; each of its candidates has a
    row with its text in the first list and, for JSON, in the list of manual mapping options.
    """
    open_rows, candidates = unresolved_candidates(results, index, restricted)
    none = F.lit(None).cast("string")
    if fmt == "csv":
        cells = csv_line(*[F.col(c) for c in ("card_number", "card_name", "variant_id", "variant_type", "count", "status", "reason")])
        texts = [F.concat(cells, F.lit(',"')), F.lit('"'), F.lit("")]
        listed = candidates.select("group_id", "entry_id", F.replace("price_key", F.lit('"'), F.lit('""')).alias("candidate"), none.alias("option"))
    else:
        names = {"payloadId": "payload_id", "position": "position", "id": "id", "cardNumber": "card_number", "cardName": "card_name", "variantId": "variant_id",
                 "variantType": "variant_type", "count": "count", "matchStatus": "status", "reason": "reason"}
        item = F.to_json(F.struct(*[F.col(c).alias(n) for n, c in names.items()]))
        key = F.to_json(F.struct(F.col("id").alias("manualMappingKey")))
        texts = [F.concat(F.regexp_replace(item, r"\}$", ""), F.lit(',"candidates":[')),
                 F.concat(F.lit("],"), F.regexp_replace(F.substring(key, F.lit(2), F.length(key)), r"\}$", ""), F.lit(',"manualMappingOptions":[')), F.lit("]}")]
        known = index[0].select("entry_id", "name", F.coalesce(nonblank("model_no"), "card_number").alias("modelNo"), "tags")
        listed = candidates.join(known, "entry_id").select(
            "group_id", "entry_id", F.to_json(F.struct(F.col("price_key").alias("priceKey"), "name", "modelNo", "tags")).alias("candidate"),
            F.to_json(F.struct(F.col("price_key").alias("priceKey"), F.lit("manual").alias("confirmedBy"))).alias("option"))
    heads = open_rows.select(*PLACE, F.lit(None).cast(listed.schema["entry_id"].dataType).alias("entry_id"), *[t.alias(n) for t, n in zip(texts, ("opening", "middle", "closing"))])
    rows = spread_join(open_rows.select(*PLACE, "group_id"), listed, ["group_id"]).drop("group_id")
    return heads.unionByName(rows, allowMissingColumns=True)


def unresolved_lines(pieces: DataFrame, separator: str) -> DataFrame:
    """One `line` per item, in the order of payload, status (ambiguous first) and position, its candidates by entry.

    Pieces are range-partitioned by item and sorted, so a list is never an aggregate: a task passes over sorted rows and holds the
    text of one line.
    """
    placed = pieces.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE, F.col("entry_id").asc_nulls_first())
    texts = placed.select("opening", "middle", "closing", "candidate", "option")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, listed, options = None, [], []
        line = lambda: head[0] + separator.join(listed) + head[1] + separator.join(options) + head[2]
        for batch in batches:
            done = []
            for opening, middle, closing, candidate, option in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if opening is None:
                    listed.append(candidate)
                    if option is not None:
                        options.append(option)
                    continue
                if head is not None:
                    done.append(line())
                head, listed, options = (opening, middle, closing), [], []
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["line"])
        if head is not None:
            yield pa.RecordBatch.from_arrays([pa.array([line()], pa.string())], names=["line"])

    return texts.mapInArrow(run, "line string")


def write_unresolved_files(results: DataFrame, index: tuple[DataFrame, DataFrame, DataFrame], path: str, restricted: tuple[str, ...] = (), fmt: str = "csv") -> None:
    """The unresolved items as files: CSV with a byte order mark, candidate keys joined by a bar; or a JSON object a line, with the
    candidates (key, name, model, tags), the key of a manual mapping and its options."""
    pieces = unresolved_pieces(results, index, restricted, fmt)
    if fmt == "csv":
        write_lines(unresolved_lines(pieces, "|"), path, csv_header(list(CSV_NAMES)))
    else:
        write_lines(unresolved_lines(pieces, ","), path, byte_order_mark=False)
