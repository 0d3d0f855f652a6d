"""Listings from stored pages of a JSON API: payloads(source_id, page, body)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.functions.columns import nonblank, strip_markup

ENVELOPE = """result boolean, last_page string, records array<struct<
  id string, name string, extra_difference string, model_number string, amount double, rarity string,
  original_image_source string, ocha_product struct<image_source string>>>"""


class PayloadContractError(ValueError):
    """A stored payload does not follow the page contract."""


def _checked(payloads: DataFrame, max_pages: int) -> DataFrame:
    parsed = payloads.withColumn("doc", F.from_json("body", ENVELOPE))
    declared = F.coalesce(nonblank("doc.last_page"), F.lit("1"))
    # Inside brackets, so that text after the document is noticed too.
    as_list = F.try_parse_json(F.concat(F.lit("["), "body", F.lit("]")))
    malformed = as_list.isNull() | F.try_variant_get(as_list, "$[0]", "string").isNull() | F.try_variant_get(as_list, "$[1]", "string").isNotNull()
    last_page = F.when(declared == "0", 1).otherwise(declared.try_cast("int"))
    return parsed.withColumn(
        "violation",
        F.when(malformed, "invalid JSON")
        .when(~F.coalesce("doc.result", F.lit(False)) | F.col("doc.records").isNull(), "invalid response")
        .when(F.coalesce(last_page.isNull() | (last_page < F.col("page")) | (last_page > max_pages), F.lit(True)),
              F.concat(F.lit("invalid last_page: "), F.coalesce("doc.last_page", F.lit("null")))),
    )


def payload_violations(payloads: DataFrame, max_pages: int = 100) -> DataFrame:
    """Payloads breaking the contract: (source_id, page, violation)."""
    return _checked(payloads, max_pages).filter(F.col("violation").isNotNull()).select("source_id", "page", "violation")


def assert_payloads(payloads: DataFrame, max_pages: int = 100) -> None:
    first = payload_violations(payloads, max_pages).orderBy("source_id", "page").head()
    if first is not None:
        raise PayloadContractError(f"{first['source_id']} page {first['page']}: {first['violation']}")


def ingest_paged_json(payloads: DataFrame, max_pages: int = 100, on_violation: str = "raise") -> DataFrame:
    """Listings of all payloads; a page that breaks the contract fails the job, as an incomplete source must not pass for a complete one.

    With on_violation="skip" such pages are left out; `payload_violations` lists them. Of records with the same id the later one (page, position) holds.

    The choice is an aggregate combined before the shuffle, so a record repeated on very
    many pages does not gather in one task. Records without id never replace each other.
    """
    if on_violation not in ("raise", "skip"):
        raise ValueError(f"unknown on_violation: {on_violation}")
    checked = _checked(payloads, max_pages)
    if on_violation == "raise":
        message = F.concat_ws(" ", F.col("source_id").cast("string"), F.lit("page"), F.col("page").cast("string"), "violation")
        checked = checked.withColumn("violation", F.when(F.col("violation").isNotNull(), F.raise_error(message)))
    valid = checked.filter(F.col("violation").isNull())
    records = valid.select("source_id", "page", F.posexplode("doc.records").alias("position", "record"))
    record_id = F.coalesce("record.id", F.concat_ws(":", F.lit("page"), F.col("page").cast("string"), F.lit("index"), F.col("position").cast("string")))
    kept = records.groupBy("source_id", record_id.alias("record_id")).agg(
        F.max_by("record", F.struct("page", "position")).alias("r"))
    text = {c: F.coalesce(strip_markup(f"r.{c}"), F.lit("")) for c in ("name", "extra_difference", "model_number", "rarity")}
    extra = F.when(F.coalesce("r.extra_difference", F.lit("")) != "", F.concat(F.lit("("), text["extra_difference"], F.lit(")"))).otherwise("")
    return kept.select(
        "source_id", "record_id", F.concat(text["name"], extra).alias("name"), text["model_number"].alias("model_no"),
        F.coalesce(nonblank("r.ocha_product.image_source"), nonblank("r.original_image_source"), F.lit("")).alias("image_url"),
        F.col("r.amount").alias("price"), text["rarity"].alias("rarity"),
    ).filter((F.col("name") != "") & (F.col("model_no") != "") & (F.col("price") > 0))
