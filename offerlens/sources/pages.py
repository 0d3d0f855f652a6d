"""Listings from stored raw pages: pages(source_id, url, body)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.columns import last_code, nonblank, strip_markup


@dataclass(frozen=True)
class PageGrammar:
    """Patterns of one page layout; each field pattern captures its value in group 1.

    `block` matches one listing as a whole. Of several patterns for a field the first
    with a non-empty capture counts. Without `model` patterns the model is the last product code in the name.
    Fields in `required` must be present (a price: positive) for a row to be kept.
    """

    block: str
    name: tuple[str, ...]
    price: tuple[str, ...] = ()
    image: tuple[str, ...] = ()
    model: tuple[str, ...] = ()
    model_prefix: str = r"^型(?:番)?[:：\s]*"
    required: tuple[str, ...] = field(default=("name", "model_no", "price"))


def _capture(block: Column, patterns: tuple[str, ...]) -> Column:
    found = [nonblank(F.regexp_extract(block, p, 1)) for p in patterns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def absolute_url(link: Column, page_url: Column) -> Column:
    """Link resolved against the page it was found on; empty stays empty."""
    origin = F.regexp_extract(page_url, r"^[a-zA-Z][\w+.-]*://[^/?#]+", 0)
    folder = F.regexp_extract(page_url, r"^[a-zA-Z][\w+.-]*://[^/?#]+(?:/[^?#]*/|/)?", 0)
    return (
        F.when(F.coalesce(link, F.lit("")) == "", F.lit(""))
        .when(link.rlike(r"^[a-zA-Z][\w+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(page_url, "^[^:]+:", 0), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), link))
    )


def extract_listings(pages: DataFrame, grammar: PageGrammar) -> DataFrame:
    """One row per listing block: (source_id, url, position, name, model_no, image_url, price)."""
    blocks = pages.select("source_id", "url", F.posexplode(
        F.regexp_extract_all("body", F.lit(grammar.block), 0)).alias("position", "block"))
    block = F.col("block")
    name = strip_markup(_capture(block, grammar.name))
    if grammar.model:
        model = strip_markup(_capture(block, grammar.model))
        model = F.regexp_replace(F.regexp_replace(model, grammar.model_prefix, ""), "[‐-‒–—―]|&#8211;", "-")
        model = F.trim(model)
    else:
        model = F.coalesce(last_code(name), F.lit(""))
    digits = F.regexp_extract(strip_markup(_capture(block, grammar.price)), r"[\d,]+", 0) if grammar.price else F.lit("")
    rows = blocks.select(
        "source_id", "url", "position", name.alias("name"), model.alias("model_no"),
        absolute_url(F.trim(_capture(block, grammar.image)), F.col("url")).alias("image_url"),
        F.replace(digits, F.lit(","), F.lit("")).try_cast("long").alias("price"))
    for column in grammar.required:
        rows = rows.filter(F.col(column) > 0 if column == "price" else F.coalesce(F.col(column), F.lit("")) != "")
    return rows


def source_status(pages: DataFrame, pause_pattern: str, message: str = "source reports a pause") -> DataFrame:
    """Per page: 'paused' if its readable text carries the suspension notice, else 'active'."""
    paused = strip_markup("body").rlike(pause_pattern)
    return pages.withColumns({
        "status": F.when(paused, "paused").otherwise("active"),
        "message": F.when(paused, F.lit(message)).otherwise(""),
    }).drop("body")


def active_pages(pages: DataFrame, pause_pattern: str) -> DataFrame:
    """Pages without the suspension notice; only these are extracted from."""
    return pages.filter(~F.coalesce(strip_markup("body").rlike(pause_pattern), F.lit(False)))
