"""Column expressions shared by the operators (everything here stays JVM-side)."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# The product-code format and the image-file endings.
CODE_PATTERN = r"(?:OP|ST|EB|PRB)\d{2}-\d{3}|P-\d{3}"
BOUNDED_CODE_PATTERN = r"(?:^|[^A-Z0-9])((?:(?:OP|EB|ST|PRB)\d{2}|P)-\d{3})(?:\D|$)"
IMAGE_ENDINGS = ("avif", "gif", "jpg", "jpeg", "png", "webp")


def nonblank(c) -> Column:
    """The value, or null where it is null or the empty string."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != "", c)


def round_half_up(c: Column) -> Column:
    """Round to a whole number, halves towards plus infinity."""
    return F.floor(c + F.lit(0.5)).cast("long")


def percent_of(diff: Column, base: Column) -> Column:
    """diff as a percentage of base, 0 where base is not positive."""
    return F.when(base > 0, diff / base * 100).otherwise(F.lit(0.0))


def strip_markup(c) -> Column:
    """Readable text of an HTML fragment: no tags or control characters, single spaces."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(c, r"[\x00-\x1f\x7f]", " ")
    c = F.regexp_replace(c, "<[^>]*>", "")
    c = F.replace(F.replace(c, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def last_code(c: Column, pattern: str = CODE_PATTERN) -> Column:
    """Last product code in the text, upper case, null where there is none."""
    return F.try_element_at(F.regexp_extract_all(F.upper(c), F.lit(f"({pattern})"), 1), F.lit(-1))


def first_code(c: Column, pattern: str = CODE_PATTERN) -> Column:
    """First product code in the trimmed upper-case text, null where there is none."""
    return nonblank(F.regexp_extract(F.upper(F.trim(c)), f"({pattern})", 1))


def bounded_code(c: Column) -> Column:
    """First product code not glued to other letters or digits, null where there is none."""
    return nonblank(F.regexp_extract(F.upper(F.trim(c)), BOUNDED_CODE_PATTERN, 1))


def image_identity(url: Column) -> Column:
    """Lower-case file name of an image URL without query, folder and ending; null if empty."""
    path = F.regexp_replace(F.trim(url), "[?#].*$", "")
    name = F.element_at(F.split(path, "/"), -1)
    name = F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)
    return nonblank(F.lower(F.regexp_replace(name, rf"(?i)\.(?:{'|'.join(IMAGE_ENDINGS)})$", "")))


def variant_type_of(given: Column, variant_id: Column) -> Column:
    """Declared variant type if known, else read from the variant id's suffix."""
    return (
        F.when(given.isin("normal", "alternate-art", "alternate-rarity"), given)
        .when(variant_id.rlike(r"(?i)_r\d+$"), F.lit("alternate-rarity"))
        .when(variant_id.rlike(r"(?i)_p\d+$"), F.lit("alternate-art"))
        .otherwise(F.lit("normal"))
    )


def tag_signature(tags: Column) -> Column:
    """Order-free, duplicate-free text form of a tag array, for equality joins."""
    return F.array_join(F.array_sort(F.array_distinct(F.coalesce(tags, F.array().cast("array<string>")))), "+")


def constant_rows(rows: list[dict], schema: str) -> Column:
    """A small configuration list as one constant array column (folded by the optimizer)."""
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), f"array<struct<{schema}>>")


def has_any(array: Column, values) -> Column:
    return F.arrays_overlap(array, F.array(*[F.lit(v) for v in values]))
