"""Guarded load of the attribute dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class IncompleteDetails(ValueError):
    """The source holds too few usable rows to replace the stored dimension."""


def load_details(df: DataFrame, key: str = "card_number", min_rows: int = 100) -> DataFrame:
    """Rows with a non-blank key; raises if there are fewer than `min_rows` of them."""
    valid = df.filter(F.trim(F.col(key).cast("string")) != "")
    if valid.limit(min_rows).count() < min_rows:
        raise IncompleteDetails(f"fewer than {min_rows} rows with a {key}")
    return valid
