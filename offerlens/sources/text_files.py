"""Text files as spreadsheet programs read them: quoted cells, a byte order mark and the header in every file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BYTE_ORDER_MARK = "﻿"
ROWS_OF_A_PARTITION = 1 << 33  # monotonically_increasing_id counts partitions in steps of this


def csv_cell(value: Column) -> Column:
    """The value in quotes, quotes within doubled; null is an empty cell."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_line(*values: Column) -> Column:
    return F.concat_ws(",", *[csv_cell(v) for v in values])


def csv_header(names: list[str]) -> str:
    return ",".join('"' + n.replace('"', '""') + '"' for n in names)


def write_lines(lines: DataFrame, path: str, header: str | None = None, byte_order_mark: bool = True) -> None:
    """One-column table `line` as text files. Each partition is a file, whose first line gets the mark and the header before it."""
    lead = (BYTE_ORDER_MARK if byte_order_mark else "") + ("" if header is None else header + "\n")
    at_start = F.monotonically_increasing_id() % ROWS_OF_A_PARTITION == 0
    lines.select(F.concat(F.when(at_start, F.lit(lead)).otherwise(F.lit("")), F.col("line")).alias("value")).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str, byte_order_mark: bool = True) -> None:
    """All columns, every cell quoted."""
    write_lines(rows.select(csv_line(*[F.col(c) for c in rows.columns]).alias("line")), path, csv_header(rows.columns), byte_order_mark)
