"""The one Python column function: Unicode compatibility folding, for which Spark has no builtin."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_NUMERIC_ENTITY = re.compile(r"&#(?:\d+|[xX][0-9a-fA-F]+);")


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(StringType())
def _nfkc_decoded(values: pd.Series) -> pd.Series:
    def fold(v: str) -> str:
        return unicodedata.normalize("NFKC", _NUMERIC_ENTITY.sub(lambda m: html.unescape(m[0]), v))

    return values.map(fold, na_action="ignore")


def nfkc(c: Column) -> Column:
    """Compatibility-normalised text. ASCII is its own normal form and never goes to Python."""
    return F.coalesce(_nfkc(F.when(~c.rlike(r"^\p{ASCII}*$"), c)), c)


def nfkc_decoded(c: Column) -> Column:
    """Text with HTML entities decoded, then compatibility-normalised."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), "&nbsp;", " ")
    # ASCII without numeric entities is its own folded form and never goes to Python.
    out = F.coalesce(_nfkc_decoded(F.when(~text.rlike(r"^\p{ASCII}*$") | text.contains("&#"), text)), text)
    return F.replace(F.replace(out, F.lit("&amp;"), F.lit("&")), F.lit("&quot;"), F.lit('"'))


def katakana(c: Column) -> Column:
    """Hiragana folded to katakana."""
    hira = "".join(chr(k) for k in range(0x3041, 0x3097))
    kata = "".join(chr(k + 0x60) for k in range(0x3041, 0x3097))
    return F.translate(c, hira, kata)


def search_fold(c: Column) -> Column:
    """Form in which texts and query tokens are compared: width, kana and case folded."""
    return F.upper(F.replace(katakana(nfkc(F.coalesce(c, F.lit("")))), F.lit("　"), F.lit(" ")))


def letters_and_digits(c: Column) -> Column:
    """Only the letters and digits of an already folded text."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "")
