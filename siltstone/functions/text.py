"""Text expressions. Character classes are spelled out in ASCII, so that every SQL engine agrees on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: str | Column = "text") -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def all_words(text: str | Column = "text") -> Column:
    """Lower-cased runs of letters and digits of any script and of underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def without(tokens: Column, stop: list[str]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(stop))
