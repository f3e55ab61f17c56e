"""Vector expressions over ARRAY columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-8


def norm(v: str | Column) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: str | Column) -> Column:
    """The vector over its norm; norms below TINY count as TINY."""
    v = F.col(v) if isinstance(v, str) else v
    n = F.greatest(norm(v), F.lit(TINY))
    return F.transform(v, lambda x: x.cast("double") / n)


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
