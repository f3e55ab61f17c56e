"""Canonical JSON: keys in order at every depth, no blanks, so that equal values give equal strings and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(json: Column) -> Column:
    """The canonical form of a JSON text, null where it is none.

    A VARIANT keeps the fields of every object in the order of their names, whatever order they came in, so writing it
    out again is the recursion over all depths. Arrays keep their order; numbers are written as short as they go.
    """
    return F.to_json(F.try_parse_json(json))


def digest(json: Column) -> Column:
    return F.sha2(canonical(json), 256)
