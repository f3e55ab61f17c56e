"""Slots for functions from outside: encoders, judges, extractors. A slot takes a Series and gives one back.

Errors are values: a slot's result is a struct (ok, value, error). Models are loaded once per worker by `setup`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def slot(call: Callable[[str], str], setup: Callable[[], Callable[[str], str]] | None = None) -> Callable[[Column], Column]:
    """A vectorised function of one text column; with `setup`, the callable is made once per worker."""

    @F.pandas_udf("ok boolean, value string, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        own = setup() if setup else call
        rows = []
        for t in texts:
            try:
                rows.append((True, None if t is None else str(own(t)), None))
            except Exception as e:  # an error is a value, so one row does not end the job
                rows.append((False, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["ok", "value", "error"])

    return run


def hashed_encoder(dim: int = 64) -> Callable[[Column], Column]:
    """A stand-in encoder: signed counts of hashed words, of unit length; empty texts give zeros."""

    @F.pandas_udf("array<double>")
    def encode(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % dim] += 1 if h >> 63 else -1
            out.append(v / max(np.linalg.norm(v), 1e-8))
        return pd.Series(out)

    return encode


REGISTRY: dict[str, tuple[Callable, str, int]] = {}


def register_tool(spark, name: str, function: Callable, returns: str, max_calls: int = 5) -> None:
    """Makes a tool callable from SQL and keeps its call limit for the caller."""
    REGISTRY[name] = (function, returns, max_calls)
    spark.udf.register(name, function, returns)
