"""Token counts by offset-mapped attribution.

A document is encoded once as a whole. The vocabulary is byte-level, so the running sum of the tokens' byte lengths
gives each token's span, and an interval join (a search of the spans' starts among the sections' ends) maps tokens to
sections. A token that crosses a boundary is allocated by `rule`:

- `start`: to the section of its first byte,
- `most`: to the section with most of its bytes, the earlier one of equals,
- `share`: to each section by its part of the bytes.

Sections are the lines of a text, each with its line break. Line numbers count from 0.

Defined cases: a null text has no sections; an empty text has none either. Empty lines are sections of one byte, the
break. The counts of a document's sections add up to its tokens under every rule. Special tokens'
strings are ordinary text. Repeated rows get equal results. Input columns named like an output are replaced.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltstone.llm.frames import append_columns

RULES = ("start", "most", "share")


@dataclass
class Vocabulary:
    """Ranks of a byte-level BPE and its pre-splitting pattern; the encoder is built once per task."""

    ranks: dict[bytes, int]
    pattern: str

    def encoder(self):
        import tiktoken

        return tiktoken.Encoding("siltstone", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})

    def lengths(self) -> np.ndarray:
        out = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for token, rank in self.ranks.items():
            out[rank] = len(token)
        return out


def load(path: str, pattern: str) -> Vocabulary:
    with open(path, "rb") as f:  # a driver-side parameter; what the tasks need is sent with them
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; `ends` are the tokens' end bytes, `bounds` the sections' bounds, from 0 to the length."""
    n = len(bounds) - 1
    if not n:
        return np.zeros(0)
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends, "left") - 1
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float)
    inside = first == last
    out = np.bincount(first[inside], minlength=n).astype(float)
    for t in np.flatnonzero(~inside):  # the few that cross a boundary
        k = np.arange(first[t], last[t] + 1)
        part = np.minimum(bounds[k + 1], ends[t]) - np.maximum(bounds[k], starts[t])
        if rule == "share":
            out[k] += part / (ends[t] - starts[t])
        else:
            out[k[part.argmax()]] += 1
    return out


def line_bounds(raw: bytes) -> np.ndarray:
    cuts = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.unique(np.concatenate([[0], cuts, [len(raw)]])) if raw else np.zeros(1, np.int64)


class Counter:
    def __init__(self, v: Vocabulary):
        self.encode = v.encoder().encode_ordinary
        self.lengths = v.lengths()

    def __call__(self, text: str, rule: str) -> tuple[int, np.ndarray]:
        """(tokens of the text, tokens attributed to each of its lines)."""
        raw = text.encode("utf-8", "replace")
        ids = np.fromiter(self.encode(text), np.int64)
        return len(ids), attribute(np.cumsum(self.lengths[ids]), line_bounds(raw), rule)


def per_line(df: DataFrame, v: Vocabulary, rule: str = "most", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`df` (or its columns `keep`) with n_tokens and line_tokens, the tokens of each line of the text."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def make():
        count = Counter(v)

        def apply(batch: pa.RecordBatch) -> list:
            column = batch.column(batch.schema.names.index(text))
            parts, sizes, totals = [], [], []
            for x in column:
                t = x.as_py()
                n, got = count(t, rule) if t else (0, np.zeros(0))
                parts.append(got)
                sizes.append(len(got))
                totals.append(None if t is None else n)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            mask = column.is_null() if column.null_count else None
            return [totals, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0)), mask=mask)]

        return apply

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("line_tokens", T.ArrayType(T.DoubleType()))]
    return append_columns(df, fields, make, keep)
