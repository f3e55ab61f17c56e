"""Second-stage ranking of retrieved candidates by a score of (query, text) pairs.

`pair_slot` makes a column from an outside scorer: an Arrow batch holds the pairs of many queries, so a model sees full
batches however few candidates a query has. `overlap` is a native stand-in for a cross-encoder.
"""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import words
from siltstone.operators import retrieval
from siltstone.session import ship

Scorer = Callable[[Sequence[str], Sequence[str]], np.ndarray]


def pair_slot(setup: Callable[[], Scorer], batch: int = 256) -> Callable[[Column, Column], Column]:
    """A column of scores; `setup` loads the scorer once a task, which gets at most `batch` pairs at once.

    Pairs with a null on either side score null.
    """

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = setup()
        for queries, texts in parts:
            out = np.full(len(queries), np.nan)
            known = np.flatnonzero((queries.notna() & texts.notna()).to_numpy())
            for i in range(0, len(known), batch):
                at = known[i : i + batch]
                out[at] = score(queries.iloc[at].tolist(), texts.iloc[at].tolist())
            yield pd.Series(out).astype(object).where(~np.isnan(out), None)

    return F.pandas_udf(run, "double")


def overlap(query: Column, text: Column) -> Column:
    """Share of the words of either text that both have; texts without words score 0."""
    a, b = F.array_distinct(words(query)), F.array_distinct(words(text))
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(0.0))


def rerank(candidates: DataFrame, query: str, doc: str, score: Column, k: int | None = None) -> DataFrame:
    """(query, doc, before, score, rank): candidates (query, doc, rank, ...) by a new score, all of them without k.

    Ties keep the order of the first stage. Candidates without a score come last.
    """
    scored = candidates.select(query, doc, F.col("rank").alias("before"), F.round(score, 6).alias("score"))
    ship(candidates.sparkSession)
    return retrieval.top_k(scored, [query], [F.desc_nulls_last("score"), F.col("before"), F.col(doc)], k if k is not None else (1 << 31) - 1)
