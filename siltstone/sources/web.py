"""Fetching lists of addresses, search results and paged counts, through transports that are given by the caller.

A transport is a plain function, so that offline use and tests run the same code. Errors are rows, never failures of a job.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import retrieval
from siltstone.session import ship
from siltstone.sources.paged import with_retries

SCHEMES = ("http", "https")  # fixed value
RESULTS = (1, 60)  # fixed value: least and most results of a search
PAGES = 3  # fixed value: most result pages of a search
FOLLOWED = 20  # fixed value: most continuations of one request


def scheme_error(url: str | None) -> str | None:
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://", url or "")
    return None if found and found[1].lower() in SCHEMES else f"unsupported scheme in {url!r}"


def fetch_all(urls: DataFrame, key: str, url: str, transport: Callable[[str], str], workers: int = 3, tries: int = 1) -> DataFrame:
    """(key, url, ok, content, error) of every row; up to `workers` (1 to 8) requests of a task run at once.

    Each answer stands in the row that asked for it. Other schemes than http and https are errors without a request.
    """
    ship(urls.sparkSession)
    workers = max(1, min(8, workers))
    kind = dict(urls.dtypes)[key]

    def one(address: str | None) -> tuple[bool, str | None, str | None]:
        if error := scheme_error(address):
            return False, None, error
        try:
            return True, with_retries(lambda: transport(address), tries, 0.1), None
        except Exception as e:
            return False, None, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for pdf in frames:
                answers = list(pool.map(one, pdf[url].where(pdf[url].notna(), None)))
                yield pd.DataFrame([(k, u, *a) for k, u, a in zip(pdf[key], pdf[url], answers, strict=True)], columns=["key", "url", "ok", "content", "error"])

    return urls.select(key, url).mapInPandas(run, f"key {kind}, url string, ok boolean, content string, error string").withColumnRenamed("key", key)


def search_results(hits: DataFrame, query: str, wanted: Column | int) -> DataFrame:
    """(query, url, rank): hits (query, page, place, url) of the first pages, each address once, as many as are wanted."""
    n = F.least(F.greatest(wanted if isinstance(wanted, Column) else F.lit(wanted), F.lit(RESULTS[0])), F.lit(RESULTS[1]))
    first = hits.where((F.col("page") < PAGES) & F.col("url").isNotNull()).groupBy(query, "url").agg(F.min(F.struct("page", "place")).alias("_at"))
    return retrieval.top_k(first, [query], [F.col("_at"), F.col("url")], RESULTS[1]).where(F.col("rank") <= n).select(query, "url", "rank")


def paged_counts(titles: DataFrame, title: str, transport: Callable[[list[str], str | None], dict], batch: int = 50) -> DataFrame:
    """(kind, name, to, n): what a counting service says about titles, `batch` of them a request.

    An answer is a dict with `moved` (pairs of a name and where it leads), `counts` (name to number) and `next`, a token for
    the rest of the counts, which one answer gives only in part. Rows are of kind `moved` or `count`; a failed request gives
    one row of kind `error`. `graph.resolved` and `graph.views_of` lead counts back to the titles that asked.
    """
    ship(titles.sparkSession)

    def ask(names: list[str]) -> Iterator[tuple]:
        token = None
        try:
            for turn in range(FOLLOWED):
                answer = with_retries(lambda token=token: transport(names, token), wait_s=0.1)
                if not turn:
                    yield from (("moved", a, b, None) for a, b in answer.get("moved", []))
                yield from (("count", a, None, int(n)) for a, n in answer.get("counts", {}).items())
                token = answer.get("next")
                if token is None:
                    break
        except Exception as e:
            yield "error", "|".join(names)[:200], f"{type(e).__name__}: {e}", None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            names = [t for t in dict.fromkeys(pdf[title]) if t]
            rows = [r for i in range(0, len(names), batch) for r in ask(names[i : i + batch])]
            out = pd.DataFrame(rows, columns=["kind", "name", "to", "n"])
            out["n"] = out["n"].astype("Int64")
            yield out

    return titles.select(title).mapInPandas(run, "kind string, name string, to string, n long")
