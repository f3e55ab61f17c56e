"""How far an answer's bullets rest on the passages they cite, as native expressions over a row.

An answer is a text of bullets, one a line; `[#n]` cites passage n, from 1. Words are runs of letters and digits of any
script and of underscores, without `stop`. Null answers count as empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import all_words

CITATION = r"\[#(\d+)\]"  # fixed value
LEAST_SHARED = 3  # words that a bullet shares with its passage to be faithful


def bullets(answer: Column) -> Column:
    """Lines that are not blank, without the blanks around them."""
    lines = F.transform(F.split(F.coalesce(answer, F.lit("")), "\r\n|\r|\n"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))
    return F.filter(lines, lambda b: b != "")


def cited(bullet: Column) -> Column:
    """The number of the first passage that a bullet cites, or null."""
    return F.nullif(F.regexp_extract(bullet, CITATION, 1), F.lit("")).try_cast("int")


def keywords(text: Column, stop: list[str]) -> Column:
    return F.filter(F.array_distinct(all_words(text)), lambda w: ~w.isin(stop))


def _passage(passages: Column, bullet: Column) -> Column:
    """The cited passage; null without a citation, or for a number that no passage has."""
    n = cited(bullet)
    return F.when((n >= 1) & (n <= F.size(passages)), F.get(passages, n - 1))


def undrifted(answer: Column, passages: Column, stop: list[str]) -> Column:
    """The bullets that stay when those go that share no word with the passage they cite."""
    def stays(b: Column) -> Column:
        p = _passage(passages, b)
        return p.isNull() | F.arrays_overlap(keywords(b, stop), F.array_distinct(all_words(p)))

    return F.filter(bullets(answer), stays)


def rates(answer: Column, passages: Column, query: Column, stop: list[str]) -> Column:
    """Struct of the shares of bullets with a citation and of faithful ones, the share of the query's words in the answer,
    their mean, and whether the first two reach one half."""
    own = bullets(answer)
    n = F.greatest(F.size(own), F.lit(1))
    n_cited = F.size(F.filter(own, lambda b: cited(b).isNotNull()))
    shared = lambda b: F.size(F.array_intersect(keywords(b, stop), keywords(_passage(passages, b), stop)))
    n_faithful = F.size(F.filter(own, lambda b: F.coalesce(shared(b), F.lit(0)) >= LEAST_SHARED))
    asked = keywords(F.coalesce(query, F.lit("")), stop)
    met = F.size(F.array_intersect(asked, F.array_distinct(all_words(F.coalesce(answer, F.lit(""))))))
    citation, faithful, coverage = n_cited / n, n_faithful / n, met / F.greatest(F.size(asked), F.lit(1))
    return F.struct(
        F.round(citation, 3).alias("citation_rate"), F.round(faithful, 3).alias("faithfulness_rate"), F.round(coverage, 3).alias("coverage"),
        F.round((citation + faithful + coverage) / 3, 3).alias("confidence"), ((F.round(citation, 3) >= 0.5) & (F.round(faithful, 3) >= 0.5)).alias("passes"),
    )


def context_coverage(context: Column, entities: Column) -> Column:
    """Share of the entities that occur in a context, which is an array of texts, without regard to case."""
    held = F.lower(F.array_join(context, "\n"))
    return F.when(F.size(entities) > 0, F.size(F.filter(entities, lambda e: F.contains(held, F.lower(e)))) / F.size(entities)).otherwise(F.lit(0.0))
