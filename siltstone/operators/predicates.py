"""Small decision rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def starts_with_any(text: Column, words: list[str]) -> Column:
    t = F.lower(F.trim(text))
    out = F.lit(False)
    for w in words:
        out = out | t.startswith(w)
    return out


def after_blank(text: Column, words: list[str]) -> Column:
    """Whether any word occurs behind a blank."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(text), F.lit(" " + w))
    return out


def heading(line: Column) -> Column:
    """`caps`, `numbered` or `title` (60 % of the words begin with a capital); null for other lines."""
    t = F.trim(line)
    words = F.filter(F.split(t, " "), lambda w: w != "")
    titled = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]"))) / F.greatest(F.size(words), F.lit(1))
    short = (F.length(t) >= 4) & (F.length(t) <= 80)
    return F.when(short & t.rlike("^[A-Z][A-Z ]+$"), "caps").when(short & t.rlike(r"^[0-9]+(\.[0-9]+)*\.? "), "numbered").when(short & (F.size(words) >= 2) & (titled >= 0.6), "title")


def by_prefix(text: Column, prefixes: list[tuple[str, str]], default: str) -> Column:
    """The label of the longest prefix that the text begins with."""
    out = None
    for p, label in sorted(prefixes, key=lambda x: (-len(x[0]), x[0])):
        out = F.when(text.startswith(p), label) if out is None else out.when(text.startswith(p), label)
    return out.otherwise(default)


def next_step(current: Column, steps: list[float]) -> Column:
    """The smallest step above the current one, 1 beyond the last."""
    return F.coalesce(F.array_min(F.filter(F.array(*[F.lit(float(s)) for s in steps]), lambda s: s > current)), F.lit(1.0))


def difficulty(rank: Column) -> Column:
    return F.when(rank.isNull(), "unreachable").when(rank == 1, "easy").when(rank <= 5, "medium").otherwise("hard")


def corrective(score: Column) -> Column:
    return F.when(score >= 0.7, "generate").when(score <= 0.3, "web").otherwise("combine")


def relation_name(text: Column) -> Column:
    """Upper case, other characters than A-Z and _ as _, cut to 40, runs of _ as one, none at the ends; or RELATED_TO."""
    t = F.substring(F.regexp_replace(F.upper(text), "[^A-Z_]", "_"), 1, 40)
    t = F.trim(F.regexp_replace(t, "_+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("RELATED_TO"))


def number(text: Column) -> Column:
    """The last number in a text without currency, grouping commas and percent signs; null without one."""
    found = F.regexp_extract_all(F.regexp_replace(text, "[$,%]", ""), F.lit("-?[0-9]+(?:[.][0-9]+)?"), F.lit(0))
    return F.try_element_at(found, F.lit(-1)).try_cast("double")


def sample_size(n: Column, share: float, least: int, most: int) -> Column:
    return F.least(n, F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(n * share)))).cast("long")
