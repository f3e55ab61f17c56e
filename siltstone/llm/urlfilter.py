"""URL filtering: longest matching rule, else a character language-model ratio. DataFrame functions only.

URLs that a rule allows or blocks train two variable-order Markov models over characters, of accepted and of rejected
URLs. Contexts are up to `ORDER - 1` characters long; each order is smoothed towards the next shorter one,
p_k = (n(context, c) + m * p_(k-1)) / (n(context) + m), and the shortest towards the uniform distribution. An URL's
score is the mean over its characters of ln p(accepted) - ln p(rejected); it is allowed from a threshold on, which is
calibrated on the URLs with a rule so that the two kinds are told apart best (highest sum of both hit rates).

The models see what follows the scheme, up to a fragment (which never reaches a server): host, path and query, with A-Z
lower-cased, digits as 0 and characters outside [a-z0./_-] as ~. With the two
padding marks that makes an alphabet of 33 characters, so the table of character runs has 33^4 rows at most whatever
the input; it is the only thing that is broadcast. Equal normalised URLs are scored once, after counting them where
they are read, so a hot host costs no more than any other.

Defined cases: a null URL or one without `://` has an empty host and path and no rule, and is scored as an empty string.
A host fits a rule if it is the rule's or ends with a dot and the rule's. Without URLs of both kinds everything without
a rule is allowed, with score 0. Repeated rows get equal results. Empty tables give empty tables. Other input columns
do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.session import stored

ORDER = 4
ALPHABET = 33
PULL = 5.0
MAX_RULES = 500
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SEEN = r"(?s)^.*?://([^#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: str) -> tuple[Column, Column]:
    """(host, path) of an URL column; both empty where there is none."""
    u = F.coalesce(F.col(url), F.lit(""))
    return F.translate(F.regexp_extract(u, URL, 1), UPPER, LOWER), F.regexp_extract(u, URL, 2)


def normal(url: str) -> Column:
    """What the models see of an URL column."""
    text = F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), SEEN, 1), UPPER, LOWER)
    return F.regexp_replace(F.regexp_replace(text, "[0-9]", "0"), "(?s)[^a-z0./_-]", "~")


def matched(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    if len(rules) > MAX_RULES:
        raise ValueError("more rules than MAX_RULES")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is tried first
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def runs(norm: str) -> Column:
    """Every run of ORDER characters of the padded URL, the last of which is the predicted one."""
    padded = F.concat(F.lit("^" * (ORDER - 1)), F.col(norm), F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(norm) + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))


def ratios(grams: DataFrame) -> DataFrame:
    """(g, llr) of every run in `grams`, which has g and its counts acc and rej."""
    seen = grams.where("acc + rej > 0")
    # counts of a context with its character (kind n) and of the context alone (kind c), for each order
    def keys(g: str) -> Column:
        out = []
        for k in range(1, ORDER + 1):
            tail = F.substring(F.col(g), F.lit(ORDER + 1 - k), F.lit(k))
            out += [F.struct(F.lit(f"n{k}").alias("kind"), tail.alias("x")), F.struct(F.lit(f"c{k}").alias("kind"), F.substring(tail, F.lit(1), F.lit(k - 1)).alias("x"))]
        return F.explode(F.array(*out)).alias("key")

    counts = seen.select(keys("g"), "acc", "rej").groupBy("key").agg(F.sum("acc").alias("a"), F.sum("rej").alias("r"))
    wanted = grams.select("g", keys("g"))
    found = wanted.join(counts, "key", "left").groupBy("g")
    cols = [F.max(F.when(F.col("key.kind") == f"{kind}{k}", F.coalesce(side, F.lit(0)))).cast("double").alias(f"{side}_{kind}{k}") for side in ("a", "r") for kind in "nc" for k in range(1, ORDER + 1)]
    found = found.agg(*cols)
    p = {}
    for side in ("a", "r"):
        p[side] = F.lit(1.0 / ALPHABET)
        for k in range(1, ORDER + 1):
            p[side] = (F.col(f"{side}_n{k}") + F.lit(PULL) * p[side]) / (F.col(f"{side}_c{k}") + F.lit(PULL))
    return found.select("g", (F.log(p["a"]) - F.log(p["r"])).alias("llr"))


def threshold(scored: DataFrame) -> float | None:
    """The score from which URLs are allowed, from at most 2001 bins; None without URLs of both kinds."""
    cell = F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.col("score") * 100)))
    bins = scored.where("acc + rej > 0").groupBy(cell.alias("bin")).agg(F.sum("acc").alias("acc"), F.sum("rej").alias("rej"))
    all_a, all_r = F.sum("acc").over(W.partitionBy()), F.sum("rej").over(W.partitionBy())
    below = W.partitionBy().orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    kept = 1 - F.coalesce(F.sum("acc").over(below), F.lit(0)) / all_a
    barred = F.coalesce(F.sum("rej").over(below), F.lit(0)) / all_r
    best = bins.where("acc + rej > 0").select("bin", F.round(kept + barred, 9).alias("gain"), all_a.alias("a"), all_r.alias("r")).where("a > 0 AND r > 0").orderBy(F.desc("gain"), "bin").first()
    return None if best is None else best["bin"] / 100


def judge(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page."""
    host, path = parts(url)
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"), normal(url).alias("norm"))
    rule, ruled = matched(rules, F.col("host"), F.col("path"))
    rows = rows.select("page_id", "host", "path", "norm", rule.alias("rule"), ruled.alias("ruled"))
    unique = stored(rows.groupBy("norm").agg(F.count_if(F.col("ruled") == "allow").alias("acc"), F.count_if(F.col("ruled") == "block").alias("rej")), "urls")
    exploded = unique.select("norm", "acc", "rej", F.explode(runs("norm")).alias("g"))
    grams = stored(exploded.groupBy("g").agg(F.sum("acc").alias("acc"), F.sum("rej").alias("rej")), "runs")
    table = stored(ratios(grams), "ratios")
    scored = exploded.join(F.broadcast(table), "g").groupBy("norm").agg(F.any_value("acc").alias("acc"), F.any_value("rej").alias("rej"), F.avg("llr").alias("score"))
    scored = stored(scored, "scores")
    limit = threshold(scored)
    score = F.col("score") if limit is not None else F.lit(0.0)
    method = F.when(score >= F.lit(limit if limit is not None else 0.0), "allow").otherwise("block")
    out = rows.join(scored.select("norm", "score"), "norm")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), F.round(score, 6).alias("score"))
