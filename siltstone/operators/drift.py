"""Distribution drift and regression gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

EPS = 1e-6


def windows(df: DataFrame, ts: str, keys: list[str], current: str, reference: str) -> DataFrame:
    """Rows marked `cur` or `ref` by two windows that end at the group's newest row; the reference is half-open."""
    newest = df.groupBy(*keys).agg(F.max(ts).alias("_newest"))
    rows = df.join(newest, keys)
    cut = F.col("_newest") - F.expr(f"INTERVAL {current}")
    early = cut - F.expr(f"INTERVAL {reference}")
    part = F.when(F.col(ts) >= cut, "cur").when(F.col(ts) >= early, "ref")
    return rows.withColumn("part", part).where("part IS NOT NULL").drop("_newest")


def psi(df: DataFrame, keys: list[str], value: str, bins: int = 10, least: int = 50) -> DataFrame:
    """Population stability index of `cur` against `ref`, with bins at the reference's quantiles and open ends.

    The inner edges are an array of bins - 1 numbers for each key; a value's bin is the number of edges it reaches, so
    duplicate edges make empty bins, which still count. Too few rows on either side give `insufficient`.
    """
    share = ", ".join(str(i / bins) for i in range(1, bins))
    edges = df.where("part = 'ref'").groupBy(*keys).agg(F.expr(f"percentile({value}, array({share}))").alias("edges"))
    binned = df.join(edges, keys).withColumn("bin", F.size(F.filter("edges", lambda e: F.col(value) >= e)))
    counts = binned.groupBy(*keys, "bin").agg(F.count_if(F.col("part") == "cur").alias("c"), F.count_if(F.col("part") == "ref").alias("r"))
    spine = edges.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = spine.join(counts, [*keys, "bin"], "left").na.fill(0, ["c", "r"])
    w = W.partitionBy(*keys)
    full = full.select(*keys, "c", "r", F.sum("c").over(w).alias("nc"), F.sum("r").over(w).alias("nr"))
    p, q = (F.col("r") + EPS) / (F.col("nr") + bins * EPS), (F.col("c") + EPS) / (F.col("nc") + bins * EPS)
    out = full.groupBy(*keys).agg(F.sum((q - p) * F.log(q / p)).alias("raw"), F.max("nc").alias("n_current"), F.max("nr").alias("n_reference"))
    thin = (F.col("n_current") < least) | (F.col("n_reference") < least)
    verdict = F.when(thin, "insufficient").when(F.col("raw") > 0.25, "significant").when(F.col("raw") > 0.1, "moderate").otherwise("stable")
    return out.select(*keys, F.when(~thin, F.round("raw", 4)).alias("psi"), "n_current", "n_reference", verdict.alias("verdict"))


def consecutive(df: DataFrame, keys: list[str], order: str, flag: Column, n: int) -> DataFrame:
    """Whether the last n rows of each key all hold the flag; fewer rows do not."""
    w = W.partitionBy(*keys).orderBy(F.desc(order))
    last = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return last.groupBy(*keys).agg(((F.count(F.lit(1)) == n) & F.bool_and(flag)).alias("trigger"))


def gate(candidate: Column, baseline: Column, tolerance: float) -> Column:
    """0: no worse than the tolerance allows; 1: worse; 2: a value is missing."""
    return F.when(candidate.isNull() | baseline.isNull(), 2).when(candidate < baseline - tolerance, 1).otherwise(0)
