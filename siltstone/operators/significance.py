"""Paired randomisation tests between runs over the same queries.

Under the null hypothesis a query's two scores could be exchanged, so the sign of its difference may flip. A flip of all
queries is one bit of a hash for each, 60 flips a hash; the sums of a block of flips are plain aggregates, so a task
reduces its queries to one row a pair of runs and block before anything is shuffled, however many queries there are.
Differences are whole millionths, so that sums are exact and comparisons do not depend on their order.

Defined cases: a pair is compared over the queries that both runs have; null scores count as absent. Repeated rows of a
run and query are averaged. A pair without a common query has no row. All differences 0 give p = 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 60
UNIT = 1_000_000


def paired_differences(scores: DataFrame, run: str, query: str, score: str) -> DataFrame:
    """(run_a, run_b, query, d): a's score less b's in millionths, for the runs of each query in order of their names."""
    own = scores.where(F.col(score).isNotNull()).groupBy(run, query).agg(F.round(F.avg(score) * UNIT, 0).cast("long").alias("_u"))
    a = own.select(F.col(run).alias("run_a"), F.col(query).alias("query"), F.col("_u").alias("_a"))
    b = own.select(F.col(run).alias("run_b"), F.col(query).alias("query"), F.col("_u").alias("_b"))
    return a.join(b, "query").where("run_a < run_b").select("run_a", "run_b", "query", (F.col("_a") - F.col("_b")).alias("d"))


def randomisation_test(scores: DataFrame, run: str = "run", query: str = "query", score: str = "score", flips: int = 1020) -> DataFrame:
    """(run_a, run_b, n, mean_diff, p) of all pairs; `flips` is rounded up to a multiple of 60.

    p is the share of flips whose difference is at least as far from 0 as the one observed.
    """
    d = paired_differences(scores, run, query, score)
    blocks = -(-flips // BITS)
    hashed = F.md5(F.concat_ws(":", F.col("query").cast("string"), F.col("_block").cast("string")))
    rows = d.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.withColumn("_bits", F.conv(F.substring(hashed, 1, BITS // 4), 16, 10).cast("long"))
    sums = [F.sum(F.when(F.shiftright("_bits", j).bitwiseAND(F.lit(1)) == 1, F.col("d")).otherwise(-F.col("d"))).alias(f"_s{j}") for j in range(BITS)]
    flipped = rows.groupBy("run_a", "run_b", "_block").agg(*sums, F.sum("d").alias("_d"), F.count(F.lit(1)).alias("n"))
    far = F.size(F.filter(F.array(*(f"_s{j}" for j in range(BITS))), lambda s: F.abs(s) >= F.abs(F.col("_d"))))
    out = flipped.groupBy("run_a", "run_b").agg(F.max("n").alias("n"), F.max("_d").alias("_seen"), F.sum(far).alias("_far"))
    return out.select("run_a", "run_b", "n", F.round(F.col("_seen") / (F.col("n") * UNIT), 6).alias("mean_diff"), F.round(F.col("_far") / (blocks * BITS), 6).alias("p"))
