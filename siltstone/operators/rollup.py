"""Roll-ups of telemetry and ledgers: partial aggregates per task, one shuffle on the keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.operators import ranking


def daily_cost(df: DataFrame, ts: str, keys: list[str], cost: str) -> DataFrame:
    """Calls, cost and mean cost per day and key; newest day first, then the dearest."""
    return (
        df.groupBy(F.date_trunc("day", ts).alias("day"), *keys)
        .agg(F.count(F.lit(1)).alias("n_calls"), F.sum(cost).alias("total_usd"), F.round(F.try_divide(F.sum(cost), F.count(F.lit(1))), 4).alias("avg_usd"))
        .orderBy(F.desc("day"), F.desc("total_usd"), *keys)
    )


def trailing_percentiles(df: DataFrame, ts: str, key: str, value: str, hours: int) -> DataFrame:
    """Interpolated percentiles per key over the last hours before the newest row (not before the wall clock)."""
    newest = df.agg(F.max(ts).alias("_newest"))
    recent = df.join(F.broadcast(newest), F.col(ts) >= F.col("_newest") - F.expr(f"INTERVAL {hours} HOURS"))  # one row
    p = F.expr(f"percentile({value}, array(0.5, 0.95, 0.99))")
    out = recent.groupBy(key).agg(p.alias("p"), F.max(value).alias("worst"), F.count(F.lit(1)).alias("n"))
    return out.select(key, *[F.col("p")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))], "worst", "n")


def nearest_rank(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Percentiles by position in the sorted values: p50 = v[n // 2], p95 = v[min(int(0.95 n), n - 1)].

    Positions are counted over ranges, so no group is gathered in one task.
    """
    ranked, sizes = ranking.positions(df.where(F.col(value).isNotNull()).select(key, value, order), [key], [value, order], "i")
    ranked = ranked.join(F.broadcast(sizes.withColumnRenamed(key, "_key")), F.col(key).eqNullSafe(F.col("_key")))  # one row a group
    p50 = F.max(F.when(F.col("i") == F.floor(F.col("n") / 2), F.col(value)))
    p95 = F.max(F.when(F.col("i") == F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1), F.col(value)))
    return ranked.groupBy(key).agg(p50.alias("p50"), p95.alias("p95"), F.max("n").alias("n"))


def run_summary(df: DataFrame, run: str, value: str, failed: Column) -> DataFrame:
    return df.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_steps"), F.sum(F.when(failed, 1).otherwise(0)).cast("long").alias("n_failed"),
        F.round(F.avg(value), 6).alias("avg_ms"), F.max(value).alias("max_ms"),
    )


def matrix(df: DataFrame, row: str, column: str, values: list, score: Column) -> DataFrame:
    """A pivot of mean scores with the number of pending (null) ones; the columns' values are given, not collected."""
    out = df.groupBy(row)
    cells = []
    for v in values:
        own = F.col(column) == v
        cells += [F.round(F.avg(F.when(own, score)), 6).alias(f"{v}_avg"), F.count(F.when(own, score)).alias(f"{v}_n"), F.count_if(own & score.isNull()).alias(f"{v}_pending")]
    return out.agg(*cells)


def overall_and_by(df: DataFrame, key: str, value: str, exact: Column) -> DataFrame:
    """Mean, exact matches and median for all rows (ALL) and for each key."""
    out = df.rollup(key).agg(F.grouping(key).alias("_all"), F.round(F.avg(value), 4).alias("mean"), F.count_if(exact).alias("n_exact"), F.round(F.expr(f"percentile({value}, 0.5)"), 4).alias("median"), F.count(F.lit(1)).alias("n"))
    return out.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col(key)).alias("group_name"), "mean", "n_exact", "median", "n")


def majority(df: DataFrame, group: str, vote: str, order: str) -> DataFrame:
    """Commonest vote and its share; of equals the one seen first."""
    counts = df.groupBy(group, vote).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    w = W.partitionBy(group)
    ranked = counts.select("*", F.row_number().over(w.orderBy(F.desc("n"), "first")).alias("r"), F.sum("n").over(w).alias("all"))
    return ranked.where("r = 1").select(group, F.col(vote).alias("winner"), "n", F.round(F.col("n") / F.col("all"), 6).alias("confidence"))


def frequent_with_sample(df: DataFrame, key: str, sample: Column, least: int) -> DataFrame:
    """How often each key occurs, with its smallest sample, for keys that occur often enough."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(sample).alias("sample")).where(F.col("n") >= least)


def source_sets(df: DataFrame, keys: list[str], source: str, most: int = 4) -> DataFrame:
    """The first `most` distinct sources of each key in order, joined, and their number."""
    seen = df.select(*keys, source).distinct()
    w = W.partitionBy(*keys).orderBy(source)
    ranked = seen.withColumn("r", F.row_number().over(w))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= most, F.struct("r", source)))), lambda x: x[source].cast("string")), ",")
    return ranked.groupBy(*keys).agg(listed.alias("sources"), F.count(F.lit(1)).alias("n_sources"))
