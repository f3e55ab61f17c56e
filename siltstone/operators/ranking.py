"""Exact positions in groups of any size, without a window over a group.

Rows are sorted over ranges of (group, order) and stored; a row's position comes from its place in its range and the
number of its group's rows in the ranges before, a table of as many rows as there are ranges and groups together. So a
group that holds most of the table is spread over as many tasks as its rows need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.session import stored


def positions(df: DataFrame, group: list[str], order: list[Column | str], name: str = "place") -> tuple[DataFrame, DataFrame]:
    """`df` with the row's position in its group from 0, and (group, n).

    Null groups are groups of their own. Equal rows get different positions, in any order: end the order with a key if
    that matters.
    """
    ranged = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    ranged = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_at", 33)  # the upper bits hold the range
    counts = stored(ranged.groupBy(*group, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")), "counts")
    before = F.sum("_n").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    offsets = counts.select(*keys, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    same = part == F.col("_part")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = ranged.join(F.broadcast(offsets), same)  # bounded by the number of ranges and groups
    totals = counts.groupBy(*group).agg(F.sum("_n").alias("n"))
    return out.withColumn(name, F.col("_at") + F.col("_shift")).select(*df.columns, name), totals
