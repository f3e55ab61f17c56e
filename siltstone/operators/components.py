"""Connected components of an edge table by alternating small-star and large-star steps.

Each step is a group-by and a join over the edges; nothing is collected. Every node ends with the smallest id of its
component. Tables of each round are written to the shared folder, so that a lost executor costs at most one round and
each join shuffles both sides itself, which lets adaptive execution split the rows of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import stored


def _settled(e: DataFrame) -> bool:
    """Whether every node has one parent and no parent has a parent of its own."""
    state = e.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("a", 0.05).alias("k")).first()
    if state["n"] > 1.5 * state["k"] + 100:  # too many parents for sure; the exact count is not needed
        return False
    if state["n"] != e.select("a").distinct().count():
        return False
    return e.join(e.select(F.col("b").alias("p")).distinct(), F.col("a") == F.col("p"), "left_semi").limit(1).count() == 0


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node id reachable."""
    e = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(most_rounds):
        if _settled(e):
            break
        # small-star: a node and its smaller neighbours hang on the smallest of them
        down = stored(e.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = stored(e.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(down.select("a", F.col("m").alias("b"))).distinct(), "edges")
        # large-star: each larger neighbour of a node hangs on the smallest neighbour of the node
        both = small.union(small.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        e = stored(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
