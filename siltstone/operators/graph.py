"""Graphs, trees and hypergraphs as edge tables (s, rel, o). Traversals join frontiers; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.operators import ranking
from siltstone.session import stored


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b) in both directions."""
    return edges.select(F.col("s").alias("a"), F.col("o").alias("b")).union(edges.select(F.col("o").alias("a"), F.col("s").alias("b"))).distinct()


def one_hop(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Edges with an anchor (column `node`) at either end."""
    here = anchors.select(F.col("node").alias("_n"))
    return edges.join(here, F.col("s") == F.col("_n"), "left_semi").union(edges.join(here, F.col("o") == F.col("_n"), "left_semi")).distinct()


def k_hop(edges: DataFrame, anchors: DataFrame, hops: int) -> DataFrame:
    """(node, dist): nodes within `hops` steps, each at its least distance. A node is expanded once."""
    both = stored(undirected(edges), "both")
    seen = anchors.select("node").distinct().withColumn("dist", F.lit(0))
    for d in range(1, hops + 1):
        edge = seen.where(F.col("dist") == d - 1)
        new = both.join(edge, F.col("a") == F.col("node")).select(F.col("b").alias("node")).distinct()
        seen = stored(seen.union(new.join(seen, "node", "left_anti").withColumn("dist", F.lit(d))), "seen")
    return seen


def bridges(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(mid, n_a, n_b): nodes next to both ends, with the number of their edges to each."""
    both = edges.select("s", "o").union(edges.select(F.col("o").alias("s"), F.col("s").alias("o")))
    near = both.where(F.col("s").isin(a, b)).groupBy(F.col("o").alias("mid")).agg(F.count_if(F.col("s") == a).alias("n_a"), F.count_if(F.col("s") == b).alias("n_b"))
    return near.where("n_a > 0 AND n_b > 0")


def two_step(edges: DataFrame, anchor: str, first: str, second: str) -> DataFrame:
    """Targets reached from the anchor over an edge like `first` and then one like `second`, with the number of ways."""
    mid = edges.where((F.col("o") == anchor) & F.col("rel").rlike(first)).select(F.col("s").alias("mid"))
    out = edges.where(F.col("rel").rlike(second)).join(mid, F.col("o") == F.col("mid")).where(F.col("s") != anchor)
    return out.groupBy(F.col("s").alias("target")).agg(F.count(F.lit(1)).alias("ways"))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges of each node, 0 if it has none."""
    ends = edges.select(F.col("s").alias("node"), F.struct("s", "rel", "o").alias("e")).union(edges.select(F.col("o").alias("node"), F.struct("s", "rel", "o").alias("e"))).distinct()
    n = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(n, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def with_inverses(edges: DataFrame, names: dict[str, str]) -> DataFrame:
    """Adds the inverse of each edge whose relation has one, unless it is there already."""
    inverse = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.create_map().cast("map<string,string>")
    new = edges.select(F.col("o").alias("s"), inverse[F.col("rel")].alias("rel"), F.col("s").alias("o")).where("rel IS NOT NULL")
    return edges.union(new).distinct()


def passive_flipped(edges: DataFrame) -> DataFrame:
    """Edges named WAS_x or x_BY turned round, under the name x."""
    passive = F.col("rel").endswith("_BY") | F.col("rel").startswith("WAS_")
    name = F.regexp_replace("rel", "^WAS_|_BY$", "")
    return edges.select(F.when(passive, F.col("o")).otherwise(F.col("s")).alias("s"), F.when(passive, name).otherwise(F.col("rel")).alias("rel"), F.when(passive, F.col("s")).otherwise(F.col("o")).alias("o"))


def page_rank(edges: DataFrame, seeds: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, score) of personalised PageRank over undirected edges; what dangles goes back to the seeds."""
    both = undirected(edges)
    out = both.groupBy("a").agg(F.count(F.lit(1)).alias("deg"))
    links = stored(both.join(out, "a"), "links")
    n = seeds.select("node").distinct().count()
    start = seeds.select("node").distinct().withColumn("p", F.lit(1.0 / n))
    rank = start
    for i in range(rounds):
        flow = links.join(rank, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg((F.sum(F.col("p") / F.col("deg")) * damping).alias("p"))
        back = start.select("node", (F.col("p") * (1 - damping)).alias("p"))
        rank = flow.union(back).groupBy("node").agg(F.sum("p").alias("p"))
        if i % 5 == 4:
            rank = stored(rank, "rank")
    return rank.select("node", F.col("p").alias("score"))


def closure(parents: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, ancestor, dist) over (node, parent), by doubling; a cycle is an error."""
    pairs = stored(parents.where("parent IS NOT NULL").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("dist")), "pairs")
    n = pairs.count()
    for _ in range(most_rounds):
        up = pairs.select(F.col("node").alias("_m"), F.col("ancestor").alias("_a"), F.col("dist").alias("_d"))
        longer = pairs.join(up, F.col("ancestor") == F.col("_m")).select("node", F.col("_a").alias("ancestor"), (F.col("dist") + F.col("_d")).alias("dist"))
        pairs = stored(pairs.union(longer).distinct(), "pairs")
        before, n = n, pairs.count()
        if n == before:
            return pairs
    raise RuntimeError("the tree has a cycle")


def islands(df: DataFrame, keys: list[str], page: str, margin: int = 0) -> DataFrame:
    """(keys, lo, hi): contiguous ranges of pages, each page widened by a margin first."""
    wide = df.select(*keys, F.explode(F.sequence(F.greatest(F.col(page) - margin, F.lit(0)), F.col(page) + margin)).alias("p")).distinct()
    run = wide.withColumn("_r", F.col("p") - F.row_number().over(W.partitionBy(*keys).orderBy("p")))
    return run.groupBy(*keys, "_r").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).drop("_r")


def hyperedge_partners(members: DataFrame, edge: str, kind: str, node: str, pins: list[tuple[str, int]]) -> DataFrame:
    """Other members of the edges that hold every pin."""
    pin: Column = F.lit(False)
    for k, n in pins:
        pin = pin | ((F.col(kind) == k) & (F.col(node) == n))
    held = members.where(pin).groupBy(edge).agg(F.count_distinct(kind, node).alias("n")).where(F.col("n") == len(set(pins))).select(edge)
    return members.join(held, edge, "left_semi").where(~pin).select(kind, node).distinct()


def preorder(nodes: DataFrame, last_first: bool = False) -> DataFrame:
    """(node, root, depth, place) of every node of the trees (node, parent, seq), each node before its children.

    Children come in the order of seq, or the last one first. A node's path is the list of the places at which its
    ancestors stand among their siblings, so one sort over ranges of paths gives the order of whole trees of any size.
    """
    key = -F.col("seq") if last_first else F.col("seq")
    own = nodes.select("node", key.cast("long").alias("_k"))
    up = closure(nodes.select("node", "parent"))
    steps = up.join(own.select(F.col("node").alias("ancestor"), "_k"), "ancestor").groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("d"), "_k", "ancestor"))).alias("_up"))  # one entry a level
    path = F.concat(F.transform(F.coalesce("_up", F.array().cast("array<struct<d:int,_k:bigint,ancestor:bigint>>")), lambda x: x["_k"]), F.array("_k"))
    rows = own.join(steps, "node", "left").select("node", F.coalesce(F.col("_up")[0]["ancestor"], F.col("node")).alias("root"), F.coalesce(F.size("_up"), F.lit(0)).alias("depth"), path.alias("_path"))
    return ranking.positions(rows, ["root"], ["_path", "node"])[0].drop("_path")


def resolved(redirects: DataFrame) -> DataFrame:
    """(from, to) with every chain followed to its end, by doubling; of several targets of one name the smallest counts.

    A name that leads into a circle has no end and is left out. Each round follows twice as many steps as the one before,
    so there are as many rounds as the longest chain has binary digits.
    """
    step = redirects.where("from IS NOT NULL AND to IS NOT NULL AND from <> to").groupBy("from").agg(F.min("to").alias("to"))
    step = stored(step.withColumn("hops", F.lit(1).cast("long")), "redirects")
    longest, n = 1, step.count()
    while True:
        on = step.select(F.col("from").alias("_f"), F.col("to").alias("_t"), F.col("hops").alias("_h"))
        step = stored(step.join(on, F.col("to") == F.col("_f"), "left").select("from", F.coalesce("_t", "to").alias("to"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops")), "redirects")
        reached = step.agg(F.max("hops")).first()[0] or 0
        if reached == longest or reached > n:  # no chain is longer than there are names, so the rest are circles
            break
        longest = reached
    return step.join(step.select(F.col("from").alias("to")), "to", "left_anti").select("from", "to")


def views_of(titles: DataFrame, final: DataFrame, views: DataFrame) -> DataFrame:
    """(title, final, views): the views of all names that end where a title ends; an end that was never seen has 0."""
    ends = titles.join(final, F.col("title") == F.col("from"), "left").select("title", F.coalesce("to", "title").alias("final"))
    seen = views.select(F.col("title").alias("_t"), F.col("views").alias("_v"))
    totals = ends.join(seen, F.col("title") == F.col("_t")).groupBy("final").agg(F.sum("_v").alias("_n"))
    known = seen.select(F.col("_t").alias("final")).distinct().withColumn("_known", F.lit(True))
    out = ends.join(totals, "final", "left").join(known, "final", "left")
    return out.select("title", "final", F.when(F.col("_known"), F.coalesce("_n", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("views"))
