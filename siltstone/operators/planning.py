"""Plans of sub-queries as tables: the order of execution and the evidence of each step, all plans side by side.

`nodes` has (plan, node, seq, kind), `deps` (plan, node, dep, dep_seq). A step waits for all steps it names. Kahn's queue
takes the steps in waves: those of a wave follow the order in which the last step they waited for was taken, then that of
the plan. Steps that can never start (cycles, or a step that is named but missing) come last, in the order of the plan.

One round a wave works on the steps that are still waiting, of all plans at once; the number of rounds is the longest
chain. A plan is a list of steps and is ordered in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.session import stored


def execution_order(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """`nodes` with pos, the place of each step in its plan from 0."""
    keys = ["plan", "node"]
    need = deps.select(*keys, "dep").distinct()
    waiting = stored(nodes.select(*keys, "seq").join(need.select(*keys).distinct(), keys, "left_anti").withColumn("_last", F.lit(-1).cast("long")), "wave")
    placed, left, taken = [], need, None
    while True:
        # positions go on where the waves before have ended
        before = taken.groupBy("plan").agg((F.max("pos") + 1).alias("_from")) if taken is not None else None
        rank = F.row_number().over(W.partitionBy("plan").orderBy("_last", "seq")) - 1
        wave = waiting.withColumn("_r", rank)
        if before is not None:
            wave = wave.join(before, "plan", "left").withColumn("_r", F.col("_r") + F.coalesce("_from", F.lit(0)))
        wave = stored(wave.select(*keys, "seq", F.col("_r").cast("long").alias("pos")), "wave")
        if wave.isEmpty():
            break
        placed.append(wave)
        taken = reduce(DataFrame.unionByName, placed)
        done = taken.select("plan", F.col("node").alias("dep"), "pos")
        # a step starts when the last of those it waits for has been taken
        state = left.join(done, ["plan", "dep"], "left").groupBy(*keys).agg(F.max("pos").alias("_last"), F.count_if(F.col("pos").isNull()).alias("_open"))
        ready = state.where("_open = 0").select(*keys, "_last").join(taken, keys, "left_anti")
        waiting = stored(nodes.select(*keys, "seq").join(ready, keys), "wave")
        left = stored(left.join(taken.select(*keys), keys, "left_anti"), "left")
    rest = nodes.select(*keys, "seq")
    if taken is not None:
        rest = rest.join(taken.select(*keys), keys, "left_anti").join(taken.groupBy("plan").agg((F.max("pos") + 1).alias("_from")), "plan", "left")
    else:
        rest = rest.withColumn("_from", F.lit(0))
    rest = rest.withColumn("pos", (F.row_number().over(W.partitionBy("plan").orderBy("seq")) - 1 + F.coalesce("_from", F.lit(0))).cast("long")).select(*keys, "seq", "pos")
    return nodes.join((rest if taken is None else taken.unionByName(rest)).select(*keys, "pos"), keys)


def gathered(ordered: DataFrame, deps: DataFrame, hits: DataFrame) -> DataFrame:
    """(plan, node, doc, place): the evidence of each step; `ordered` has pos and kind, `hits` (plan, node, rank, doc).

    A `synthesis` step that names others inherits theirs, in the order it names them, each passage once; of those it names
    only the ones executed before it count. Any other step has its own hits.
    """
    keys = ["plan", "node"]
    naming = deps.select(*keys).distinct().withColumn("_names", F.lit(True))
    steps = ordered.join(naming, keys, "left").withColumn("_inherits", (F.col("kind") == "synthesis") & F.col("_names").isNotNull())
    at = steps.select("plan", F.col("node").alias("dep"), F.col("pos").alias("_dep_pos"), F.col("_inherits").alias("_dep_inherits"))
    inherits = steps.where("_inherits").select(*keys, "pos")
    links = stored(inherits.join(deps, keys).join(at, ["plan", "dep"]).where("_dep_pos < pos").select(*keys, "dep", "dep_seq", "_dep_inherits"), "links")
    own = hits.join(steps.where("NOT _inherits").select(*keys), keys, "left_semi").select(*keys, "doc", F.col("rank").cast("long").alias("place"))
    found, ready = [stored(own, "evidence")], inherits.select(*keys)
    waits = links.where("_dep_inherits").select(*keys, "dep")
    while not ready.isEmpty():
        now = ready.join(waits.select(*keys).distinct(), keys, "left_anti")
        so_far = reduce(DataFrame.unionByName, found).select("plan", F.col("node").alias("dep"), "doc", "place")
        first = links.join(now, keys, "left_semi").join(so_far, ["plan", "dep"]).groupBy(*keys, "doc").agg(F.min(F.struct("dep_seq", "place")).alias("_first"))
        place = F.row_number().over(W.partitionBy(*keys).orderBy("_first")).cast("long")
        found.append(stored(first.select(*keys, "doc", place.alias("place")), "evidence"))
        ready = stored(ready.join(now, keys, "left_anti"), "ready")
        waits = waits.join(ready.select("plan", F.col("node").alias("dep")), ["plan", "dep"], "left_semi").select(*keys, "dep")
    return reduce(DataFrame.unionByName, found)


def union_of(ordered: DataFrame, evidence: DataFrame) -> DataFrame:
    """(plan, doc, seen): all passages of a plan, each once, by the order in which they are first met."""
    rows = evidence.join(ordered.select("plan", "node", "pos"), ["plan", "node"])
    first = rows.groupBy("plan", "doc").agg(F.min(F.struct("pos", "place")).alias("_first"))
    return first.select("plan", "doc", F.row_number().over(W.partitionBy("plan").orderBy("_first")).alias("seen"))
