"""Mutable state as folds over event logs: histories, ledgers, decay and eviction, task graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

HALF_LIFE_S = 14 * 86400


def scd2(df: DataFrame, keys: list[str], value: str, order: list[str], ts: str) -> DataFrame:
    """Slowly changing facts: one row for each change of the value, with its validity and whether it is live."""
    w = W.partitionBy(*keys).orderBy(*order)
    before = F.lag(value).over(w)
    changed = df.withColumn("_b", before).withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | ~F.col("_b").eqNullSafe(F.col(value)))
    until = F.lead(ts).over(w)
    return changed.select(*keys, value, F.col(ts).alias("valid_from"), until.alias("valid_to"), until.isNull().alias("is_live"), F.row_number().over(w).alias("version"))


def actions(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The log with what each write does: `new`, `unchanged` or `updated`."""
    w = W.partitionBy(*keys).orderBy(*order)
    kind = F.when(F.row_number().over(w) == 1, "new").when(F.lag(value).over(w).eqNullSafe(F.col(value)), "unchanged").otherwise("updated")
    return df.withColumn("action", kind)


def latest(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """Each key's columns in its last row."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_s"))
    return best.select(*keys, "_s.*")


def idempotent(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: later inserts of the same key are ignored."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def within_budget(df: DataFrame, keys: list[str], cost: str, order: list[str], ceiling: float) -> DataFrame:
    """What ran before the budget was passed: the row that passes it still counts, later ones do not run."""
    running = F.sum(cost).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    ran = df.withColumn("_sum", running).where(F.col("_sum") - F.col(cost) <= ceiling)
    return ran.groupBy(*keys).agg(F.count(F.lit(1)).alias("ran"), F.round(F.sum(cost), 4).alias("spent"), (F.round(F.sum(cost), 4) > ceiling).alias("aborted"))


def decay(ts: Column, now: Column) -> Column:
    """0.5 to the power of the age in fortnights; future times count as now."""
    age = F.greatest(F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp")), F.lit(0)) / 1e6
    return F.pow(F.lit(0.5), age / HALF_LIFE_S)


def heat(visits: Column, last: Column, now: Column, confidence: Column) -> Column:
    return F.log1p(visits) + decay(last, now) + confidence


def evict(df: DataFrame, group: str, score: str, key: str, budget: int, exempt: Column) -> DataFrame:
    """Rows that go: the coldest beyond the budget of each group, but none that is exempt."""
    w = W.partitionBy(group)
    over = F.greatest(F.count(F.lit(1)).over(w) - budget, F.lit(0))
    rank = F.sum(F.when(exempt, 0).otherwise(1)).over(w.orderBy(score, key))
    return df.select("*", over.alias("_over"), rank.alias("_rank")).where(~exempt & (F.col("_rank") <= F.col("_over"))).drop("_over", "_rank")


def ready_nodes(nodes: DataFrame, deps: DataFrame, run: str, node: str, dep: str, status: str) -> DataFrame:
    """Pending nodes whose every dependency is done become ready; a dependency outside the run never is."""
    done = nodes.where(F.col(status) == "done").select(run, F.col(node).alias(dep))
    unmet = deps.join(done, [run, dep], "left_anti").select(run, node).distinct()
    return nodes.where(F.col(status) == "pending").join(unmet, [run, node], "left_anti")


def run_status(nodes: DataFrame, run: str, status: str) -> DataFrame:
    """`failed` if any node is, `done` when nothing is left to run, else `running`."""
    live = F.col(status).isin("pending", "ready", "running")
    out = F.when(F.bool_or(F.col(status) == "failed"), "failed").when(~F.bool_or(live), "done").otherwise("running")
    return nodes.groupBy(run).agg(out.alias("run_status"), F.count(F.lit(1)).alias("n_nodes"))


def claim(tasks: DataFrame, run: str, name: str, status: str) -> DataFrame:
    """(run, name, status): the ready task with the smallest name of each run, now running."""
    return tasks.where(F.col(status) == "READY").groupBy(run).agg(F.min(name).alias(name)).select(run, name, F.lit("RUNNING").alias(status))


def recover(tasks: DataFrame, status: str) -> DataFrame:
    """Running tasks of a worker that is gone are ready again."""
    return tasks.withColumn(status, F.when(F.col(status) == "RUNNING", "READY").otherwise(F.col(status)))


def touch(facts: DataFrame, recalls: DataFrame, key: str, counter: str, at: str) -> DataFrame:
    """Facts with their recalls counted in, and the time of the last one."""
    seen = recalls.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max(at).alias(at))
    return facts.join(seen, key, "left").withColumn(counter, F.col(counter) + F.coalesce("_n", F.lit(0))).drop("_n")


def stamped(rows: DataFrame, late: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows with a late value where there is one, else their own."""
    new = late.groupBy(*keys).agg(F.max(column).alias("_new"))
    return rows.join(new, keys, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def action(old: Column, new: Column) -> Column:
    """What a new value does to the last one: add, delete, no-op, supersede, update or coexist."""
    return F.when(old.isNull(), "add").when(new.isNull(), "delete").when(new == old, "no-op").when(new >= old * 1.5, "supersede").when(new > old, "update").otherwise("coexist")


def superseded(facts: DataFrame, keys: list[str], order: str, action: str) -> DataFrame:
    """Facts with a pointer to the next one about the same keys, where that supersedes or deletes them."""
    w = W.partitionBy(*keys).orderBy(order)
    return facts.withColumn("superseded_by", F.when(F.lead(action).over(w).isin("supersede", "delete"), F.lead(order).over(w)))
