"""Histories, ledgers, task graphs and sampling, over the event log and the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.operators import ranking, retrieval, state
from siltstone.session import table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def scd2_facts(spark, sf_dir):
    out = state.scd2(_events(spark, sf_dir), ["user_id"], "event_type", ["ts", "event_id"], "ts")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("valid_from", "valid_to")})


def scd2_uniqueness(spark, sf_dir):
    live = state.scd2(_events(spark, sf_dir), ["user_id"], "event_type", ["ts", "event_id"], "ts").where("is_live")
    return live.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_live"))


def fact_lifecycle_fold(spark, sf_dir):
    a = state.actions(_events(spark, sf_dir), ["user_id"], "event_type", ["ts", "event_id"])
    return a.groupBy("user_id").agg(*[F.count_if(F.col("action") == x).alias(x) for x in ("new", "unchanged", "updated")])


def audit_replay(spark, sf_dir):
    """Log entries by what a replay does with them."""
    op = F.when(F.col("event_type").isin("purchase", "signup"), "imprint").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "skip").otherwise("unknown")
    return _events(spark, sf_dir).groupBy("user_id", op.alias("op")).agg(F.count(F.lit(1)).alias("n"))


def event_replay(spark, sf_dir):
    return state.latest(_events(spark, sf_dir), ["user_id"], F.col("event_id"), ["event_type", "value"])


def merge_runs_last_wins(spark, sf_dir):
    """The last value of each user and kind of event; errors do not overwrite."""
    e = _events(spark, sf_dir)
    out = e.groupBy("user_id").agg(*[F.max_by(F.when(F.col("event_type") == t, F.col("value")), F.when(F.col("event_type") == t, F.col("event_id"))).alias(t) for t in ("signup", "purchase", "view", "click")])
    return out


def cost_idempotent(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    first = state.idempotent(li, ["l_orderkey", "l_suppkey"], ["l_linenumber", "l_extendedprice"])
    return first.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("usd"))


def budget_abort(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return state.within_budget(li, ["l_orderkey"], "l_quantity", ["l_linenumber", "l_extendedprice"], 60.0)


def _facts(spark, sf_dir):
    e = _events(spark, sf_dir)
    g = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("visits"), F.max("ts").alias("last"), F.round(F.least(F.avg("value") / 100, F.lit(1.0)), 6).alias("confidence"))
    now = e.agg(F.max("ts")).first()[0]
    return g, F.lit(now)


def recency_decay(spark, sf_dir):
    g, now = _facts(spark, sf_dir)
    return g.select("user_id", "event_type", F.round(state.decay(F.col("last"), now), 6).alias("decay"))


def _heat(spark, sf_dir):
    g, now = _facts(spark, sf_dir)
    return g.withColumn("heat", F.round(state.heat(F.col("visits"), F.col("last"), now, F.col("confidence")), 6))


def memory_heat(spark, sf_dir):
    return _heat(spark, sf_dir).select("user_id", "event_type", "heat")


def evict_cold(spark, sf_dir):
    gone = state.evict(_heat(spark, sf_dir), "user_id", "heat", "event_type", 3, F.col("confidence") >= 0.85)
    return gone.select("user_id", "event_type", "heat")


def _nodes(spark, sf_dir):
    """Turns of a conversation as a chain of tasks; the speaker's role stands for the status."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    status = F.when(F.col("role") == "assistant", "done").when(F.col("role") == "system", "failed").otherwise("pending")
    nodes = c.groupBy("conv_id", "turn").agg(F.min(status).alias("status"))
    deps = nodes.where("turn > 0").select("conv_id", "turn", (F.col("turn") - 1).alias("dep"))
    return nodes, deps


def dag_init(spark, sf_dir):
    nodes, deps = _nodes(spark, sf_dir)
    out = nodes.join(deps.select("conv_id", "turn", F.lit(1).alias("has")), ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", F.when(F.col("has").isNull(), "ready").otherwise("pending").alias("state"))


def dag_promote(spark, sf_dir):
    nodes, deps = _nodes(spark, sf_dir)
    return state.ready_nodes(nodes, deps, "conv_id", "turn", "dep", "status").select("conv_id", "turn")


def run_closure(spark, sf_dir):
    return state.run_status(_nodes(spark, sf_dir)[0], "conv_id", "status")


def retry_state(spark, sf_dir):
    """A user's tasks are failed after three errors, else ready again."""
    e = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("attempts"))
    return e.where("event_type = 'error'").select("user_id", "attempts", F.when(F.col("attempts") >= 3, "failed").otherwise("ready").alias("state"))


def _draw(key: str):
    """A number in [0, 2^32) from an integer key."""
    return F.pmod(F.col(key) * F.lit(2654435761), F.lit(4294967296))


def stratified_split(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "event_type")
    e, sizes = ranking.positions(e.withColumn("draw", _draw("event_id")), ["event_type"], ["draw", "event_id"])
    few = F.broadcast(sizes.withColumnRenamed("event_type", "_kind"))  # one row a kind
    e = e.join(few, F.col("event_type").eqNullSafe(F.col("_kind")))
    return e.select("event_id", "event_type", F.when(F.col("place") < F.floor(F.col("n") * 0.67), "train").otherwise("eval").alias("part"))


def quota_slice(spark, sf_dir):
    return retrieval.top_k(_events(spark, sf_dir).select("event_id", "user_id", "event_type"), ["user_id", "event_type"], [F.col("event_id")], 3)


def weighted_sample(spark, sf_dir):
    """Ten customers a segment without replacement, with chances by account balance: the largest ln(u) / w win."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.greatest("c_acctbal", F.lit(0.0)).alias("w"))
    key = F.round(F.log((_draw("c_custkey") + 1) / 4294967297.0) / (F.col("w") + 1), 12)
    return retrieval.top_k(c.select("c_custkey", "c_mktsegment", key.alias("key")), ["c_mktsegment"], [F.desc("key"), F.col("c_custkey")], 10)


QUERIES = {f.__name__: f for f in (scd2_facts, scd2_uniqueness, fact_lifecycle_fold, audit_replay, event_replay, merge_runs_last_wins, cost_idempotent, budget_abort, recency_decay, memory_heat, evict_cold, dag_init, dag_promote, run_closure, retry_state, stratified_split, quota_slice, weighted_sample)}

_CHANGES = """c AS (SELECT *, LAG(event_type) OVER w AS b, ROW_NUMBER() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        h AS (SELECT user_id, event_type, ts AS valid_from, LEAD(ts) OVER w AS valid_to, ROW_NUMBER() OVER w AS version FROM c WHERE n = 1 OR b IS DISTINCT FROM event_type WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
_FACTS = """g AS (SELECT user_id, event_type, COUNT(*) AS visits, MAX(ts) AS last, ROUND(LEAST(AVG(value) / 100, 1.0), 6) AS confidence FROM events GROUP BY 1, 2),
        d AS (SELECT *, POW(0.5, (SELECT epoch_us(MAX(ts)) FROM events) / 1e6 / 1209600 - epoch_us(last) / 1e6 / 1209600) AS decay FROM g),
        t AS (SELECT *, ROUND(LN(1 + visits) + decay + confidence, 6) AS heat FROM d)"""
_NODES = """n AS (SELECT conv_id, turn, MIN(CASE role WHEN 'assistant' THEN 'done' WHEN 'system' THEN 'failed' ELSE 'pending' END) AS status FROM conversations GROUP BY 1, 2)"""

ORACLES = {
    "scd2_facts": f"""WITH {_CHANGES} SELECT user_id, event_type, strftime(valid_from, '%Y-%m-%d %H:%M:%S') AS valid_from, strftime(valid_to, '%Y-%m-%d %H:%M:%S') AS valid_to,
        valid_to IS NULL AS is_live, version FROM h""",
    "scd2_uniqueness": f"WITH {_CHANGES} SELECT user_id, COUNT(*) AS n_live FROM h WHERE valid_to IS NULL GROUP BY 1",
    "fact_lifecycle_fold": """SELECT user_id, COUNT(CASE WHEN n = 1 THEN 1 END) AS "new", COUNT(CASE WHEN n > 1 AND b IS NOT DISTINCT FROM event_type THEN 1 END) AS unchanged,
        COUNT(CASE WHEN n > 1 AND b IS DISTINCT FROM event_type THEN 1 END) AS updated
        FROM (SELECT *, LAG(event_type) OVER w AS b, ROW_NUMBER() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY 1""",
    "audit_replay": """SELECT user_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'imprint' WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'view' THEN 'skip' ELSE 'unknown' END AS op,
        COUNT(*) AS n FROM events GROUP BY 1, 2""",
    "event_replay": "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1",
    "merge_runs_last_wins": "SELECT user_id, " + ", ".join(f"arg_max(value, event_id) FILTER (event_type = '{t}') AS {t}" for t in ("signup", "purchase", "view", "click")) + " FROM events GROUP BY 1",
    "cost_idempotent": """SELECT l_orderkey, COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS usd FROM
        (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_extendedprice) AS r FROM lineitem) WHERE r = 1 GROUP BY 1""",
    "budget_abort": """SELECT l_orderkey, COUNT(*) AS ran, ROUND(SUM(l_quantity), 4) AS spent, ROUND(SUM(l_quantity), 4) > 60 AS aborted FROM
        (SELECT *, SUM(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice ROWS UNBOUNDED PRECEDING) AS s FROM lineitem) WHERE s - l_quantity <= 60 GROUP BY 1""",
    "recency_decay": f"WITH {_FACTS} SELECT user_id, event_type, ROUND(decay, 6) AS decay FROM d",
    "memory_heat": f"WITH {_FACTS} SELECT user_id, event_type, heat FROM t",
    "evict_cold": f"""WITH {_FACTS}, r AS (SELECT *, GREATEST(COUNT(*) OVER (PARTITION BY user_id) - 3, 0) AS over,
        SUM(CASE WHEN confidence >= 0.85 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY heat, event_type) AS rk FROM t)
        SELECT user_id, event_type, heat FROM r WHERE confidence < 0.85 AND rk <= over""",
    "dag_init": f"WITH {_NODES} SELECT conv_id, turn, CASE WHEN turn > 0 THEN 'pending' ELSE 'ready' END AS state FROM n",
    "dag_promote": f"""WITH {_NODES} SELECT conv_id, turn FROM n a WHERE status = 'pending' AND
        (turn <= 0 OR EXISTS (SELECT 1 FROM n b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 1 AND b.status = 'done'))""",
    "run_closure": f"""WITH {_NODES} SELECT conv_id, CASE WHEN BOOL_OR(status = 'failed') THEN 'failed' WHEN NOT BOOL_OR(status = 'pending') THEN 'done' ELSE 'running' END AS run_status,
        COUNT(*) AS n_nodes FROM n GROUP BY 1""",
    "retry_state": """SELECT user_id, COUNT(*) AS attempts, CASE WHEN COUNT(*) >= 3 THEN 'failed' ELSE 'ready' END AS state FROM events WHERE event_type = 'error' GROUP BY 1""",
    "stratified_split": """SELECT event_id, event_type, CASE WHEN r <= FLOOR(n * 0.67) THEN 'train' ELSE 'eval' END AS part FROM
        (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY (event_id * 2654435761) % 4294967296, event_id) AS r, COUNT(*) OVER (PARTITION BY event_type) AS n FROM events)""",
    "quota_slice": """SELECT event_id, user_id, event_type, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rank FROM events) WHERE rank <= 3""",
    "weighted_sample": """SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_mktsegment ORDER BY key DESC, c_custkey) AS rank FROM
        (SELECT c_custkey, c_mktsegment, ROUND(LN(((c_custkey * 2654435761) % 4294967296 + 1) / 4294967297.0) / (GREATEST(c_acctbal, 0) + 1), 12) AS key FROM customer)) WHERE rank <= 10""",
}
