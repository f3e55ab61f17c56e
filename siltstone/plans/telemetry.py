"""Queries over the telemetry table (`events` as spans) and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.operators import drift, rollup
from siltstone.session import table


def spans(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("ts", "event_type", F.lit("agent").alias("role"), (F.col("value") / 997).alias("cost_usd"))


def daily_cost_rollup(spark, sf_dir):
    out = rollup.daily_cost(spans(spark, sf_dir), "ts", ["role", "event_type"], "cost_usd")
    return out.withColumns({"total_usd": F.round("total_usd", 4), "day": F.date_format("day", "yyyy-MM-dd")})


def latency_percentiles(spark, sf_dir):
    out = rollup.trailing_percentiles(table(spark, sf_dir, "events").select("ts", "event_type", "value"), "ts", "event_type", "value", 24)
    return out.select("event_type", *[F.round(c, 4).alias(c) for c in ("p50", "p95", "p99", "worst")], "n")


def nearest_rank_percentiles(spark, sf_dir):
    return rollup.nearest_rank(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_type", "value", "event_id")


def run_summary(spark, sf_dir):
    return rollup.run_summary(table(spark, sf_dir, "events"), "user_id", "value", F.col("event_type") == "error")


def cost_report(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_calls"), F.sum("l_extendedprice").alias("usd"), F.sum("l_quantity").alias("qty"))
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    out = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select("o_orderkey", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.round(F.coalesce("usd", F.lit(0.0)), 2).alias("usd"), F.coalesce("qty", F.lit(0.0)).alias("qty"))


TYPES = ["signup", "purchase", "error", "view", "click"]


def accuracy_matrix(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    axis = F.date_format("ts", "yyyy-MM-dd").alias("axis")
    # a value of zero or less counts as not scored yet
    return rollup.matrix(e.select(axis, "event_type", "value"), "axis", "event_type", TYPES, F.when(F.col("value") > 0, (F.col("value") > 50).cast("double")))


def rollup_summary(spark, sf_dir):
    return rollup.overall_and_by(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", F.col("o_orderstatus") == "F")


def majority_vote(spark, sf_dir):
    return rollup.majority(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


def token_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type")
    return e.groupBy("user_id").agg(F.sum("k").alias("tokens"), F.bool_or(F.col("event_type") == "error").alias("estimated"))


def predicate_discovery(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat_ws("_", "event_type", F.pmod("user_id", F.lit(7))).alias("predicate"), "event_id")
    return rollup.frequent_with_sample(e, "predicate", F.col("event_id"), 5)


def group_sources(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return rollup.source_sets(li.select("l_suppkey", "l_returnflag", "l_orderkey"), ["l_suppkey", "l_returnflag"], "l_orderkey")


def drift_psi(spark, sf_dir):
    rows = drift.windows(table(spark, sf_dir, "events").where("value IS NOT NULL").select("ts", "event_type", "value"), "ts", ["event_type"], "1 DAY", "7 DAYS")
    return drift.psi(rows, ["event_type"], "value")


def retrain_trigger(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("mean"))
    return drift.consecutive(daily, ["event_type"], "day", F.col("mean") > 49, 3)


def regression_gate(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg("value"), 6).alias("metric"))
    before = F.lag("metric").over(W.partitionBy("event_type").orderBy("day"))
    return daily.select("event_type", "day", "metric", before.alias("baseline"), drift.gate(F.col("metric"), before, 0.5).alias("code"))


def correlation(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    ok = (F.count(F.lit(1)) >= 2) & (F.stddev_pop("value") > 0) & (F.stddev_pop("k") > 0)
    return e.groupBy("event_type").agg(F.round(F.when(ok, F.corr("value", "k")), 6).alias("r"))


RATES = [("R", 0.5, 2.0), ("A", 0.25, 1.0)]


def rate_card_cost(spark, sf_dir):
    rates = spark.createDataFrame(RATES, "model string, rate_in double, rate_out double")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice")
    out = li.join(F.broadcast(rates), F.col("l_returnflag") == F.col("model"), "left")  # a rate card is a fixed, small list
    usd = F.col("l_quantity") / 1e6 * F.coalesce("rate_in", F.lit(0.0)) + F.col("l_extendedprice") / 1e6 * F.coalesce("rate_out", F.lit(0.0))
    return out.select("l_orderkey", "l_linenumber", F.round(usd, 9).alias("usd"))


def idempotency_key(spark, sf_dir):
    key = F.substring(F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.col("event_id").cast("string")), 256), 1, 16)
    return table(spark, sf_dir, "events").select("event_id", key.alias("key"))


def noise_schedule(spark, sf_dir):
    """Running products of 1 - beta by step, as exponentials of running log sums, over the steps of each conversation."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    beta = 0.0001 + F.col("turn") * 0.001
    s = F.sum(F.log(1 - beta)).over(W.partitionBy("conv_id").orderBy("turn"))
    return c.select("conv_id", "turn", F.round(F.exp(s), 9).alias("alpha_bar"))


QUERIES = {f.__name__: f for f in (daily_cost_rollup, latency_percentiles, nearest_rank_percentiles, run_summary, cost_report, accuracy_matrix, rollup_summary, majority_vote, token_totals, predicate_discovery, group_sources, drift_psi, retrain_trigger, regression_gate, correlation, rate_card_cost, idempotency_key, noise_schedule)}

_CELLS = ", ".join(f"""ROUND(AVG(CASE WHEN event_type = '{t}' AND value > 0 THEN CAST(value > 50 AS INT) END), 6) AS {t}_avg,
    COUNT(CASE WHEN event_type = '{t}' AND value > 0 THEN 1 END) AS {t}_n,
    COUNT(CASE WHEN event_type = '{t}' AND NOT COALESCE(value > 0, FALSE) THEN 1 END) AS {t}_pending""" for t in TYPES)  # fmt: skip

ORACLES = {
    "daily_cost_rollup": """
        SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, 'agent' AS role, event_type,
               COUNT(*) AS n_calls, ROUND(SUM(value / 997), 4) AS total_usd,
               ROUND(SUM(value / 997) / NULLIF(COUNT(*), 0), 4) AS avg_usd
        FROM events GROUP BY 1, 2, 3""",
    "latency_percentiles": """
        SELECT event_type, ROUND(quantile_cont(value, 0.5), 4) AS p50, ROUND(quantile_cont(value, 0.95), 4) AS p95,
               ROUND(quantile_cont(value, 0.99), 4) AS p99, ROUND(MAX(value), 4) AS worst, COUNT(*) AS n
        FROM events WHERE ts >= (SELECT MAX(ts) FROM events) - INTERVAL 24 HOURS GROUP BY event_type""",
    "nearest_rank_percentiles": """
        SELECT event_type, l[CAST(n // 2 AS BIGINT) + 1] AS p50, l[CAST(LEAST(FLOOR(n * 0.95), n - 1) AS BIGINT) + 1] AS p95, n
        FROM (SELECT event_type, list(value ORDER BY value) AS l, COUNT(value) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type)""",
    "run_summary": """
        SELECT user_id, COUNT(*) AS n_steps, CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n_failed,
               ROUND(AVG(value), 6) AS avg_ms, MAX(value) AS max_ms FROM events GROUP BY user_id""",
    "cost_report": """
        SELECT o_orderkey, COUNT(l_orderkey) AS n_calls, ROUND(COALESCE(SUM(l_extendedprice), 0), 2) AS usd, COALESCE(SUM(l_quantity), 0) AS qty
        FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
    "accuracy_matrix": f"SELECT strftime(ts, '%Y-%m-%d') AS axis, {_CELLS} FROM events GROUP BY 1",
    "rollup_summary": """
        SELECT CASE WHEN GROUPING(o_orderpriority) = 1 THEN 'ALL' ELSE o_orderpriority END AS group_name, ROUND(AVG(o_totalprice), 4) AS mean,
               COUNT(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_exact, ROUND(quantile_cont(o_totalprice, 0.5), 4) AS median, COUNT(*) AS n
        FROM orders GROUP BY ROLLUP (o_orderpriority)""",
    "majority_vote": """
        WITH c AS (SELECT user_id, event_type, COUNT(*) AS n, MIN(event_id) AS f FROM events GROUP BY 1, 2),
        r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r, SUM(n) OVER (PARTITION BY user_id) AS a FROM c)
        SELECT user_id, event_type AS winner, n, ROUND(n / a, 6) AS confidence FROM r WHERE r = 1""",
    "token_totals": """
        SELECT user_id, CAST(SUM(CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT)) AS BIGINT) AS tokens, BOOL_OR(event_type = 'error') AS estimated
        FROM events GROUP BY user_id""",
    "predicate_discovery": """
        SELECT event_type || '_' || CAST(user_id % 7 AS VARCHAR) AS predicate, COUNT(*) AS n, MIN(event_id) AS sample
        FROM events GROUP BY 1 HAVING COUNT(*) >= 5""",
    "group_sources": """
        SELECT l_suppkey, l_returnflag, array_to_string(list_slice(list(CAST(l_orderkey AS VARCHAR) ORDER BY l_orderkey), 1, 4), ',') AS sources, COUNT(*) AS n_sources
        FROM (SELECT DISTINCT l_suppkey, l_returnflag, l_orderkey FROM lineitem) GROUP BY 1, 2""",
    "drift_psi": """
        WITH m AS (SELECT event_type, MAX(ts) AS t FROM events WHERE value IS NOT NULL GROUP BY 1),
        w AS (SELECT event_type, value, CASE WHEN ts >= t - INTERVAL 1 DAY THEN 'cur' ELSE 'ref' END AS part
              FROM events JOIN m USING (event_type) WHERE value IS NOT NULL AND ts >= t - INTERVAL 8 DAYS),
        e AS (SELECT event_type, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM w WHERE part = 'ref' GROUP BY 1),
        b AS (SELECT event_type, part, len([x FOR x IN edges IF value >= x]) AS bin FROM w JOIN e USING (event_type)),
        s AS (SELECT event_type, CAST(unnest(range(0, 10)) AS BIGINT) AS bin FROM e),
        c AS (SELECT s.event_type, s.bin, COUNT(CASE WHEN part = 'cur' THEN 1 END) AS c, COUNT(CASE WHEN part = 'ref' THEN 1 END) AS r
              FROM s LEFT JOIN b ON s.event_type = b.event_type AND s.bin = b.bin GROUP BY 1, 2),
        n AS (SELECT *, SUM(c) OVER (PARTITION BY event_type) AS nc, SUM(r) OVER (PARTITION BY event_type) AS nr FROM c),
        q AS (SELECT event_type, (r + 1e-6) / (nr + 1e-5) AS p, (c + 1e-6) / (nc + 1e-5) AS q, nc, nr FROM n),
        o AS (SELECT event_type, SUM((q - p) * LN(q / p)) AS raw, CAST(MAX(nc) AS BIGINT) AS nc, CAST(MAX(nr) AS BIGINT) AS nr FROM q GROUP BY 1)
        SELECT event_type, CASE WHEN nc >= 50 AND nr >= 50 THEN ROUND(raw, 4) END AS psi, nc AS n_current, nr AS n_reference,
               CASE WHEN nc < 50 OR nr < 50 THEN 'insufficient' WHEN raw > 0.25 THEN 'significant' WHEN raw > 0.1 THEN 'moderate' ELSE 'stable' END AS verdict FROM o""",
    "retrain_trigger": """
        WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, AVG(value) AS mean FROM events GROUP BY 1, 2),
        r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY day DESC) AS r FROM d)
        SELECT event_type, COUNT(*) = 3 AND BOOL_AND(mean > 49) AS trigger FROM r WHERE r <= 3 GROUP BY 1""",
    "regression_gate": """
        WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, ROUND(AVG(value), 6) AS metric FROM events GROUP BY 1, 2),
        b AS (SELECT *, LAG(metric) OVER (PARTITION BY event_type ORDER BY day) AS baseline FROM d)
        SELECT *, CASE WHEN metric IS NULL OR baseline IS NULL THEN 2 WHEN metric < baseline - 0.5 THEN 1 ELSE 0 END AS code FROM b""",
    "correlation": """
        SELECT event_type, ROUND(CASE WHEN COUNT(*) >= 2 AND STDDEV_POP(value) > 0 AND STDDEV_POP(k) > 0 THEN CORR(value, k) END, 6) AS r
        FROM (SELECT event_type, value, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS DOUBLE) AS k FROM events) GROUP BY 1""",
    "rate_card_cost": """
        WITH c(model, rate_in, rate_out) AS (VALUES ('R', 0.5, 2.0), ('A', 0.25, 1.0))
        SELECT l_orderkey, l_linenumber, ROUND(l_quantity / 1e6 * COALESCE(CAST(rate_in AS DOUBLE), 0) + l_extendedprice / 1e6 * COALESCE(CAST(rate_out AS DOUBLE), 0), 9) AS usd
        FROM lineitem LEFT JOIN c ON l_returnflag = model""",
    "idempotency_key": """
        SELECT event_id, substr(sha256(CAST(user_id AS VARCHAR) || '|' || event_type || '|' || CAST(event_id AS VARCHAR)), 1, 16) AS key FROM events""",
    "noise_schedule": """
        SELECT conv_id, turn, ROUND(EXP(SUM(LN(1 - (0.0001 + turn * 0.001))) OVER (PARTITION BY conv_id ORDER BY turn)), 9) AS alpha_bar
        FROM (SELECT DISTINCT conv_id, turn FROM conversations)""",
}
