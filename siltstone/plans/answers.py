"""Query strings, lenient parsing, grading, task states, memory upkeep and filtered recall over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.functions.text import words
from siltstone.operators import answers, retrieval, state
from siltstone.plans import forms
from siltstone.session import table


def lucene_queries(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(answers.seeds(t), "|").alias("seeds"), F.array_join(answers.query_tokens(t), "|").alias("tokens"), answers.all_query(t).alias("all_of"), answers.any_query(t).alias("any_of"))


def question_shapes(spark, sf_dir):
    t = F.col("text")
    return forms.turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", answers.is_synthesis(t).alias("synthesis"), answers.short_lookup(t).alias("route"))


def answer_grades(spark, sf_dir):
    """Replies made of `part`: a first and a last answer, the last one formatted as money or a share."""
    size = F.col("p_size").cast("string")
    last = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("$"), size, F.lit(".00"))).when(F.col("p_partkey") % 3 == 1, F.concat(size, F.lit("%."))).otherwise(F.lit("unknown"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat(F.lit("so ANSWER: 1,0"), size, F.lit(".\nthen Answer: "), last).alias("reply"))
    r = F.col("reply")
    return p.select("p_partkey", answers.answer_of(r).alias("first"), answers.grade_last(r, F.col("p_size").cast("string")).alias("exact"), answers.has_number(r, F.col("p_size").cast("double")).alias("near"))


def _raw_json(spark, sf_dir):
    k = F.col("p_partkey") % 4
    raw = (
        F.when(k == 0, F.concat(F.lit('```json\n["'), F.col("p_brand"), F.lit('", " ", " x "]\n```')))
        .when(k == 1, F.concat(F.lit('Facts: [{"key": "brand", "value": "'), F.col("p_brand"), F.lit('"}, "y"] done')))
        .when(k == 2, F.lit("nothing [here"))
        .otherwise(F.concat(F.lit('[{"size": "'), F.col("p_size"), F.lit('"}, {"b": "2"}]')))
    )
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))


def json_arrays(spark, sf_dir):
    r = _raw_json(spark, sf_dir)
    return r.select("p_partkey", F.size(answers.json_items(F.col("raw"))).alias("n"), F.size(answers.json_objects(F.col("raw"))).alias("n_objects"))


def json_coercion(spark, sf_dir):
    r = _raw_json(spark, sf_dir).select("p_partkey", F.posexplode(answers.json_items(F.col("raw"))).alias("ix", "item"))
    return r.select("p_partkey", "ix", answers.coerced(F.col("item")).alias("c")).select("p_partkey", "ix", "c.key", "c.value")


def plan_lines(spark, sf_dir):
    """Plans of two steps, the second of which refers to the first."""
    text = F.concat(F.lit("Plan:\n#E1 = size["), F.col("p_partkey"), F.lit(']\n#E2 = scale[{"a": "#E1", "b": "x #E1"}]\nend'))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(answers.plan_steps(text)).alias("s"))
    args = answers.substituted(F.col("s.args"), F.create_map(F.lit("#E1"), F.col("p_size").cast("string")))
    return p.select("p_partkey", "s.name", "s.tool", args.alias("args"))


def known_items(spark, sf_dir):
    """Exact and semantic queries for the parts: the title tail, and the first sentence of a body with a link."""
    title = F.concat(F.lit("Parts > "), F.col("p_name"))
    body = F.concat(F.lit("# Head\nThe [[parts/"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("-")), F.lit("]] comes as "), F.col("p_name"), F.lit(" in boxes. More text."))
    p = table(spark, sf_dir, "part").select("p_partkey", answers.title_tail(title, F.lit("none")).alias("exact"), answers.semantic_query(F.col("p_name"), body).alias("semantic"))
    return p.select("p_partkey", F.posexplode(F.array("exact", "semantic")).alias("kind", "query")).where(F.col("query").isNotNull())


def scroll_entries(spark, sf_dir):
    mark = F.when(F.col("turn") % 3 == 0, "  · [journal] ").when(F.col("turn") % 3 == 1, "· [completed] ").otherwise("owner: ")
    text = F.concat(F.lit("QUEST\n"), mark, F.col("role"), F.lit(" wrote\n  notes: 1\n"), mark, F.lit("end"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answers.kept_entries(text).alias("entries"))


def session_order(spark, sf_dir):
    """Orders of a customer as sessions, chronologically, those with a date that cannot be read last."""
    day = F.date_format("o_orderdate", "yyyy/MM/dd")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(day, F.lit(" (Mon) 17:50"))).when(F.col("o_orderkey") % 3 == 1, day).otherwise(F.lit("some day"))
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", answers.session_time(text).alias("at"), answers.session_index(F.concat(F.lit("q-sess"), F.col("o_orderkey"))).alias("recency"))
    return o.withColumn("place", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.asc_nulls_last("at"), "o_orderkey"))).select("o_custkey", "o_orderkey", F.date_format("at", "yyyy-MM-dd HH:mm").alias("held_at"), "recency", "place")


def labels_by_flags(spark, sf_dir):
    k = F.col("p_partkey")
    flags = [(k % n) == 0 for n in (13, 7, 5, 3)]
    tiers = ["MFGR#1", "MFGR#2", "MFGR#3"]
    pick = lambda x: F.element_at(F.array(*map(F.lit, tiers)), (x % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", answers.testability(*flags).alias("testability"), answers.heavier(pick(k), pick(F.col("p_size")), tiers).alias("tier"), F.round(answers.kv_cache_gb(F.col("p_size"), F.lit(32), F.lit(128), k), 9).alias("kv_gb"))


def throughput_regime(spark, sf_dir):
    """Lines of an order as measurements: quantity as batch size, price as throughput."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_quantity", "l_extendedprice")).alias("a"), F.max(F.struct("l_linenumber", "l_quantity", "l_extendedprice")).alias("z"), F.count(F.lit(1)).alias("n"))
    return li.select("l_orderkey", answers.regime(F.col("a.l_quantity"), F.col("a.l_extendedprice"), F.col("z.l_quantity"), F.col("z.l_extendedprice"), F.col("n")).alias("regime"))


def forward_noise(spark, sf_dir):
    """Vectors with the reversed vector as noise, at a schedule's step by id."""
    a = 1 - (F.col("vec_id") % 100) / 100
    x = F.transform("embedding", lambda v: v.cast("double"))
    out = answers.diffused(x, F.reverse(x), a)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(out, F.lit(0.0), lambda s, v: s + v), 5).alias("total"), F.round(out[0], 5).alias("first"))


def _tasks(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "READY").when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("DONE")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("name"), status.alias("status"))


def claim_ready(spark, sf_dir):
    """The ready task with the smallest name of each run becomes running."""
    return state.claim(_tasks(spark, sf_dir), "run", "name", "status")


def recover_running(spark, sf_dir):
    return state.recover(_tasks(spark, sf_dir), "status").groupBy("run", "status").agg(F.count(F.lit(1)).alias("n"))


def recall_counters(spark, sf_dir):
    """Facts (user, kind) with the recalls that views and clicks stand for added, and the time of the last one."""
    e = table(spark, sf_dir, "events")
    facts = e.groupBy("user_id").agg(F.min("event_id").alias("born"), F.count(F.lit(1)).alias("visits"))
    recalls = e.where("event_type IN ('view', 'click')").select("user_id", F.col("event_id").alias("at"))
    return state.touch(facts, recalls, "user_id", "visits", "at")


def late_signals(spark, sf_dir):
    """Steps of a user with a later signal stamped on them; a signal does not overwrite one with nothing."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    late = e.where("event_type = 'purchase'").select((F.col("event_id") - 1).alias("event_id"), F.lit("liked").alias("signal"))
    base = e.select("event_id", F.when(F.col("event_id") % 5 == 0, "seen").alias("signal"))
    return state.stamped(base, late, ["event_id"], "signal")


def fact_actions(spark, sf_dir):
    """What a new fact does to the facts about its user: by the last earlier value of the same kind.

    none before: add; the same value: no-op; an error: delete; larger by half or more: supersede; larger: update; else
    coexist. Superseded and deleted facts get a pointer to the new one.
    """
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.round("value", 2).alias("value"))
    w = W.partitionBy("user_id", "event_type").orderBy("event_id")
    old, new = F.lag("value").over(w), F.col("value")
    return state.superseded(e.withColumn("action", state.action(old, new)), ["user_id", "event_type"], "event_id", "action").select("event_id", "action", "superseded_by")


def drop_reasons(spark, sf_dir):
    """Counts of kept and dropped events by the first filter that each fails."""
    reason = F.when(~F.col("event_type").isin("view", "click", "purchase"), "type").when(F.col("user_id") % 10 == 0, "self_caused").when(F.coalesce("value", F.lit(0.0)) < 10, "confidence").otherwise("kept")
    return table(spark, sf_dir, "events").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def leak_rates(spark, sf_dir):
    """Kept texts that hold a marker of their environment, over repeated runs of an arm: the languages of a source."""
    d = forms.passages(table(spark, sf_dir, "documents"), "source", "lang").select("source", "lang", answers.from_environment(F.col("text")).alias("leaked"))
    runs = d.groupBy("source", "lang").agg(F.count_if("leaked").alias("leaked"), F.count_if(~F.col("leaked")).alias("kept"))
    return runs.groupBy("source").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("leaked") > 0).alias("runs_with_leak"), F.sum("leaked").alias("leaked"), F.round(F.avg("kept"), 3).alias("kept_a_run"))


def typed_recall(spark, sf_dir):
    """The three nearest vectors of a permitted label that nothing supersedes, for each query, then those above a score.

    Labels 0 to 4 are permitted, vectors whose id is divisible by 7 are superseded; nine are fetched, confidence (id mod
    10 in tenths, 0 counting as 1) is at least 0.3. The filters stand before the search, so that the join scores only
    what may be returned; the queries are all ids divisible by 20, in blocks of bounded size.
    """
    v = table(spark, sf_dir, "embeddings")
    rows = v.where("label BETWEEN 0 AND 4 AND vec_id % 7 <> 0")
    scored = retrieval.cosine_top_k(rows, v.where("vec_id % 20 = 0"), "vec_id", "embedding", 9).drop("rank")
    return retrieval.filtered_top_k(scored, "query_id", "vec_id", 3, F.coalesce(F.nullif(F.col("vec_id") % 10, F.lit(0)), F.lit(10)) / 10 >= 0.3, 0.05)


def recall_ranking(spark, sf_dir):
    """Documents for an item by BM25, recency and confidence multiplied: age is the distance to the largest id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = retrieval.bm25(d, table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("q")), "doc_id", "item_id", words("text"), words("q"), 50)
    newest = d.agg(F.max("doc_id")).first()[0] or 0
    score = F.col("score") * F.pow(F.lit(0.5), (newest - F.col("doc_id")) / 1000.0) * (1 - (F.col("doc_id") % 5) / 10)
    return retrieval.top_k(found.select("item_id", "doc_id", F.round(score, 6).alias("score")), ["item_id"], [F.desc("score"), F.col("doc_id")], 5)


QUERIES = {f.__name__: f for f in (lucene_queries, question_shapes, answer_grades, json_arrays, json_coercion, plan_lines, known_items, scroll_entries, session_order, labels_by_flags, throughput_regime, forward_noise, claim_ready, recover_running, recall_counters, late_signals, fact_actions, drop_reasons, leak_rates, typed_recall, recall_ranking)}


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_RES = _list([answers.RESERVED])
_TOK = lambda t: f"[x FOR x IN regexp_split_to_array(lower(regexp_replace({t}, {_RES}, ' ', 'g')), '\\s+') IF length(x) >= 3]"
_CAPS = "[x FOR x IN regexp_split_to_array(text, '\\s+') IF regexp_matches(x, '^[A-Z]')]"
_ANY = _TOK(f"CASE WHEN len({_CAPS}) > 0 THEN array_to_string({_CAPS}, ' ') ELSE text END")
_NUM = lambda t: f"trim(regexp_replace(regexp_replace(trim({t}), '^\\.+|\\.+$', '', 'g'), '[$,%]', '', 'g'))"
_NORM = lambda t: f"lower(CASE WHEN regexp_full_match({_NUM(t)}, '-?[0-9]+\\.0+') THEN regexp_replace({_NUM(t)}, '\\.0+$', '') ELSE {_NUM(t)} END)"
_W = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_UNIT = "[CAST(x AS DOUBLE) / sqrt(list_sum([CAST(y AS DOUBLE) * CAST(y AS DOUBLE) FOR y IN embedding])) FOR x IN embedding]"
# letters with accents are part of a word in one engine only, so they become a sign that is part of a word in both
_PLAIN = "regexp_replace(text, '[À-ÖØ-öø-ÿ]', '_', 'g')"

# what stands between the outermost brackets, if it is JSON
_RAW_SQL = """rw AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '```json' || chr(10) || '["' || p_brand || '", " ", " x "]' || chr(10) || '```' WHEN 1 THEN 'Facts: [{"key": "brand", "value": "' || p_brand || '"}, "y"] done'
            WHEN 2 THEN 'nothing [here' ELSE '[{"size": "' || p_size || '"}, {"b": "2"}]' END AS raw FROM part),
        ar AS (SELECT p_partkey, regexp_extract(raw, '\\[[\\s\\S]*\\]') AS a FROM rw),
        it AS (SELECT p_partkey, item, i, item IS NOT NULL AND (json_type(item) <> 'VARCHAR' OR trim(json_extract_string(item, '$')) <> '') AS keep FROM ar LEFT JOIN LATERAL (SELECT unnest(CASE WHEN json_valid(a) AND a <> '' THEN CAST(a AS JSON[]) END) AS item, unnest(range(CASE WHEN json_valid(a) AND a <> '' THEN CAST(json_array_length(a) AS BIGINT) END)) AS i) ON TRUE)"""

ORACLES = {
    "lucene_queries": f"""SELECT item_id, array_to_string(list_slice([s FOR s IN regexp_extract_all({_PLAIN}, {_list([answers.PROPER])}) IF s NOT IN ({_list(answers.ASKING)})], 1, 5), '|') AS seeds, array_to_string({_TOK('text')}, '|') AS tokens,
        CASE len({_TOK('text')}) WHEN 0 THEN trim(text) WHEN 1 THEN {_TOK('text')}[1] ELSE '+' || array_to_string({_TOK('text')}, ' +') END AS all_of, CASE WHEN len({_ANY}) > 0 THEN array_to_string({_ANY}, ' OR ') ELSE trim(text) END AS any_of FROM benchmark""",
    "question_shapes": f"""SELECT conv_id, turn, {" OR ".join(f"regexp_matches(lower(trim(text)), {_list([p])})" for p in answers.SYNTHESIS)} AS synthesis,
        CASE WHEN len([w FOR w IN regexp_extract_all({_PLAIN}, {_list([answers.NAME])}) IF w NOT IN ({_list(answers.NO_NAMES)})]) >= 2 AND len(regexp_split_to_array(text, '\\s+')) <= 9 THEN 'keyword' ELSE 'hybrid' END AS route FROM {forms.TURNS}""",
    "answer_grades": f"""SELECT p_partkey, '1,0' || p_size AS first, {_NORM('last')} = CAST(p_size AS VARCHAR) AS exact, p_size = 100 + 0 * p_size OR regexp_matches(last, '[0-9]') AS near
        FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN '$' || p_size || '.00' WHEN 1 THEN p_size || '%.' ELSE 'unknown' END AS last FROM part)""",
    "json_arrays": f"""WITH {_RAW_SQL} SELECT p_partkey, CAST(COUNT(item) FILTER (keep) AS INT) AS n, CAST(COUNT(item) FILTER (json_type(item) = 'OBJECT') AS INT) AS n_objects FROM it GROUP BY 1""",
    "json_coercion": f"""WITH {_RAW_SQL}, k AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS INT) AS ix FROM it WHERE keep)
        SELECT p_partkey, ix, CASE WHEN json_type(item) = 'OBJECT' THEN COALESCE(json_extract_string(item, '$.key'), json_keys(item)[1]) END AS key,
        CASE WHEN json_type(item) = 'OBJECT' THEN COALESCE(json_extract_string(item, '$.value'), json_extract_string(item, '$.' || json_keys(item)[1])) ELSE trim(json_extract_string(item, '$')) END AS value FROM k""",
    "plan_lines": """WITH l AS (SELECT p_partkey, p_size, unnest(string_split('Plan:' || chr(10) || '#E1 = size[' || p_partkey || ']' || chr(10) || '#E2 = scale[{"a": "#E1", "b": "x #E1"}]' || chr(10) || 'end', chr(10))) AS line FROM part),
        s AS (SELECT p_partkey, p_size, regexp_extract(line, '^(#E[0-9]+) *= *([A-Za-z_]+)\\[(.*)\\]', ['name', 'tool', 'args']) AS x FROM l)
        SELECT p_partkey, x.name AS name, x.tool AS tool, replace(replace(x.args, '"#E1"', CAST(p_size AS VARCHAR)), '#E1', CAST(p_size AS VARCHAR)) AS args FROM s WHERE x.name <> ''""",
    "known_items": """WITH b AS (SELECT *, '# Head' || chr(10) || 'The [[parts/' || replace(lower(p_type), ' ', '-') || ']] comes as ' || p_name || ' in boxes. More text.' AS body FROM part),
        c AS (SELECT *, regexp_extract(trim(regexp_replace(regexp_replace(replace(body, '-', ' '), '^#[^\\n]*\\n', ''), '\\[\\[[^\\]/]*/([^\\]]*)\\]\\]', '\\1', 'g')), '^[^.!?]*[.!?]') AS sentence FROM b),
        t AS (SELECT p_partkey, p_name, regexp_extract_all(lower(sentence), '[a-z0-9]+') AS w, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS own FROM c),
        k AS (SELECT *, [x FOR x IN w IF length(x) > 2 AND NOT list_contains(own, x)] AS kept FROM t)
        SELECT p_partkey, 0 AS kind, trim(p_name) AS query FROM k UNION ALL SELECT p_partkey, 1, array_to_string(kept, ' ') FROM k WHERE len(kept) >= 3""",
    "scroll_entries": """WITH t AS (SELECT conv_id, turn, role, 'QUEST' || chr(10) || m || role || ' wrote' || chr(10) || '  notes: 1' || chr(10) || m || 'end' AS txt FROM (SELECT *, CASE turn % 3 WHEN 0 THEN '  · [journal] ' WHEN 1 THEN '· [completed] ' ELSE 'owner: ' END AS m FROM conversations)),
        l AS (SELECT conv_id, turn, role, txt, [regexp_replace(x, '^\\s*· \\[(journal|completed)\\]\\s*', '') FOR x IN string_split(txt, chr(10)) IF regexp_matches(x, '^\\s*· \\[(journal|completed)\\]')] AS kept FROM t)
        SELECT conv_id, turn, CASE WHEN len(kept) > 0 THEN array_to_string(kept, ' ') ELSE txt END AS entries FROM l""",
    "session_order": """SELECT o_custkey, o_orderkey, strftime(t, '%Y-%m-%d %H:%M') AS held_at, CAST(o_orderkey AS INT) AS recency, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY t NULLS LAST, o_orderkey) AS INT) AS place
        FROM (SELECT *, COALESCE(try_strptime(d, '%Y/%m/%d %H:%M'), try_strptime(d, '%Y/%m/%d')) AS t FROM (SELECT *, trim(regexp_replace(regexp_replace(txt, '\\([^)]*\\)', '', 'g'), ' +', ' ', 'g')) AS d FROM
        (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN strftime(CAST(o_orderdate AS TIMESTAMP), '%Y/%m/%d') || ' (Mon) 17:50' WHEN 1 THEN strftime(CAST(o_orderdate AS TIMESTAMP), '%Y/%m/%d') ELSE 'some day' END AS txt FROM orders)))""",
    "labels_by_flags": """SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'escalate' WHEN p_partkey % 7 = 0 THEN 'property_test' WHEN p_partkey % 5 = 0 THEN 'fixture_required' WHEN p_partkey % 3 = 0 THEN 'mock_required' ELSE 'pure_stateless' END AS testability,
        'MFGR#' || (GREATEST(p_partkey % 3, p_size % 3) + 1) AS tier, ROUND(2.0 * p_size * 32 * 128 * p_partkey * 2 / 1e9, 9) AS kv_gb FROM part""",
    "throughput_regime": """WITH g AS (SELECT l_orderkey, arg_min(l_quantity, k) AS q1, arg_min(l_extendedprice, k) AS r1, arg_max(l_quantity, k) AS q2, arg_max(l_extendedprice, k) AS r2, COUNT(*) AS n FROM (SELECT *, {'a': l_linenumber, 'b': l_quantity, 'c': l_extendedprice} AS k FROM lineitem) GROUP BY 1)
        SELECT l_orderkey, CASE WHEN n < 2 THEN 'insufficient_data' WHEN (r2 / r1) / (q2 / q1) > 0.8 THEN 'compute-bound' WHEN (r2 / r1) / (q2 / q1) < 0.4 THEN 'memory-bound' ELSE 'mixed' END AS regime FROM g""",
    "forward_noise": """SELECT vec_id, ROUND(list_sum(o), 5) AS total, ROUND(o[1], 5) AS first FROM (SELECT vec_id, [sqrt(1 - (vec_id % 100) / 100) * CAST(embedding[i] AS DOUBLE) + sqrt((vec_id % 100) / 100) * CAST(embedding[len(embedding) + 1 - i] AS DOUBLE) FOR i IN range(1, len(embedding) + 1)] AS o FROM embeddings)""",
    "claim_ready": "SELECT o_custkey AS run, MIN(o_orderkey) AS name, 'RUNNING' AS status FROM orders WHERE o_orderstatus = 'O' GROUP BY 1",
    "recover_running": "SELECT o_custkey AS run, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'READY' ELSE 'DONE' END AS status, COUNT(*) AS n FROM orders GROUP BY 1, 2",
    "recall_counters": """SELECT user_id, MIN(event_id) AS born, COUNT(*) + COUNT(CASE WHEN event_type IN ('view', 'click') THEN 1 END) AS visits, MAX(CASE WHEN event_type IN ('view', 'click') THEN event_id END) AS at FROM events GROUP BY 1""",
    "late_signals": """SELECT e.event_id, CASE WHEN l.event_id IS NOT NULL THEN 'liked' WHEN e.event_id % 5 = 0 THEN 'seen' END AS signal FROM events e LEFT JOIN (SELECT DISTINCT event_id - 1 AS event_id FROM events WHERE event_type = 'purchase') l ON e.event_id = l.event_id""",
    "fact_actions": """WITH e AS (SELECT event_id, user_id, event_type, ROUND(value, 2) AS v FROM events), o AS (SELECT *, LAG(v) OVER w AS old, ROW_NUMBER() OVER w AS r FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)),
        a AS (SELECT *, CASE WHEN old IS NULL THEN 'add' WHEN v IS NULL THEN 'delete' WHEN v = old THEN 'no-op' WHEN v >= old * 1.5 THEN 'supersede' WHEN v > old THEN 'update' ELSE 'coexist' END AS action FROM o)
        SELECT event_id, action, CASE WHEN LEAD(action) OVER w IN ('supersede', 'delete') THEN LEAD(event_id) OVER w END AS superseded_by FROM a WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)""",
    "drop_reasons": "SELECT CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'type' WHEN user_id % 10 = 0 THEN 'self_caused' WHEN COALESCE(value, 0) < 10 THEN 'confidence' ELSE 'kept' END AS reason, COUNT(*) AS n FROM events GROUP BY 1",
    "leak_rates": f"""WITH r AS (SELECT source, lang, COUNT(*) FILTER (h) AS leaked, COUNT(*) FILTER (NOT h) AS kept FROM
        (SELECT source, lang, COALESCE({" OR ".join(f"contains(lower(text), '{m}')" for m in answers.ENVIRONMENT)}, false) AS h FROM {forms.PASSAGES}) GROUP BY 1, 2)
        SELECT source, COUNT(*) AS runs, COUNT(*) FILTER (leaked > 0) AS runs_with_leak, CAST(SUM(leaked) AS BIGINT) AS leaked, ROUND(AVG(kept), 3) AS kept_a_run FROM r GROUP BY 1""",
    "typed_recall": f"""WITH v AS (SELECT vec_id, label, {_UNIT} AS u FROM embeddings), s AS (SELECT q.vec_id AS query_id, r.vec_id, ROUND(list_dot_product(q.u, r.u), 6) AS score FROM v q, v r WHERE q.vec_id % 20 = 0 AND r.label BETWEEN 0 AND 4 AND r.vec_id % 7 <> 0 AND q.vec_id <> r.vec_id),
        f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s QUALIFY r <= 9), c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM f WHERE CASE WHEN vec_id % 10 = 0 THEN 10 ELSE vec_id % 10 END / 10 >= 0.3 QUALIFY rank <= 3)
        SELECT query_id, vec_id, score, CAST(rank AS INT) AS rank FROM c WHERE score > 0.05""",
    "recall_ranking": f"""WITH t AS (SELECT doc_id, {_W} AS w FROM documents), n AS (SELECT COUNT(*) AS n, AVG(len(w)) AS mean FROM t), f AS (SELECT doc_id, w AS term, COUNT(*) AS tf FROM (SELECT doc_id, unnest(w) AS w FROM t) GROUP BY 1, 2), d AS (SELECT term, COUNT(*) AS df FROM f GROUP BY 1),
        q AS (SELECT item_id, unnest(list_distinct({_W})) AS term FROM benchmark), s AS (SELECT item_id, f.doc_id, ROUND(SUM(LN(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))), 6) AS score FROM q JOIN f USING (term) JOIN d USING (term) JOIN t ON t.doc_id = f.doc_id, n GROUP BY 1, 2),
        k AS (SELECT * FROM s WHERE score > 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50), m AS (SELECT MAX(doc_id) AS newest FROM documents),
        r AS (SELECT item_id, doc_id, ROUND(score * POW(0.5, (newest - doc_id) / 1000.0) * (1 - (doc_id % 5) / 10), 6) AS score FROM k, m) SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM r QUALIFY rank <= 5""",
}
