"""Answers against their passages, runs against one another, plans of sub-queries, entity lookup, containment and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.text import all_words, words
from siltstone.operators import containment, entities, graph, grounding, metrics, planning, retrieval, routing, significance, textops
from siltstone.plans import retrieval as lists
from siltstone.plans import text as texts
from siltstone.session import stored, table

STOP = texts.STOP


def _answers(spark, sf_dir):
    """Items with the three documents that BM25 finds and an answer of six bullets.

    Bullets quote the first and the third document, and the item itself; one cites a passage that is not theirs, one is a
    hash that shares nothing with the passage it cites, one cites nothing, and one cites a passage that is not there.
    """
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    found = lists._bm25(spark, sf_dir, 3).join(docs, "doc_id").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_h"))
    rows = items.join(found, "item_id").withColumn("passages", F.transform("_h", lambda h: h["text"]))
    quote = lambda t, n: F.substring(F.translate(t, "\n", " "), 1, n)
    first, last, own = F.element_at("passages", 1), F.element_at("passages", -1), F.col("query")
    lines = [
        F.concat(F.lit("- "), quote(first, 80), F.lit(" [#1]")), F.concat(F.lit("- "), quote(own, 60), F.lit(" [#2]")), F.concat(quote(last, 60), F.lit(" [#1]")),
        F.concat(F.md5(own), F.lit(" [#2]")), F.concat(F.lit("  no source "), quote(own, 30)), F.lit(" "), F.concat(quote(own, 50), F.lit(" [#9]")),
    ]
    return rows.select("item_id", "query", "passages", F.concat_ws("\n", *lines).alias("answer"))


def drift_filter(spark, sf_dir):
    """Bullets of each answer that stay, and how many go since they share no word with the passage they cite."""
    a = _answers(spark, sf_dir)
    kept = grounding.undrifted(F.col("answer"), F.col("passages"), STOP)
    return a.select("item_id", F.md5(F.array_join(kept, "\n")).alias("kept"), (F.size(grounding.bullets(F.col("answer"))) - F.size(kept)).alias("dropped"))


def selfrag_rates(spark, sf_dir):
    """Citation, faithfulness and coverage of each answer and their mean; odd items answer without citations."""
    answer = F.when(F.col("item_id") % 2 == 0, F.col("answer")).otherwise(F.regexp_replace("answer", r"\[#", "[no "))
    a = _answers(spark, sf_dir).select("item_id", grounding.rates(answer, F.col("passages"), F.col("query"), STOP).alias("r"))
    return a.select("item_id", "r.*")


def context_gain(spark, sf_dir):
    """Coverage of each item's longer words by its best document, by its best three together, and the difference."""
    wanted = F.array_distinct(F.filter(words("query"), lambda w: F.length(w) > 4))
    a = _answers(spark, sf_dir).select("item_id", wanted.alias("ents"), "passages")
    plain, more = (grounding.context_coverage(F.slice("passages", 1, n), F.col("ents")) for n in (1, 3))
    return a.select("item_id", F.round(plain, 6).alias("plain"), F.round(more, 6).alias("expanded"), F.round(more - plain, 6).alias("delta"))


def run_significance(spark, sf_dir):
    """Searches by the first 8, 32 and all coordinates of a vector: paired randomisation of their nDCG."""
    e = table(spark, sf_dir, "embeddings")
    runs = None
    for name, n in (("first_32", 32), ("first_8", 8), ("full", None)):
        v = e.withColumn("embedding", F.slice("embedding", 1, n)) if n else e
        q = v.where("vec_id % 20 = 0")
        top = retrieval.cosine_top_k(v.select("vec_id", "embedding"), q, "vec_id", "embedding", 10)
        own = metrics.label_metrics(top, q.select(F.col("vec_id").alias("query_id"), "label"), v, "query_id", "vec_id", "label", 10).select(F.lit(name).alias("run"), F.col("query_id").alias("query"), F.col("ndcg").alias("score"))
        runs = own if runs is None else runs.unionByName(own)
    return significance.randomisation_test(stored(runs, "runs"))


def _plans(spark, sf_dir):
    """Conversations as plans: answers combine the two turns before them, and some also wait for the turn after them.

    A turn may so wait for one that is not there, and two may wait for each other.
    """
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    nodes = c.select(F.col("conv_id").alias("plan"), F.col("turn").alias("node"), F.col("turn").alias("seq"), F.when(F.col("role") == "assistant", "synthesis").otherwise("lookup").alias("kind"), "text")
    named = F.array(F.col("node") - 1, F.col("node") - 2)
    named = F.when(F.length("text") % 5 == 0, F.concat(named, F.array(F.col("node") + 1))).otherwise(named)
    first = nodes.groupBy("plan").agg(F.min("node").alias("_low"))
    deps = nodes.where("kind = 'synthesis'").join(first, "plan").select("plan", "node", F.posexplode(F.filter(named, lambda d: d >= F.col("_low"))).alias("dep_seq", "dep"))
    return stored(nodes, "nodes"), stored(deps, "deps")


def plan_order(spark, sf_dir):
    nodes, deps = _plans(spark, sf_dir)
    return planning.execution_order(nodes, deps).select("plan", "node", "kind", "pos")


def _overlap(spark, sf_dir, asked, key: list[str]):
    """(key, doc, score): words that a text shares with the items, over the words of both."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc"), F.array_distinct(words()).alias("_w"))
    mine = asked.select(*key, F.array_distinct(words()).alias("_w"))
    size = lambda t, k, n: t.select(*k, F.size("_w").alias(n))
    shared = mine.select(*key, F.explode("_w").alias("w")).join(items.select("doc", F.explode("_w").alias("w")), "w").groupBy(*key, "doc").agg(F.count(F.lit(1)).alias("_n"))
    out = shared.join(size(mine, key, "_a"), key).join(size(items, ["doc"], "_b"), "doc")
    return out.select(*key, "doc", F.round(F.col("_n") / (F.col("_a") + F.col("_b") - F.col("_n")), 6).alias("score"))


def plan_evidence(spark, sf_dir):
    """Evidence of each step of a plan: six items a lookup, the deduplicated union of what it names for a synthesis."""
    nodes, deps, ordered, evidence = _evidence(spark, sf_dir)
    counts = evidence.groupBy("plan", "node").agg(F.count(F.lit(1)).alias("n"))
    return ordered.join(counts, ["plan", "node"], "left").select("plan", "node", "pos", F.coalesce("n", F.lit(0)).alias("n_passages"))


def _evidence(spark, sf_dir):
    nodes, deps = _plans(spark, sf_dir)
    ordered = stored(planning.execution_order(nodes, deps), "ordered")
    hits = retrieval.top_k(_overlap(spark, sf_dir, nodes, ["plan", "node"]), ["plan", "node"], [F.desc("score"), F.col("doc")], 6)
    return nodes, deps, ordered, stored(planning.gathered(ordered, deps, hits), "evidence")


def plan_answers(spark, sf_dir):
    """The union of a plan's evidence, ranked again against the plan's first text; ties keep the order of the union."""
    nodes, _, ordered, evidence = _evidence(spark, sf_dir)
    union = planning.union_of(ordered, evidence)
    asked = nodes.groupBy("plan").agg(F.min_by("text", "seq").alias("text"))
    scored = union.join(_overlap(spark, sf_dir, asked, ["plan"]), ["plan", "doc"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return retrieval.top_k(scored, ["plan"], [F.desc("score"), F.col("seen")], 6).select("plan", "doc", "score", "rank")


def _asked_entities(spark, sf_dir):
    """Queries by entity: entities of documents, parts of them, and texts of items."""
    e = table(spark, sf_dir, "documents").select("doc_id", F.explode(textops.entities(F.col("text"))).alias("entity"))
    few = e.groupBy("entity").agg(F.min("doc_id").alias("_d")).where("_d % 20 = 0").select("entity")
    name = F.col("entity")
    exact = few.select(F.concat(F.lit("exact:"), name).alias("query_id"), F.upper(name).alias("query"))
    part = few.where(F.length(name) > 4).select(F.concat(F.lit("part:"), name).alias("query_id"), F.expr("substring(entity, 2, length(entity) - 2)").alias("query"))
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item:"), F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("query"))
    return e.select("entity", F.col("doc_id").alias("node")), exact.unionByName(part).unionByName(items)


def entity_tiers(spark, sf_dir):
    """Documents that mention what is asked: as an entity, as a part of one, or by its words."""
    index, asked = _asked_entities(spark, sf_dir)
    return entities.find_nodes(index, asked, "query_id", "query").select("query_id", "tier", "node", "n", "rank")


def contained_texts(spark, sf_dir):
    """Items and documents whose normalised texts contain one another, classes of equal texts by their smallest id."""
    return containment.either_way(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id")


def _outline(spark, sf_dir):
    """Parts as a tree (the parent of a part has a quarter of its key), with pages and a summary."""
    p = table(spark, sf_dir, "part")
    t = p.select(F.col("p_partkey").alias("node"), F.col("p_name").alias("title"), F.col("p_size").alias("lo"), (F.col("p_size") + F.col("p_partkey") % 3).alias("hi"), F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_name", F.lit("in boxes of"), "p_name", "p_type", F.lit("\nsecond line")).alias("summary"))
    up = t.select(F.col("node").alias("parent"))
    return t.join(up, (F.floor(F.col("node") / 4) == F.col("parent")) & (F.col("node") != F.col("parent")), "left")


def tree_view(spark, sf_dir):
    """The outline before its parts: depth, pages and the first 120 characters of the summary's first line."""
    t = _outline(spark, sf_dir)
    order = graph.preorder(t.select("node", "parent", F.col("node").alias("seq")))
    line = F.substring(F.substring_index("summary", "\n", 1), 1, 120)
    return order.join(t, "node").select("root", "place", "node", "depth", "title", F.concat_ws("-", "lo", "hi").alias("pages"), line.alias("summary"))


def subtree_order(spark, sf_dir):
    """Nodes of each tree as a stack visits them: the last child first."""
    t = _outline(spark, sf_dir)
    return graph.preorder(t.select("node", "parent", F.col("node").alias("seq")), last_first=True).select("root", "place", "node")


QUERIES = {f.__name__: f for f in (drift_filter, selfrag_rates, context_gain, run_significance, plan_order, plan_evidence, plan_answers, entity_tiers, contained_texts, tree_view, subtree_order)}

_STOP = ", ".join(f"'{w}'" for w in STOP)
_ALL = lambda t: f"regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+')"
_KEYS = lambda t: f"list_distinct([w FOR w IN {_ALL(t)} IF w NOT IN ({_STOP})])"
_W = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def _answers_sql() -> str:
    q = lambda t, n: f"substr(replace({t}, chr(10), ' '), 1, {n})"
    return f"""{lists._TERMS_SQL}, {lists._bm25_sql(3)},
        h AS (SELECT item_id, list(text ORDER BY rank) AS p FROM bm JOIN documents USING (doc_id) GROUP BY 1),
        an AS (SELECT item_id, text AS query, p, array_to_string(['- ' || {q('p[1]', 80)} || ' [#1]', '- ' || {q('text', 60)} || ' [#2]', {q('p[-1]', 60)} || ' [#1]', md5(text) || ' [#2]', '  no source ' || {q('text', 30)}, ' ', {q('text', 50)} || ' [#9]'], chr(10)) AS answer
            FROM benchmark JOIN h USING (item_id))"""


def _bullets_sql(answer: str) -> str:
    """One row a bullet with the passage it cites."""
    return f"""bl AS (SELECT item_id, p, query, answer, unnest(l) AS b, generate_subscripts(l, 1) AS i FROM
            (SELECT *, [x FOR x IN [regexp_replace(y, '^\\s+|\\s+$', '', 'g') FOR y IN string_split(answer, chr(10))] IF x <> ''] AS l FROM (SELECT item_id, p, query, {answer} AS answer FROM an))),
        ci AS (SELECT *, CASE WHEN n BETWEEN 1 AND len(p) THEN p[n] END AS passage FROM (SELECT *, TRY_CAST(NULLIF(regexp_extract(b, '\\[#(\\d+)\\]', 1), '') AS INT) AS n FROM bl))"""


_PLANS_SQL = """c AS (SELECT conv_id AS plan, turn AS node, MIN(role) AS role, MIN(text) AS text FROM conversations GROUP BY 1, 2), lo AS (SELECT plan, MIN(node) AS low FROM c GROUP BY 1),
        s AS (SELECT plan, node, CASE role WHEN 'assistant' THEN 'synthesis' ELSE 'lookup' END AS kind, text,
                CASE WHEN role = 'assistant' THEN [d FOR d IN CASE WHEN length(text) % 5 = 0 THEN [node - 1, node - 2, node + 1] ELSE [node - 1, node - 2] END IF d >= low] ELSE [] END AS deps FROM c JOIN lo USING (plan)),
        g AS (SELECT plan, list({'id': node, 'deps': deps} ORDER BY node) AS all_of FROM s GROUP BY 1),
        k AS (SELECT plan, all_of, CAST([] AS BIGINT[]) AS done, [CAST(n.id AS BIGINT) FOR n IN all_of IF len(n.deps) = 0] AS ready FROM g UNION ALL
              SELECT plan, all_of, list_append(done, ready[1]), list_concat(ready[2:], [CAST(n.id AS BIGINT) FOR n IN all_of IF NOT list_contains(list_append(done, ready[1]), n.id) AND NOT list_contains(ready, n.id) AND list_has_all(list_append(done, ready[1]), n.deps)]) FROM k WHERE len(ready) > 0),
        fin AS (SELECT plan, list_concat(done, [CAST(n.id AS BIGINT) FOR n IN all_of IF NOT list_contains(done, n.id)]) AS l FROM k WHERE len(ready) = 0),
        od AS (SELECT plan, unnest(l) AS node, unnest(range(len(l))) AS pos FROM fin)"""
_OVER_SQL = """iw AS (SELECT item_id AS doc, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark),
        jac AS (SELECT plan, node, doc, ROUND(n / (a + b - n), 6) AS score FROM (SELECT plan, node, doc, len(list_intersect(m.w, iw.w)) AS n, len(m.w) AS a, len(iw.w) AS b FROM (SELECT plan, node, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM s) m, iw) WHERE n > 0),
        hit AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY plan, node ORDER BY score DESC, doc) AS rank FROM jac QUALIFY rank <= 6),
        own AS (SELECT plan, node, list(doc ORDER BY rank) AS docs FROM hit GROUP BY 1, 2),
        st AS (SELECT plan, list({'node': od.node, 'deps': deps, 'docs': COALESCE(docs, [])} ORDER BY pos) AS l FROM od JOIN s USING (plan, node) LEFT JOIN own USING (plan, node) GROUP BY 1),
        ev AS (SELECT plan, l, 0 AS i, CAST([] AS STRUCT(node BIGINT, docs BIGINT[])[]) AS e FROM st UNION ALL
               SELECT plan, l, i + 1, list_append(e, {'node': CAST(l[i + 1].node AS BIGINT), 'docs': CASE WHEN len(l[i + 1].deps) > 0 THEN list_distinct(flatten([x.docs FOR x IN e IF list_contains(l[i + 1].deps, x.node)])) ELSE l[i + 1].docs END}) FROM ev WHERE i < len(l)),
        fe AS (SELECT plan, unnest(e) AS x FROM ev WHERE i = len(l))"""
_TIERS_SQL = f"""e AS (SELECT doc_id AS node, unnest({texts._ENTITIES}) AS entity FROM documents), ix AS (SELECT DISTINCT lower(entity) AS name, entity, node FROM e),
        few AS (SELECT entity FROM e GROUP BY 1 HAVING MIN(node) % 20 = 0),
        q AS (SELECT 'exact:' || entity AS query_id, lower(upper(entity)) AS part FROM few UNION ALL SELECT 'part:' || entity, lower(substr(entity, 2, length(entity) - 2)) FROM few WHERE length(entity) > 4 UNION ALL SELECT 'item:' || item_id, lower(text) FROM benchmark),
        t1 AS (SELECT DISTINCT query_id, 1 AS tier, node, 1 AS n FROM q JOIN ix ON part = name),
        r2 AS (SELECT * FROM q WHERE query_id NOT IN (SELECT query_id FROM t1)), t2 AS (SELECT query_id, 2 AS tier, node, COUNT(*) AS n FROM r2 JOIN ix ON contains(name, part) GROUP BY 1, 3),
        r3 AS (SELECT query_id, unnest({_ALL('part')}) AS w FROM r2 WHERE query_id NOT IN (SELECT query_id FROM t2)), t3 AS (SELECT query_id, 3 AS tier, node, COUNT(*) AS n FROM (SELECT * FROM r3 WHERE length(w) > 2) JOIN ix ON contains(name, w) GROUP BY 1, 3),
        u AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3)"""
_TREE_SQL = """tn AS (SELECT a.*, b.p_partkey AS parent FROM part a LEFT JOIN part b ON a.p_partkey // 4 = b.p_partkey AND a.p_partkey <> b.p_partkey),
        tr AS (SELECT p_partkey AS node, p_partkey AS root, 0 AS depth, [{sign}p_partkey] AS path FROM tn WHERE parent IS NULL UNION ALL SELECT tn.p_partkey, root, depth + 1, list_append(path, {sign}tn.p_partkey) FROM tr JOIN tn ON tn.parent = tr.node)"""

ORACLES = {
    "drift_filter": f"""WITH {_answers_sql()}, {_bullets_sql('answer')},
        k AS (SELECT *, passage IS NULL OR len(list_intersect({_KEYS('b')}, {_ALL('passage')})) > 0 AS stays FROM ci)
        SELECT item_id, md5(COALESCE(string_agg(b, chr(10) ORDER BY i) FILTER (stays), '')) AS kept, COUNT(*) FILTER (NOT stays) AS dropped FROM k GROUP BY 1""",
    "selfrag_rates": f"""WITH {_answers_sql()}, {_bullets_sql("CASE WHEN item_id % 2 = 0 THEN answer ELSE replace(answer, '[#', '[no ') END")},
        r AS (SELECT item_id, COUNT(n) / COUNT(*) AS c, COUNT(*) FILTER (passage IS NOT NULL AND len(list_intersect({_KEYS('b')}, {_KEYS('passage')})) >= 3) / COUNT(*) AS f,
              ANY_VALUE(len(list_intersect({_KEYS('query')}, {_ALL('answer')})) / GREATEST(len({_KEYS('query')}), 1)) AS v FROM ci GROUP BY 1)
        SELECT item_id, ROUND(c, 3) AS citation_rate, ROUND(f, 3) AS faithfulness_rate, ROUND(v, 3) AS coverage, ROUND((c + f + v) / 3, 3) AS confidence, ROUND(c, 3) >= 0.5 AND ROUND(f, 3) >= 0.5 AS passes FROM r""",
    "context_gain": f"""WITH {_answers_sql()}, w AS (SELECT item_id, p, list_distinct([x FOR x IN regexp_extract_all(lower(query), '[a-z0-9]+') IF length(x) > 4]) AS e FROM an),
        c AS (SELECT item_id, CASE WHEN len(e) > 0 THEN len([x FOR x IN e IF contains(lower(p[1]), x)]) / len(e) ELSE 0 END AS a, CASE WHEN len(e) > 0 THEN len([x FOR x IN e IF contains(lower(array_to_string(p, chr(10))), x)]) / len(e) ELSE 0 END AS b FROM w)
        SELECT item_id, ROUND(a, 6) AS plain, ROUND(b, 6) AS expanded, ROUND(b - a, 6) AS delta FROM c""",
    "run_significance": """WITH r AS (SELECT * FROM (VALUES ('first_32', 32), ('first_8', 8), ('full', 1000000)) t(run, n)), v AS (SELECT run, vec_id, label, [CAST(x AS DOUBLE) FOR x IN list_slice(embedding, 1, n)] AS e FROM embeddings, r),
        s AS (SELECT q.run, q.vec_id AS query, q.label AS ql, d.label, d.vec_id, ROUND(list_cosine_similarity(q.e, d.e), 6) AS score FROM v q JOIN v d ON q.run = d.run AND q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
        t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run, query ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10),
        g AS (SELECT query, COUNT(*) AS gold FROM s WHERE run = 'full' AND ql = label GROUP BY 1),
        m AS (SELECT run, t.query, ROUND(COALESCE(SUM(CASE WHEN ql = label THEN 1 / LOG2(rank + 1) END), 0) / ANY_VALUE(list_sum([1 / LOG2(i + 1) FOR i IN range(1, LEAST(gold, 10) + 1)])), 6) AS ndcg FROM t JOIN g ON g.query = t.query GROUP BY 1, 2),
        d AS (SELECT a.run AS run_a, b.run AS run_b, a.query, CAST(ROUND(a.ndcg * 1000000) AS BIGINT) - CAST(ROUND(b.ndcg * 1000000) AS BIGINT) AS d FROM m a JOIN m b ON a.query = b.query AND a.run < b.run),
        f AS (SELECT run_a, run_b, query, d, blk, j, (CAST('0x' || substr(md5(query || ':' || blk), 1, 15) AS BIGINT) >> j) & 1 AS bit FROM d, range(17) x(blk), range(60) y(j)),
        z AS (SELECT run_a, run_b, blk, j, SUM(CASE WHEN bit = 1 THEN d ELSE -d END) AS flipped, SUM(d) AS seen, COUNT(*) AS n FROM f GROUP BY 1, 2, 3, 4)
        SELECT run_a, run_b, MAX(n) AS n, ROUND(MAX(seen) / (MAX(n) * 1000000), 6) AS mean_diff, ROUND(COUNT(*) FILTER (ABS(flipped) >= ABS(seen)) / 1020, 6) AS p FROM z GROUP BY 1, 2""",
    "plan_order": f"WITH RECURSIVE {_PLANS_SQL} SELECT plan, node, kind, pos FROM od JOIN s USING (plan, node)",
    "plan_evidence": f"WITH RECURSIVE {_PLANS_SQL}, {_OVER_SQL} SELECT fe.plan, x.node AS node, pos, len(x.docs) AS n_passages FROM fe JOIN od ON od.plan = fe.plan AND od.node = x.node",
    "plan_answers": f"""WITH RECURSIVE {_PLANS_SQL}, {_OVER_SQL},
        un AS (SELECT plan, doc, MIN(pos * 1000 + rank) AS seen FROM hit JOIN od USING (plan, node) JOIN s USING (plan, node) WHERE len(deps) = 0 GROUP BY 1, 2),
        fs AS (SELECT plan, MIN(node) AS node FROM s GROUP BY 1), sc AS (SELECT un.plan, un.doc, seen, COALESCE(score, 0) AS score FROM un JOIN fs ON fs.plan = un.plan LEFT JOIN jac ON jac.plan = un.plan AND jac.node = fs.node AND jac.doc = un.doc)
        SELECT plan, doc, score, ROW_NUMBER() OVER (PARTITION BY plan ORDER BY score DESC, seen) AS rank FROM sc QUALIFY rank <= 6""",
    "entity_tiers": f"WITH {_TIERS_SQL} SELECT query_id, tier, node, n, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY n DESC, node) AS rank FROM u QUALIFY rank <= 10",
    "contained_texts": """WITH b AS (SELECT MIN(item_id) AS item_id, COUNT(*) AS n, t FROM (SELECT item_id, lower(trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ')) AS t FROM benchmark) WHERE t <> '' GROUP BY t),
        d AS (SELECT MIN(doc_id) AS doc_id, COUNT(*) AS n, t FROM (SELECT doc_id, lower(trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ')) AS t FROM documents) WHERE t <> '' GROUP BY t)
        SELECT item_id, b.n AS item_copies, doc_id, d.n AS doc_copies, CASE WHEN b.t = d.t THEN 'equal' WHEN contains(d.t, b.t) THEN 'item_id inside' ELSE 'doc_id inside' END AS relation FROM b, d WHERE contains(d.t, b.t) OR contains(b.t, d.t)""".replace("item_copies", "item_id_copies").replace("doc_copies", "doc_id_copies"),
    "tree_view": "WITH RECURSIVE " + _TREE_SQL.replace("{sign}", "") + """ SELECT root, ROW_NUMBER() OVER (PARTITION BY root ORDER BY path) - 1 AS place, node, depth, p_name AS title, p_size || '-' || (p_size + p_partkey % 3) AS pages,
        substr(p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_name || ' in boxes of ' || p_name || ' ' || p_type || ' ', 1, 120) AS summary FROM tr JOIN part ON p_partkey = node""",
    "subtree_order": "WITH RECURSIVE " + _TREE_SQL.replace("{sign}", "-") + " SELECT root, ROW_NUMBER() OVER (PARTITION BY root ORDER BY path) - 1 AS place, node FROM tr",
}
