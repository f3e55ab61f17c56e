"""Reranking, hybrid search, chunk sweeps, canonical JSON, retention and redirects."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from siltstone.functions import canonical, sparse
from siltstone.functions.text import words
from siltstone.operators import clusters, containment, graph, ranking, rerank, retrieval, state, sweeps
from siltstone.plans import graphs
from siltstone.plans import retrieval as lists
from siltstone.session import stored, table


def _jaccard():
    """The stand-in scorer as an outside function: what a cross-encoder would be."""
    import re

    def score(queries, texts):
        out = []
        for q, t in zip(queries, texts, strict=True):
            a, b = (set(re.findall("[a-z0-9]+", x.lower())) for x in (q, t))
            out.append(len(a & b) / len(a | b) if a | b else 0.0)
        return np.array(out)

    return score


def _candidates(spark, sf_dir, asked, k: int):
    """(item_id, doc_id, rank, query, text) of the first k documents by BM25 for (item_id, text)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = retrieval.bm25(docs, asked, "doc_id", "item_id", words(), words(), k).select("item_id", "doc_id", "rank")
    return found.join(docs, "doc_id").join(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query")), "item_id")


def rerank_two_stage(spark, sf_dir):
    """Thirty documents by BM25 for each item, then the best five by the pair scorer."""
    found = _candidates(spark, sf_dir, table(spark, sf_dir, "benchmark").select("item_id", "text"), 30)
    return rerank.rerank(found, "item_id", "doc_id", rerank.pair_slot(_jaccard)(F.col("query"), F.col("text")), 5)


def hyde_rerank(spark, sf_dir):
    """Documents found by a hypothetical answer (a stand-in: the last twelve words of the item), ranked against the item."""
    w = words()
    last = F.array_join(F.slice(w, F.greatest(F.size(w) - 11, F.lit(1)), 12), " ")
    asked = table(spark, sf_dir, "benchmark").where(F.size(w) > 0).select("item_id", last.alias("text"))
    return rerank.rerank(_candidates(spark, sf_dir, asked, 30), "item_id", "doc_id", rerank.overlap(F.col("query"), F.col("text")), 5)


def _sparse(spark, sf_dir, name: str, key: str):
    return sparse.encode(table(spark, sf_dir, name).select(key, "text"), key, words())


def sparse_signature(spark, sf_dir):
    nnz, total = sparse.signature("sparse")
    return _sparse(spark, sf_dir, "documents", "doc_id").select("doc_id", nnz.alias("nnz"), total.alias("total"))


def hybrid_search(spark, sf_dir):
    """Vectors whose id is a document's, with the document's sparse vector: dense and sparse lists of 20, fused."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text").join(vectors.select("vec_id"), "vec_id", "left_semi")
    rows = stored(vectors.join(sparse.encode(docs, "vec_id", words()), "vec_id"), "hybrid")
    asked = rows.where("vec_id % 20 = 0")
    dense = retrieval.cosine_top_k(rows.select("vec_id", "embedding"), asked, "vec_id", "embedding", 20).select("query_id", "vec_id", "rank", F.lit(0).alias("list_ix"))
    lexical = retrieval.sparse_top_k(rows, asked, "vec_id", "sparse", 20, sparse.VOCABULARY).select("query_id", "vec_id", "rank", F.lit(1).alias("list_ix"))
    fused = retrieval.fuse(dense.unionByName(lexical), "query_id", "vec_id")
    return retrieval.top_k(fused, ["query_id"], [F.desc("score"), F.col("first_list"), F.col("first_rank")], 10).select("query_id", "vec_id", "score", "n_lists", "rank")


GRID = [(400, 0), (400, 100), (1000, 0), (1000, 100)]


def chunk_sweep(spark, sf_dir):
    """Hit rate of the parents of the five best chunks, for each size and overlap of chunks.

    Eight passages of a source make a parent; an item's gold parents are those with a passage that holds the item. All
    settings are cut in one pass over the texts and searched together: a chunk's score is the number of the item's words
    that it has.
    """
    d, _ = ranking.positions(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), ["source"], ["doc_id"])
    d = d.select("doc_id", "text", F.concat_ws("/", "source", F.floor(F.col("place") / 8)).alias("parent"))
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    asked = items.select(F.col("item_id").cast("long").alias("k"), F.explode(F.array_distinct(words())).alias("term"))
    top = sweeps.best_parents(d.groupBy("parent").agg(F.collect_list("text").alias("texts")), asked, GRID, 5).withColumnRenamed("k", "item_id")
    held = containment.contained(containment.classes(items, "item_id", "text"), d.select("doc_id", containment.normal("text").alias("text")), "item_id", "doc_id")
    gold = stored(held.join(d.select("doc_id", "parent"), "doc_id").select("item_id", "parent").distinct(), "gold")
    asked_n = gold.select("item_id").distinct().count()
    hits = top.join(gold, ["item_id", "parent"], "left_semi").groupBy("size", "overlap").agg(F.count_distinct("item_id").alias("hits"))
    grid = spark.createDataFrame(GRID, "size int, overlap int")
    return grid.join(hits, ["size", "overlap"], "left").select("size", "overlap", F.lit(asked_n).cast("long").alias("n_queries"), F.round(F.coalesce("hits", F.lit(0)) / F.lit(float(asked_n or 1)), 6).alias("hit_rate"))


def canonical_json(spark, sf_dir):
    """Events and their properties as nested JSON written in two orders of keys; both have one canonical form."""
    e = table(spark, sf_dir, "events")
    a = F.concat(F.lit('{"user" : {"id": '), "user_id", F.lit(', "Event":"'), "event_type", F.lit('"}, "list":[{"b":2, "a":1}, '), F.col("event_id") % 7, F.lit('], "props": '), "props", F.lit("}"))
    b = F.concat(F.lit('{"props":'), "props", F.lit(', "list": [{"a": 1,"b": 2},'), F.col("event_id") % 7, F.lit('],\n "user":{"Event": "'), "event_type", F.lit('","id":'), "user_id", F.lit("}}"))
    rows = e.select("event_id", a.alias("a"), b.alias("b"))
    return rows.select("event_id", canonical.canonical(F.col("a")).alias("form"), canonical.digest(F.col("b")).alias("sha"))


def enforce_memory(spark, sf_dir):
    """Retention of documents by source: near duplicates go, then the coldest beyond a budget, then what is left is counted.

    Heat is the length; the budget is 30 a source; documents whose id is divisible by 9 are never evicted.
    """
    docs = stored(table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("heat")), "facts")
    alive = stored(graphs.near_dup_greedy(spark, sf_dir).select("doc_id"), "alive")
    kept = docs.join(alive, "doc_id", "left_semi")
    exempt = F.col("doc_id") % 9 == 0
    sizes = kept.groupBy("source").agg(F.count(F.lit(1)).alias("kept"), F.count_if(exempt).alias("exempt"))
    evicted = F.least(F.greatest(F.col("kept") - 30, F.lit(0)), F.col("kept") - F.col("exempt"))
    order, _ = ranking.positions(kept.where(~exempt), ["source"], ["heat", "doc_id"], "cold")
    gone = order.join(F.broadcast(sizes.select(F.col("source").alias("_s"), evicted.alias("_n"))), F.col("source").eqNullSafe(F.col("_s"))).where("cold < _n")
    warmest = gone.groupBy("source").agg(F.max("heat").alias("warmest_evicted"))
    total = docs.groupBy("source").agg(F.count(F.lit(1)).alias("facts")).join(sizes, "source", "left").join(warmest, "source", "left")
    left = F.coalesce("kept", F.lit(0))
    return total.select("source", (F.col("facts") - left).alias("deduped"), F.coalesce(evicted, F.lit(0)).alias("evicted"), (left - F.coalesce(evicted, F.lit(0))).alias("final"), "warmest_evicted")


def redirect_views(spark, sf_dir):
    """Views of page addresses under their final names: an address leads to the page of a third of its id, some to nowhere.

    Chains are followed to their end; an address whose end was never seen has 0 views.
    """
    p = table(spark, sf_dir, "pages").groupBy(F.regexp_replace("url", "#.*$", "").alias("title")).agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("views"))
    p = stored(p, "titles")
    end = p.select(F.col("page_id").alias("_p"), F.col("title").alias("to"))
    links = p.where("page_id % 4 < 3 AND page_id > 0").join(end, F.floor(F.col("page_id") / 3) == F.col("_p")).select(F.col("title").alias("from"), "to")
    lost = p.where("page_id % 4 = 3 AND page_id % 5 = 0").select(F.col("title").alias("from"), F.concat(F.lit("gone:"), "title").alias("to"))
    final = graph.resolved(links.unionByName(lost))
    return graph.views_of(p.select("title"), final, p.select("title", "views"))


QUERIES = {f.__name__: f for f in (rerank_two_stage, hyde_rerank, sparse_signature, hybrid_search, chunk_sweep, canonical_json, enforce_memory, redirect_views)}

_JACCARD = """jc AS (SELECT c.item_id, c.doc_id, c.rank AS before, ROUND(len(list_intersect(a, w)) / len(list_distinct(list_concat(a, w))), 6) AS score FROM {found} c
        JOIN (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS a FROM benchmark) q ON q.item_id = c.item_id JOIN (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) d ON d.doc_id = c.doc_id)
        SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, before, doc_id) AS rank FROM jc QUALIFY rank <= 5"""
_LAST = """bt AS (SELECT item_id, term, COUNT(*) AS tf FROM (SELECT item_id, unnest(w[greatest(len(w) - 11, 1):]) AS term FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark)) GROUP BY 1, 2)"""
_SPARSE_SQL = """sv AS (SELECT doc_id, t, ROUND(LN(1 + COUNT(*)), 6) AS w FROM (SELECT doc_id, CAST('0x' || substr(md5(x), 1, 7) AS BIGINT) % 1048576 AS t FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS x FROM documents)) GROUP BY 1, 2)"""
_GREEDY_SQL = """tf AS (SELECT doc_id, w, COUNT(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) GROUP BY 1, 2),
        one AS (SELECT MIN(doc_id) AS doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM tf) GROUP BY text), tk AS (SELECT * FROM tf WHERE doc_id IN (SELECT doc_id FROM one)),
        nm AS (SELECT doc_id, SQRT(SUM(n * n)) AS z FROM tk GROUP BY 1), heat AS (SELECT doc_id, length(text) AS h FROM documents),
        pr AS MATERIALIZED (SELECT a, b, CASE WHEN x.h < y.h THEN a ELSE b END AS loser, ROW_NUMBER() OVER (ORDER BY a, b) AS k FROM (SELECT x.doc_id AS a, y.doc_id AS b, SUM(x.n * y.n) AS xy FROM tk x JOIN tk y ON x.w = y.w AND x.doc_id < y.doc_id GROUP BY 1, 2) JOIN nm p ON p.doc_id = a JOIN nm q ON q.doc_id = b JOIN heat x ON x.doc_id = a JOIN heat y ON y.doc_id = b WHERE ROUND(xy / (p.z * q.z), 9) >= 0.92),
        gr AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone, CAST([] AS BIGINT[]) AS before UNION ALL
               SELECT gr.k + 1, CASE WHEN list_contains(before, a) OR list_contains(gone, b) THEN gone ELSE list_append(gone, loser) END,
                      CASE WHEN list_contains(before, a) OR list_contains(gone, b) OR loser = a THEN before ELSE list_append(before, loser) END FROM gr JOIN pr ON pr.k = gr.k + 1),
        dead AS (SELECT unnest(gone) AS doc_id FROM gr WHERE k = (SELECT MAX(k) FROM gr)),
        alive AS (SELECT doc_id FROM documents WHERE (doc_id IN (SELECT doc_id FROM one) OR doc_id NOT IN (SELECT doc_id FROM tf)) AND doc_id NOT IN (SELECT doc_id FROM dead))"""
_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"

ORACLES = {
    "rerank_two_stage": f"WITH {lists._TERMS_SQL}, {lists._bm25_sql(30)}, {_JACCARD.format(found='bm')}",
    "hyde_rerank": f"WITH {lists._TERMS_SQL.split('bt AS')[0]} {_LAST}, {lists._bm25_sql(30)}, {_JACCARD.format(found='bm')}",
    "sparse_signature": f"WITH {_SPARSE_SQL} SELECT d.doc_id, COUNT(t) AS nnz, ROUND(COALESCE(SUM(w), 0), 6) AS total FROM documents d LEFT JOIN sv ON sv.doc_id = d.doc_id GROUP BY 1",
    "hybrid_search": f"""WITH {_SPARSE_SQL}, v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
        cs AS (SELECT q.vec_id AS query_id, d.vec_id, ROUND(list_cosine_similarity(q.e, d.e), 6) AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
        ds AS (SELECT query_id, vec_id, 0 AS list_ix, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cs QUALIFY rank <= 20),
        so AS (SELECT q.doc_id AS query_id, d.doc_id AS vec_id, ROUND(SUM(q.w * d.w), 6) AS score FROM sv q JOIN sv d ON q.t = d.t AND q.doc_id <> d.doc_id WHERE q.doc_id % 20 = 0 AND q.doc_id IN (SELECT vec_id FROM v) AND d.doc_id IN (SELECT vec_id FROM v) GROUP BY 1, 2),
        sp AS (SELECT query_id, vec_id, 1 AS list_ix, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM so QUALIFY rank <= 20),
        fu AS (SELECT query_id, vec_id, ROUND(SUM(1.0 / (60.0 + rank)), 9) AS score, CAST(COUNT(*) AS INT) AS n_lists, MIN(list_ix) AS first_list, arg_min(rank, list_ix) AS first_rank FROM (SELECT * FROM ds UNION ALL SELECT * FROM sp) GROUP BY 1, 2)
        SELECT query_id, vec_id, score, n_lists, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, first_list, first_rank) AS rank FROM fu QUALIFY rank <= 10""",
    "chunk_sweep": f"""WITH d AS (SELECT doc_id, text, trim(text, ' ') AS t, source || '/' || ((ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8) AS parent FROM documents),
        g AS (SELECT * FROM (VALUES {', '.join(f'({a}, {b})' for a, b in GRID)}) g(size, overlap)),
        ch AS (SELECT doc_id, parent, size, overlap, i, substr(t, CAST(i * (size - overlap) + 1 AS BIGINT), size) AS text FROM d, g, LATERAL (SELECT unnest(range(0, CAST(GREATEST(1, CEIL((length(t) - overlap) / (size - overlap))) AS BIGINT))) AS i) WHERE length(t) > 0),
        tm AS (SELECT size, overlap, parent, doc_id, i, unnest(list_distinct({_WORDS})) AS w FROM ch), q AS (SELECT item_id, unnest(list_distinct({_WORDS})) AS w FROM benchmark),
        sc AS (SELECT size, overlap, item_id, parent, doc_id, i, COUNT(*) AS n FROM tm JOIN q USING (w) GROUP BY ALL), bs AS (SELECT size, overlap, item_id, parent, MAX(n) AS n FROM sc GROUP BY ALL),
        tp AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY size, overlap, item_id ORDER BY n DESC, parent) AS r FROM bs QUALIFY r <= 5),
        nb AS (SELECT MIN(item_id) AS item_id, t FROM (SELECT item_id, lower(trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ')) AS t FROM benchmark) WHERE t <> '' GROUP BY t),
        gd AS (SELECT DISTINCT item_id, parent FROM nb JOIN d ON contains(lower(trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ')), nb.t)), nq AS (SELECT COUNT(DISTINCT item_id) AS n FROM gd)
        SELECT size, overlap, ANY_VALUE(nq.n) AS n_queries, ROUND(COUNT(DISTINCT gd.item_id) / GREATEST(ANY_VALUE(nq.n), 1), 6) AS hit_rate FROM g CROSS JOIN nq LEFT JOIN tp USING (size, overlap) LEFT JOIN gd ON gd.item_id = tp.item_id AND gd.parent = tp.parent GROUP BY 1, 2""",
    "canonical_json": """WITH f AS (SELECT event_id, '{"list":[{"a":1,"b":2},' || event_id % 7 || '],"props":' || replace(replace(props, ': ', ':'), ', ', ',') || ',"user":{"Event":"' || event_type || '","id":' || user_id || '}}' AS form FROM events)
        SELECT event_id, form, sha256(form) AS sha FROM f""",
    "enforce_memory": f"""WITH RECURSIVE {_GREEDY_SQL}, k AS (SELECT d.doc_id, source, length(text) AS heat, d.doc_id % 9 = 0 AS exempt FROM documents d JOIN alive ON alive.doc_id = d.doc_id),
        z AS (SELECT source, COUNT(*) AS kept, LEAST(GREATEST(COUNT(*) - 30, 0), COUNT(*) FILTER (NOT exempt)) AS n FROM k GROUP BY 1),
        e AS (SELECT k.source, heat, ROW_NUMBER() OVER (PARTITION BY k.source ORDER BY heat, doc_id) AS r, z.n FROM k JOIN z ON z.source = k.source WHERE NOT exempt QUALIFY r <= n)
        SELECT d.source, COUNT(*) - COALESCE(ANY_VALUE(kept), 0) AS deduped, COALESCE(ANY_VALUE(n), 0) AS evicted, COALESCE(ANY_VALUE(kept), 0) - COALESCE(ANY_VALUE(n), 0) AS final, ANY_VALUE(w.warmest) AS warmest_evicted
        FROM documents d LEFT JOIN z ON z.source = d.source LEFT JOIN (SELECT source, MAX(heat) AS warmest FROM e GROUP BY 1) w ON w.source = d.source GROUP BY 1""",
    "near_dup_greedy": f"WITH RECURSIVE {_GREEDY_SQL} SELECT doc_id, length(text) AS heat FROM documents JOIN alive USING (doc_id)",
    "redirect_views": """WITH RECURSIVE p AS (SELECT regexp_replace(url, '#.*$', '') AS title, MIN(page_id) AS page_id, COUNT(*) AS views FROM pages GROUP BY 1),
        l AS (SELECT a.title AS f, b.title AS t FROM p a JOIN p b ON a.page_id // 3 = b.page_id WHERE a.page_id % 4 < 3 AND a.page_id > 0 UNION ALL SELECT title, 'gone:' || title FROM p WHERE page_id % 4 = 3 AND page_id % 5 = 0),
        w AS (SELECT title, title AS cur, 0 AS hops FROM p UNION ALL SELECT w.title, l.t, hops + 1 FROM w JOIN l ON l.f = w.cur), e AS (SELECT title, arg_max(cur, hops) AS final, MAX(hops) AS hops FROM w GROUP BY 1),
        s AS (SELECT final, SUM(views) AS n FROM e JOIN p USING (title) GROUP BY 1)
        SELECT e.title, final, CASE WHEN final LIKE 'gone:%' THEN 0 ELSE CAST(n AS BIGINT) END AS views FROM e JOIN s USING (final)""",
}
