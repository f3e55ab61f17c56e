"""Vector and lexical retrieval, fusion and metrics: every id divisible by 20 asks, all rows answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.text import words
from siltstone.functions.vectors import norm
from siltstone.operators import lexical, metrics, retrieval
from siltstone.session import table

def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e, e.where("vec_id % 20 = 0")


def _dense(spark, sf_dir, k):
    e, q = _vectors(spark, sf_dir)
    return retrieval.cosine_top_k(e.select("vec_id", "embedding"), q, "vec_id", "embedding", k).select("query_id", "vec_id", "rank", "score")


def cosine_topk(spark, sf_dir):
    return _dense(spark, sf_dir, 10)


def cosine_threshold_delta(spark, sf_dir):
    return retrieval.within_band(_dense(spark, sf_dir, 10), "query_id", "score", 0.3, 0.05, 5)


def cluster_centroids(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def vector_signature(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(norm("embedding"), 6).alias("norm"), *[F.round(F.element_at("embedding", i).cast("double"), 6).alias(f"v{i}") for i in (1, 2, 3)])


def _search(spark, sf_dir, **ks):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bench = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return lexical.search(docs, bench, "doc_id", "item_id", words(), words(), ks)


def _bm25(spark, sf_dir, k):
    return _search(spark, sf_dir, bm25=k)["bm25"]


def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, 10)


def tf_cosine_pairs(spark, sf_dir):
    return _search(spark, sf_dir, cosine=5)["cosine"]


def sparse_dot_topk(spark, sf_dir):
    return _search(spark, sf_dir, dot=10)["dot"]


def _two_lists(spark, sf_dir):
    """Ranked lists of documents for each benchmark item: BM25 and term cosine."""
    found = _search(spark, sf_dir, bm25=50, cosine=50)
    lists = [found[kind].select("item_id", "doc_id", "rank", F.lit(i).alias("list_ix")) for i, kind in enumerate(("bm25", "cosine"))]
    return lists[0].unionByName(lists[1])


def rrf_fuse(spark, sf_dir):
    f = retrieval.fuse(_two_lists(spark, sf_dir), "item_id", "doc_id")
    return retrieval.top_k(f, ["item_id"], [F.desc("score"), F.col("first_list"), F.col("first_rank")], 10)


def rrf_page(spark, sf_dir):
    f = retrieval.fuse(_two_lists(spark, sf_dir), "item_id", "doc_id", rank_base=0, pool=9)
    return retrieval.top_k(f, ["item_id"], [F.desc("score"), F.col("doc_id")], 3).select("item_id", "doc_id", "score", "rank")


def rrf_multiquery(spark, sf_dir):
    f = retrieval.fuse(_two_lists(spark, sf_dir), "item_id", "doc_id", pool=20)
    return retrieval.top_k(f, ["item_id"], [F.desc("score"), F.col("first_list"), F.col("first_rank")], 30)


def rrf_ensemble(spark, sf_dir):
    """Fusion keyed by content: equal texts of different documents count as one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.lower(F.trim("text"))).alias("content"))
    lists = _two_lists(spark, sf_dir).join(docs, "doc_id")
    best = lists.groupBy("item_id", "content", "list_ix").agg(F.min("rank").alias("rank"))
    f = retrieval.fuse(best, "item_id", "content", pool=40)
    return retrieval.top_k(f, ["item_id"], [F.desc("score"), F.col("first_list"), F.col("first_rank")], 5)


def interleave_dedupe(spark, sf_dir):
    return retrieval.interleave(_two_lists(spark, sf_dir), "item_id", "doc_id")


def parent_max_pool(spark, sf_dir):
    s = _dense(spark, sf_dir, 50).withColumn("parent", F.floor(F.col("vec_id") / 8))
    return retrieval.parent_max(s, "query_id", "parent", "score", 10)


def ir_metrics(spark, sf_dir):
    e, q = _vectors(spark, sf_dir)
    asked = q.select(F.col("vec_id").alias("query_id"), "label")
    return metrics.label_metrics(_dense(spark, sf_dir, 10), asked, e, "query_id", "vec_id", "label", 10)


def grounding_budget(spark, sf_dir):
    """Coverage of each item's words by the documents that BM25 finds for it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bench = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.filter(words(), lambda w: F.length(w) > 4)).alias("ents"))
    ranked = _bm25(spark, sf_dir, 10).join(docs, "doc_id").join(bench, "item_id")
    return metrics.budget_score(ranked.select("item_id", "rank", metrics.coverage(F.col("text"), F.col("ents")).alias("cov")), "item_id", "cov", 3)


QUERIES = {f.__name__: f for f in (cosine_topk, cosine_threshold_delta, cluster_centroids, vector_signature, bm25_topk, tf_cosine_pairs, sparse_dot_topk, rrf_fuse, rrf_page, rrf_multiquery, rrf_ensemble, interleave_dedupe, parent_max_pool, ir_metrics, grounding_budget)}


def _dense_sql(k: int) -> str:
    return f"""v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
        cs AS (SELECT q.vec_id AS query_id, d.vec_id, ROUND(list_cosine_similarity(q.e, d.e), 6) AS score
              FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
        dn AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cs) WHERE rank <= {k})"""


_TERMS_SQL = """dt AS (SELECT doc_id, term, COUNT(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1, 2),
        bt AS (SELECT item_id, term, COUNT(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY 1, 2)"""


def _bm25_sql(k: int) -> str:
    return f"""dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM documents),
        st AS (SELECT COUNT(*) AS n, AVG(dl) AS mean FROM dl),
        dfs AS (SELECT term, COUNT(*) AS df FROM dt GROUP BY 1),
        bs AS (SELECT item_id, dt.doc_id, ROUND(SUM(LN(1 + (n - df + 0.5) / (df + 0.5)) * dt.tf * 2.5 / (dt.tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score
              FROM bt JOIN dt ON bt.term = dt.term JOIN dfs ON dfs.term = dt.term JOIN dl ON dl.doc_id = dt.doc_id, st GROUP BY 1, 2),
        bm AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bs WHERE score > 0) WHERE rank <= {k})"""


def _tfcos_sql(k: int) -> str:
    return f"""dnm AS (SELECT doc_id, SQRT(SUM(tf * tf)) AS l FROM dt GROUP BY 1), bnm AS (SELECT item_id, SQRT(SUM(tf * tf)) AS l FROM bt GROUP BY 1),
        xy AS (SELECT item_id, doc_id, SUM(bt.tf * dt.tf) AS xy FROM bt JOIN dt ON bt.term = dt.term GROUP BY 1, 2),
        tcs AS (SELECT xy.item_id, xy.doc_id, ROUND(xy / (bnm.l * dnm.l), 6) AS score FROM xy JOIN bnm ON bnm.item_id = xy.item_id JOIN dnm ON dnm.doc_id = xy.doc_id),
        tc AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM tcs) WHERE rank <= {k})"""


_LISTS_SQL = f"""{_TERMS_SQL}, {_bm25_sql(50)}, {_tfcos_sql(50)},
        li AS (SELECT item_id, doc_id, rank, 0 AS list_ix FROM bm UNION ALL SELECT item_id, doc_id, rank, 1 FROM tc)"""


def _fuse_sql(key: str, base: int, pool: int, source: str = "li") -> str:
    return f"""fu AS (SELECT item_id, {key}, ROUND(SUM(1.0 / (59.0 + {base} + rank)), 9) AS score, CAST(COUNT(DISTINCT list_ix) AS INT) AS n_lists,
              MIN(list_ix) AS first_list, arg_min(rank, list_ix * 1000 + rank) AS first_rank FROM {source} WHERE rank <= {pool} GROUP BY 1, 2)"""


def _fused(key: str, base: int, pool: int, k: int, order: str, columns: str, source: str = "li", more: str = "") -> str:
    return f"""WITH {_LISTS_SQL}{more}, {_fuse_sql(key, base, pool, source)}
        SELECT {columns} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, {order}) AS rank FROM fu) WHERE rank <= {k}"""


_SEEN = "first_list, first_rank"
ORACLES = {
    "cosine_topk": f"WITH {_dense_sql(10)} SELECT query_id, vec_id, rank, score FROM dn",
    "cosine_threshold_delta": f"""WITH {_dense_sql(10)},
        k AS (SELECT *, MAX(score) OVER (PARTITION BY query_id) AS best FROM dn WHERE rank <= 5),
        b AS (SELECT *, MIN(CASE WHEN score < 0.3 OR best - score > 0.05 THEN rank END) OVER (PARTITION BY query_id) AS bad FROM k)
        SELECT query_id, vec_id, rank, score FROM b WHERE bad IS NULL OR rank < bad""",
    "cluster_centroids": """
        SELECT label, pos - 1 AS pos, ROUND(AVG(CAST(x AS DOUBLE)), 6) AS mean
        FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2""",
    "vector_signature": """
        SELECT vec_id, ROUND(SQRT(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding])), 6) AS norm,
               ROUND(CAST(embedding[1] AS DOUBLE), 6) AS v1, ROUND(CAST(embedding[2] AS DOUBLE), 6) AS v2, ROUND(CAST(embedding[3] AS DOUBLE), 6) AS v3 FROM embeddings""",
    "bm25_topk": f"WITH {_TERMS_SQL}, {_bm25_sql(10)} SELECT item_id, doc_id, score, rank FROM bm",
    "tf_cosine_pairs": f"WITH {_TERMS_SQL}, {_tfcos_sql(5)} SELECT item_id, doc_id, score, rank FROM tc",
    "sparse_dot_topk": f"""WITH {_TERMS_SQL},
        s AS (SELECT item_id, doc_id, ROUND(SUM(ROUND(LN(1 + bt.tf), 6) * ROUND(LN(1 + dt.tf), 6)), 6) AS score FROM bt JOIN dt ON bt.term = dt.term GROUP BY 1, 2)
        SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
    "rrf_fuse": _fused("doc_id", 1, 50, 10, _SEEN, "*"),
    "rrf_page": _fused("doc_id", 0, 9, 3, "doc_id", "item_id, doc_id, score, rank"),
    "rrf_multiquery": _fused("doc_id", 1, 20, 30, _SEEN, "*"),
    "rrf_ensemble": _fused("content", 1, 40, 5, _SEEN, "*", "lc", """,
        lc AS (SELECT item_id, md5(lower(trim(text, ' '))) AS content, list_ix, MIN(rank) AS rank FROM li JOIN documents USING (doc_id) GROUP BY 1, 2, 3)"""),
    "interleave_dedupe": f"""WITH {_LISTS_SQL}, f AS (SELECT item_id, doc_id, MIN(rank * 10 + list_ix) AS o FROM li GROUP BY 1, 2)
        SELECT item_id, doc_id, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY o) AS place FROM f""",
    "parent_max_pool": f"""WITH {_dense_sql(50)}, p AS (SELECT query_id, vec_id // 8 AS parent, MAX(score) AS score FROM dn GROUP BY 1, 2)
        SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, parent) AS rank FROM p) WHERE rank <= 10""",
    "ir_metrics": f"""WITH {_dense_sql(10)},
        g AS (SELECT q.vec_id AS query_id, d.vec_id FROM v q JOIN v d ON q.label = d.label AND q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
        n AS (SELECT query_id, COUNT(*) AS n_gold FROM g GROUP BY 1),
        h AS (SELECT dn.query_id, COUNT(*) AS n, MIN(rank) AS f, SUM(1 / LOG2(rank + 1)) AS dcg FROM dn JOIN g ON g.query_id = dn.query_id AND g.vec_id = dn.vec_id GROUP BY 1)
        SELECT n.query_id, CASE WHEN h.n > 0 THEN 1 ELSE 0 END AS hit, ROUND(COALESCE(h.n, 0) / n_gold, 6) AS recall, ROUND(COALESCE(1.0 / f, 0), 6) AS mrr,
               ROUND(COALESCE(dcg, 0) / list_sum([1 / LOG2(i + 1) FOR i IN range(1, LEAST(n_gold, 10) + 1)]), 6) AS ndcg
        FROM n LEFT JOIN h ON n.query_id = h.query_id""",
    "grounding_budget": f"""WITH {_TERMS_SQL}, {_bm25_sql(10)},
        o AS (SELECT item_id, w, MIN(i) AS i FROM (SELECT item_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS l FROM benchmark)) WHERE length(w) > 4 GROUP BY 1, 2),
        e AS (SELECT item_id, list(w ORDER BY i) AS ents FROM o GROUP BY 1),
        c AS (SELECT bm.item_id, rank, COALESCE(len([x FOR x IN ents IF contains(lower(text), x)]) / len(ents), 0.0) AS cov FROM bm JOIN documents USING (doc_id) JOIN benchmark b ON b.item_id = bm.item_id LEFT JOIN e ON e.item_id = bm.item_id)
        SELECT item_id, ROUND(MAX(cov / LOG2(rank + 1)), 6) AS discounted, ROUND(MAX(cov), 6) AS flat FROM c WHERE rank <= 3 GROUP BY 1""".replace("FROM bm JOIN documents USING (doc_id) JOIN benchmark b ON b.item_id = bm.item_id", "FROM bm JOIN documents USING (doc_id)"),
}
