"""Graph, tree and hypergraph queries over the order tables as typed edges, and over documents as pages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.functions.text import words
from siltstone.operators import clusters, graph, ranking, retrieval
from siltstone.session import stored, table


def _places(spark, sf_dir):
    """Regions, nations, customers and suppliers."""
    n, c, s = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    edge = lambda a, rel, b: [F.concat(F.lit(a[0]), F.col(a[1:])).alias("s"), F.lit(rel).alias("rel"), F.concat(F.lit(b[0]), F.col(b[1:])).alias("o")]
    return n.select(*edge("Nn_nationkey", "IN_REGION", "Rn_regionkey")).union(c.select(*edge("Cc_custkey", "LIVES_IN", "Nc_nationkey"))).union(s.select(*edge("Ss_suppkey", "BASED_IN", "Ns_nationkey")))


def _trade(spark, sf_dir):
    """Orders and their customers and suppliers."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    a = o.select(F.concat(F.lit("O"), "o_orderkey").alias("s"), F.lit("ORDERED_BY").alias("rel"), F.concat(F.lit("C"), "o_custkey").alias("o"))
    return a.union(li.select(F.concat(F.lit("O"), "l_orderkey").alias("s"), F.lit("WAS_SUPPLIED").alias("rel"), F.concat(F.lit("S"), "l_suppkey").alias("o")).distinct())


def _regions(spark, sf_dir):
    return table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("node"))


def graph_one_hop(spark, sf_dir):
    return graph.one_hop(_places(spark, sf_dir), _regions(spark, sf_dir))


def graph_k_hop(spark, sf_dir):
    return graph.k_hop(_places(spark, sf_dir), _regions(spark, sf_dir).where("node = 'R0'"), 3)


def graph_bridge(spark, sf_dir):
    return graph.bridges(_trade(spark, sf_dir), "S1", "S2")


def graph_two_step(spark, sf_dir):
    e = _places(spark, sf_dir)
    return graph.two_step(e, "R1", "(?i)in_reg", "(?i)lives|based")


def graph_intersection(spark, sf_dir):
    """Customers with orders supplied by both of two suppliers."""
    t = _trade(spark, sf_dir)
    who = t.where("rel = 'ORDERED_BY'").select("s", F.col("o").alias("customer"))
    one, two = (t.where((F.col("rel") == "WAS_SUPPLIED") & (F.col("o") == x)).select("s").join(who, "s").select("customer") for x in ("S1", "S2"))
    return one.intersect(two)


def graph_degree(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("node"))
    return graph.degree(nodes, _trade(spark, sf_dir))


def reverse_edges(spark, sf_dir):
    return graph.with_inverses(_places(spark, sf_dir), {"IN_REGION": "CONTAINS", "BASED_IN": "HOSTS"})


def passive_flip(spark, sf_dir):
    return graph.passive_flipped(_trade(spark, sf_dir)).groupBy("rel", "s").agg(F.count(F.lit(1)).alias("n"))


def entity_merge(spark, sf_dir):
    """Parts merged by brand where they have one, else by name, with the number of names they go by."""
    p = table(spark, sf_dir, "part").select(F.coalesce(F.col("p_brand"), F.col("p_name")).alias("entity"), "p_name", "p_type")
    return p.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_name").alias("n_aliases"), F.min("p_name").alias("first_alias"), F.count_distinct("p_type").alias("n_types"))


def ppr_topk(spark, sf_dir):
    s = graph.page_rank(_places(spark, sf_dir), _regions(spark, sf_dir).where("node = 'R0'"))
    return s.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "node").limit(60)


def hyperedge_query(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    m = li.select("l_orderkey", F.lit("supplier").alias("kind"), F.col("l_suppkey").alias("node")).union(li.select("l_orderkey", F.lit("part").alias("kind"), F.col("l_partkey").alias("node")))
    return graph.hyperedge_partners(m, "l_orderkey", "kind", "node", [("supplier", 1), ("supplier", 2)])


def _tree(spark, sf_dir):
    """Parts as a tree: the parent of a part is the one with a quarter of its key, if there is one."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_name")
    up = p.select(F.col("node").alias("parent"))
    quarter = F.floor(F.col("node") / 4)
    return p.join(up, (quarter == F.col("parent")) & (F.col("node") != F.col("parent")), "left")


def tree_closure(spark, sf_dir):
    c = graph.closure(_tree(spark, sf_dir))
    return c.groupBy("ancestor").agg(F.count(F.lit(1)).alias("n_below"), F.max("dist").alias("height"))


def tree_ancestors(spark, sf_dir):
    return graph.closure(_tree(spark, sf_dir)).select("node", "ancestor", "dist")


def tree_leaves(spark, sf_dir):
    t = _tree(spark, sf_dir)
    inner = t.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct()
    leaves = t.select("node").join(inner, "node", "left_anti")
    return graph.closure(t).join(leaves, "node", "left_semi").groupBy("ancestor").agg(F.count(F.lit(1)).alias("n_leaves"))


def tree_depth(spark, sf_dir):
    t = _tree(spark, sf_dir)
    d = graph.closure(t).groupBy("node").agg(F.max("dist").alias("d"))
    return t.join(d, "node", "left").select("node", (F.coalesce("d", F.lit(0)) + 1).alias("depth"))


def tree_breadcrumb(spark, sf_dir):
    t = _tree(spark, sf_dir)
    names = t.select(F.col("node").alias("ancestor"), "p_name")
    up = graph.closure(t).join(names, "ancestor").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("dist", "p_name")), asc=False).alias("l"))
    trail = F.array_join(F.concat(F.transform(F.coalesce("l", F.array().cast("array<struct<dist:int,p_name:string>>")), lambda x: x["p_name"]), F.array("p_name")), " > ")
    return t.join(up, "node", "left").select("node", trail.alias("breadcrumb"))


def _hits(spark, sf_dir):
    """Low-quality documents as hit pages; a document's page is its place among those of its source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    d = ranking.positions(d, ["source"], ["doc_id"], "page")[0]
    return d, d.join(table(spark, sf_dir, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_semi")


def page_ranges(spark, sf_dir):
    return graph.islands(_hits(spark, sf_dir)[1], ["source"], "page", 1)


def range_text(spark, sf_dir):
    d, hits = _hits(spark, sf_dir)
    r = graph.islands(hits, ["source"], "page", 1)
    # pages and ranges meet in buckets of pages, so that no source is one key
    r = r.withColumn("_bucket", F.explode(F.sequence(F.shiftright("lo", 6), F.shiftright("hi", 6))))
    own = r.join(d.withColumn("_bucket", F.shiftright("page", 6)), ["source", "_bucket"]).where(F.col("page").between(F.col("lo"), F.col("hi")))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "doc_id", F.md5("text").alias("t")))), lambda x: x["t"]), "")
    return own.groupBy("source", "lo", "hi").agg(F.md5(parts).alias("digest"), F.count(F.lit(1)).alias("n"))


def graph_expand_context(spark, sf_dir):
    """The best three documents of each item and up to two more among the next seven that share a source with them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    ranked = retrieval.bm25(docs.select("doc_id", "text"), b, "doc_id", "item_id", words(), words(), 10).join(docs.select("doc_id", "source"), "doc_id")
    ranked = stored(ranked, "ranked")
    top = ranked.where("rank <= 3")
    pulled = ranked.where("rank > 3").join(top.select("item_id", "source").distinct(), ["item_id", "source"], "left_semi")
    pulled = retrieval.top_k(pulled, ["item_id"], [F.col("rank")], 2, "pull").drop("pull")
    return top.unionByName(pulled).select("item_id", "doc_id", "rank")


def kmeans_silhouette(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    chosen, seen, _ = clusters.auto_k(e, "embedding", range(5, 13))
    return spark.createDataFrame([(k, round(v, 6), k == chosen) for k, v in seen.items()], "k int, silhouette double, chosen boolean")


def near_dup_greedy(spark, sf_dir):
    """Documents that stay when near duplicates by term cosine are dropped; longer ones are hotter.

    Of equal texts the first id removes the others before they can remove anything, so only it is compared. Texts
    without a word are similar to none and stay.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    worded = F.coalesce(F.lower("text").rlike("[a-z0-9]"), F.lit(False))
    first = stored(d.where(worded).groupBy(F.md5("text")).agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "first")
    rows = d.where(worded).join(first, "doc_id", "left_semi")
    gone = clusters.greedy_similar(rows, "doc_id", words(), F.length("text"), 0.92)
    stay = first.unionByName(d.where(~worded).select("doc_id")).join(gone, F.col("doc_id") == F.col("k"), "left_anti")
    return d.join(stay, "doc_id", "left_semi").select("doc_id", F.length("text").alias("heat"))


def plan_levels(spark, sf_dir):
    """Levels of a task graph in which each task waits for its tree parent: those of one level may run together."""
    return tree_depth(spark, sf_dir).groupBy("depth").agg(F.count(F.lit(1)).alias("n_tasks"))


def leaderboard(spark, sf_dir):
    """Suppliers of each nation by balance; equal balances share a rank."""
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", "s_nationkey", F.rank().over(W.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"))).alias("place"))


QUERIES = {f.__name__: f for f in (graph_one_hop, graph_k_hop, graph_bridge, graph_two_step, graph_intersection, graph_degree, reverse_edges, passive_flip, entity_merge, ppr_topk, hyperedge_query, tree_closure, tree_ancestors, tree_leaves, tree_depth, tree_breadcrumb, page_ranges, range_text, graph_expand_context, kmeans_silhouette, near_dup_greedy, plan_levels, leaderboard)}

_PLACES = """pl AS (SELECT 'N' || n_nationkey AS s, 'IN_REGION' AS rel, 'R' || n_regionkey AS o FROM nation UNION ALL
        SELECT 'C' || c_custkey, 'LIVES_IN', 'N' || c_nationkey FROM customer UNION ALL SELECT 'S' || s_suppkey, 'BASED_IN', 'N' || s_nationkey FROM supplier)"""
_TRADE = """tr AS (SELECT 'O' || o_orderkey AS s, 'ORDERED_BY' AS rel, 'C' || o_custkey AS o FROM orders UNION ALL
        SELECT DISTINCT 'O' || l_orderkey, 'WAS_SUPPLIED', 'S' || l_suppkey FROM lineitem)"""
_TREE = """tn AS (SELECT a.p_partkey AS node, a.p_name, b.p_partkey AS parent FROM part a LEFT JOIN part b ON a.p_partkey // 4 = b.p_partkey AND a.p_partkey <> b.p_partkey),
        cl AS (SELECT node, parent AS ancestor, 1 AS dist FROM tn WHERE parent IS NOT NULL UNION ALL SELECT cl.node, tn.parent, dist + 1 FROM cl JOIN tn ON cl.ancestor = tn.node WHERE tn.parent IS NOT NULL)"""
_HITS = """d AS (SELECT doc_id, source, text, ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page FROM documents), h AS (SELECT * FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)),
        w AS (SELECT DISTINCT source, unnest(range(GREATEST(page - 1, 0), page + 2)) AS p FROM h),
        r AS (SELECT source, p, p - ROW_NUMBER() OVER (PARTITION BY source ORDER BY p) AS g FROM w),
        isl AS (SELECT source, MIN(p) AS lo, MAX(p) AS hi FROM r GROUP BY source, g)"""


def _bm25_sql() -> str:
    from siltstone.plans.retrieval import _TERMS_SQL, _bm25_sql

    return f"{_TERMS_SQL}, {_bm25_sql(10)}"


ORACLES = {
    "graph_one_hop": f"WITH {_PLACES} SELECT DISTINCT * FROM pl WHERE s LIKE 'R%' OR o IN (SELECT 'R' || r_regionkey FROM region)",
    "graph_k_hop": f"""WITH RECURSIVE {_PLACES}, ed AS (SELECT s AS a, o AS b FROM pl UNION SELECT o, s FROM pl),
        bf AS (SELECT 'R0' AS node, 0 AS dist UNION SELECT b, dist + 1 FROM bf JOIN ed ON a = node WHERE dist < 3) SELECT node, MIN(dist) AS dist FROM bf GROUP BY 1""",
    "graph_bridge": f"""WITH {_TRADE} SELECT s AS mid, COUNT(CASE WHEN o = 'S1' THEN 1 END) AS n_a, COUNT(CASE WHEN o = 'S2' THEN 1 END) AS n_b
        FROM tr WHERE o IN ('S1', 'S2') GROUP BY 1 HAVING COUNT(DISTINCT o) = 2""",
    "graph_two_step": f"WITH {_PLACES} SELECT b.s AS target, COUNT(*) AS ways FROM pl a JOIN pl b ON b.o = a.s WHERE a.o = 'R1' AND a.rel = 'IN_REGION' AND b.rel IN ('LIVES_IN', 'BASED_IN') GROUP BY 1",
    "graph_intersection": f"""WITH {_TRADE}, c AS (SELECT a.o AS sup, b.o AS customer FROM tr a JOIN tr b ON a.s = b.s WHERE a.rel = 'WAS_SUPPLIED' AND b.rel = 'ORDERED_BY')
        SELECT customer FROM c WHERE sup = 'S1' INTERSECT SELECT customer FROM c WHERE sup = 'S2'""",
    "graph_degree": f"WITH {_TRADE} SELECT 'C' || c_custkey AS node, COUNT(s) AS degree FROM customer LEFT JOIN (SELECT DISTINCT * FROM tr) t ON t.o = 'C' || c_custkey GROUP BY 1",
    "reverse_edges": f"""WITH {_PLACES} SELECT * FROM pl UNION SELECT o, CASE rel WHEN 'IN_REGION' THEN 'CONTAINS' ELSE 'HOSTS' END, s FROM pl WHERE rel IN ('IN_REGION', 'BASED_IN')""",
    "passive_flip": f"WITH {_TRADE} SELECT CASE rel WHEN 'ORDERED_BY' THEN 'ORDERED' ELSE 'SUPPLIED' END AS rel, o AS s, COUNT(*) AS n FROM tr GROUP BY 1, 2",
    "entity_merge": "SELECT COALESCE(p_brand, p_name) AS entity, COUNT(*) AS n, COUNT(DISTINCT p_name) AS n_aliases, MIN(p_name) AS first_alias, COUNT(DISTINCT p_type) AS n_types FROM part GROUP BY 1",
    "hyperedge_query": """WITH m AS (SELECT l_orderkey, 'supplier' AS kind, l_suppkey AS node FROM lineitem UNION ALL SELECT l_orderkey, 'part', l_partkey FROM lineitem),
        h AS (SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (1, 2) GROUP BY 1 HAVING COUNT(DISTINCT l_suppkey) = 2)
        SELECT DISTINCT kind, node FROM m WHERE l_orderkey IN (SELECT l_orderkey FROM h) AND NOT (kind = 'supplier' AND node IN (1, 2))""",
    "tree_closure": f"WITH RECURSIVE {_TREE} SELECT ancestor, COUNT(*) AS n_below, MAX(dist) AS height FROM cl GROUP BY 1",
    "tree_ancestors": f"WITH RECURSIVE {_TREE} SELECT node, ancestor, dist FROM cl",
    "tree_leaves": f"WITH RECURSIVE {_TREE} SELECT ancestor, COUNT(*) AS n_leaves FROM cl WHERE node NOT IN (SELECT parent FROM tn WHERE parent IS NOT NULL) GROUP BY 1",
    "tree_depth": f"WITH RECURSIVE {_TREE} SELECT tn.node, COALESCE(MAX(dist), 0) + 1 AS depth FROM tn LEFT JOIN cl ON tn.node = cl.node GROUP BY 1",
    "tree_breadcrumb": f"""WITH RECURSIVE {_TREE}, up AS (SELECT cl.node, string_agg(p_name, ' > ' ORDER BY dist DESC) AS t FROM cl JOIN tn ON tn.node = cl.ancestor GROUP BY 1)
        SELECT tn.node, COALESCE(t || ' > ', '') || p_name AS breadcrumb FROM tn LEFT JOIN up ON tn.node = up.node""",
    "page_ranges": f"WITH {_HITS} SELECT source, lo, hi FROM isl",
    "range_text": f"WITH {_HITS} SELECT isl.source, lo, hi, md5(string_agg(md5(text), '' ORDER BY page, doc_id)) AS digest, COUNT(*) AS n FROM isl JOIN d ON d.source = isl.source AND page BETWEEN lo AND hi GROUP BY 1, 2, 3",
    "graph_expand_context": f"""WITH {_bm25_sql()}, k AS (SELECT bm.*, source FROM bm JOIN documents USING (doc_id)), t AS (SELECT * FROM k WHERE rank <= 3),
        p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY rank) AS n FROM k WHERE rank > 3 AND (item_id, source) IN (SELECT (item_id, source) FROM t))
        SELECT item_id, doc_id, rank FROM t UNION ALL SELECT item_id, doc_id, rank FROM p WHERE n <= 2""",
    "plan_levels": f"WITH RECURSIVE {_TREE}, x AS (SELECT tn.node, COALESCE(MAX(dist), 0) + 1 AS depth FROM tn LEFT JOIN cl ON tn.node = cl.node GROUP BY 1) SELECT depth, COUNT(*) AS n_tasks FROM x GROUP BY 1",
    "leaderboard": "SELECT s_suppkey, s_nationkey, RANK() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS place FROM supplier",
}
