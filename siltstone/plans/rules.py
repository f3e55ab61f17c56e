"""Decision rules, filtered recall, boards and grids."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.functions.text import words
from siltstone.operators import predicates, retrieval
from siltstone.plans import forms
from siltstone.session import table

COUNTS = ["how many", "how much", "how often"]
ORDERS = ["first", "before", "after", "last", "order"]
PREFIXES = [("The", "the"), ("Th", "th"), ("A", "a"), ("An", "an"), ("O", "o")]


def filtered_recall(spark, sf_dir):
    """The five nearest rows of the query's own label; the threshold applies after the limit."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    same = retrieval.cosine_top_k(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 5, same="label")
    return same.where("score > 0.2")


def question_kind(spark, sf_dir):
    c = forms.turns(table(spark, sf_dir, "conversations"))
    kind = F.when(predicates.starts_with_any(F.col("text"), COUNTS), "count").when(predicates.after_blank(F.col("text"), ORDERS), "order").otherwise("other")
    depth = F.when(kind == "count", 40).when(kind == "order", 30).otherwise(5)
    return c.select("conv_id", "turn", "role", kind.alias("kind"), depth.alias("depth"))


def heading_candidates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return d.select("doc_id", "line", predicates.heading(F.col("text")).alias("kind")).where("kind IS NOT NULL")


def status_prefix(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", predicates.by_prefix(F.col("text"), PREFIXES, "none").alias("status"))


def corrective_route(spark, sf_dir):
    s = F.col("value") / 100
    e = table(spark, sf_dir, "events")
    return e.select("event_id", predicates.corrective(s).alias("route"), predicates.next_step(s, [0.05, 0.25, 0.5]).alias("ramp"))


def gold_rank(spark, sf_dir):
    """Rank at which a document with the query's label is met first, among ten, and how hard that makes the query."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    top = retrieval.cosine_top_k(e.select("vec_id", "embedding"), e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10)
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"))
    hits = top.join(e.select("vec_id", "label"), "vec_id").join(q, "query_id").where("ql = label").groupBy("query_id").agg(F.min("rank").alias("gold"))
    out = q.join(hits, "query_id", "left")
    return out.select("query_id", "gold", predicates.difficulty(F.col("gold")).alias("difficulty"), F.round(F.coalesce(1 / F.col("gold"), F.lit(0.0)), 6).alias("mrr"))


def relation_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", predicates.relation_name(F.col("p_type")).alias("rel"))


def answer_number(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", predicates.number(F.col("text")).alias("answer"))


def sample_sizes(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return g.select("source", "n", predicates.sample_size(F.col("n"), 0.3, 5, 50).alias("q"))


def normalised_lookup(spark, sf_dir):
    """Documents whose text is a benchmark item's but for case and blanks; items without one have none."""
    def norm(c):
        return F.lower(F.regexp_replace(F.regexp_replace(c, "[ \t\n]+", " "), "^ | $", ""))

    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(norm("text")).alias("k"))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.md5(norm("text")).alias("k"))
    return b.join(d, "k", "left").groupBy("item_id").agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("first_doc"))


def missing_labels(spark, sf_dir):
    """Documents that no label has landed for."""
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


def compression_ratio(spark, sf_dir):
    """Distinct words over words, by language, as the mean of the documents' ratios."""
    d = table(spark, sf_dir, "documents").select("lang", F.size(F.array_distinct(words())).alias("c"), F.size(words()).alias("r"))
    return d.groupBy("lang").agg(F.round(F.avg(F.col("c") / F.greatest(F.col("r"), F.lit(1))), 6).alias("ratio"))


def best_arm(spark, sf_dir):
    """For each day the kind of event with the largest mean value; of equals the first by name."""
    e = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.round(F.avg("value"), 6).alias("m"))
    return retrieval.top_k(e, ["day"], [F.desc("m"), F.col("event_type")], 1).drop("rank")


def weight_grid(spark, sf_dir):
    """Share of the orders whose weighted score passes one, for each pair of weights of a small fixed grid."""
    o = table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 250000).alias("a"), (F.pmod("o_custkey", F.lit(10)) / 10).alias("b"))
    hit = F.avg((F.col("a") * F.col("wa") + F.col("b") * F.col("wb") > 1).cast("int"))
    # the grid is exploded as an array, so the orders are read once and aggregated per task
    pairs = [F.struct(F.lit(x / 2).alias("wa"), F.lit(y / 2).alias("wb")) for x in range(1, 4) for y in range(1, 4)]
    return o.select("a", "b", F.explode(F.array(*pairs)).alias("w")).select("a", "b", "w.*").groupBy("wa", "wb").agg(F.round(hit, 6).alias("hit_rate"))


def seed_scores(spark, sf_dir):
    """Composite scores of customers as seeds: 2.5 with a positive balance, 0.8 in the segment, 0.3 * ln(orders + 1)."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("deg"))
    c = table(spark, sf_dir, "customer").join(n, "c_custkey", "left")
    s = F.when(F.col("c_acctbal") > 0, 2.5).otherwise(0.0) + F.when(F.col("c_mktsegment") == "BUILDING", 0.8).otherwise(0.0) + 0.3 * F.log(F.coalesce("deg", F.lit(0)) + 1)
    scored = c.select("c_custkey", "c_nationkey", F.round(s, 6).alias("score")).where("score >= 2.0")
    return retrieval.top_k(scored, ["c_nationkey"], [F.desc("score"), F.col("c_custkey")], 5)


def running_fifo(spark, sf_dir):
    """Turns of a conversation that stay when the oldest go until the estimated tokens fit 400."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.floor(F.length("text") / 4).alias("tokens"))
    later = F.sum("tokens").over(W.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role")).rowsBetween(W.unboundedPreceding, W.currentRow))
    return c.withColumn("held", later).where("held <= 400").select("conv_id", "turn", "role", "held")


QUERIES = {f.__name__: f for f in (filtered_recall, question_kind, heading_candidates, status_prefix, corrective_route, gold_rank, relation_names, answer_number, sample_sizes, normalised_lookup, missing_labels, compression_ratio, best_arm, weight_grid, seed_scores, running_fifo)}

_V = "v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings)"
_S = "cs AS (SELECT q.vec_id AS query_id, q.label AS ql, d.vec_id, d.label, ROUND(list_cosine_similarity(q.e, d.e), 6) AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)"
_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_T = "trim(line, ' ')"
_LW = "[w FOR w IN string_split(trim(line, ' '), ' ') IF w <> '']"
_COUNT = " OR ".join(f"starts_with(lower(trim(text, ' ')), '{w}')" for w in COUNTS)
_ORDER = " OR ".join(f"contains(lower(text), ' {w}')" for w in ORDERS)
_PRE = " ".join(f"WHEN starts_with(text, '{p}') THEN '{x}'" for p, x in sorted(PREFIXES, key=lambda q: (-len(q[0]), q[0])))

ORACLES = {
    "filtered_recall": f"""WITH {_V}, {_S} SELECT query_id, vec_id, score, rank FROM
        (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cs WHERE ql = label) WHERE rank <= 5 AND score > 0.2""",
    "question_kind": f"""SELECT conv_id, turn, role, kind, CASE kind WHEN 'count' THEN 40 WHEN 'order' THEN 30 ELSE 5 END AS depth FROM
        (SELECT *, CASE WHEN {_COUNT} THEN 'count' WHEN {_ORDER} THEN 'order' ELSE 'other' END AS kind FROM {forms.TURNS})""",
    "heading_candidates": f"""SELECT doc_id, i - 1 AS line, kind FROM (SELECT doc_id, i, CASE WHEN length({_T}) < 4 OR length({_T}) > 80 THEN NULL WHEN regexp_matches({_T}, '^[A-Z][A-Z ]+$') THEN 'caps'
        WHEN regexp_matches({_T}, '^[0-9]+(\\.[0-9]+)*\\.? ') THEN 'numbered' WHEN len({_LW}) >= 2 AND len([w FOR w IN {_LW} IF regexp_matches(w, '^[A-Z]')]) / len({_LW}) >= 0.6 THEN 'title' END AS kind
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE kind IS NOT NULL""",
    "status_prefix": f"SELECT doc_id, CASE {_PRE} ELSE 'none' END AS status FROM documents",
    "corrective_route": """SELECT event_id, CASE WHEN value / 100 >= 0.7 THEN 'generate' WHEN value / 100 <= 0.3 THEN 'web' ELSE 'combine' END AS route,
        CAST(CASE WHEN value / 100 < 0.05 THEN 0.05 WHEN value / 100 < 0.25 THEN 0.25 WHEN value / 100 < 0.5 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS ramp FROM events""",
    "gold_rank": f"""WITH {_V}, {_S}, t AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cs) WHERE rank <= 10),
        g AS (SELECT query_id, MIN(rank) AS gold FROM t WHERE ql = label GROUP BY 1)
        SELECT vec_id AS query_id, gold, CASE WHEN gold IS NULL THEN 'unreachable' WHEN gold = 1 THEN 'easy' WHEN gold <= 5 THEN 'medium' ELSE 'hard' END AS difficulty,
        ROUND(COALESCE(1.0 / gold, 0), 6) AS mrr FROM v LEFT JOIN g ON g.query_id = vec_id WHERE vec_id % 20 = 0""",
    "relation_names": "SELECT p_partkey, COALESCE(NULLIF(trim(regexp_replace(substr(regexp_replace(upper(p_type), '[^A-Z_]', '_', 'g'), 1, 40), '_+', '_', 'g'), '_'), ''), 'RELATED_TO') AS rel FROM part",
    "answer_number": """SELECT doc_id, TRY_CAST(l[-1] AS DOUBLE) AS answer FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[$,%]', '', 'g'), '-?[0-9]+(?:[.][0-9]+)?') AS l FROM documents)""",
    "sample_sizes": "SELECT source, COUNT(*) AS n, CAST(LEAST(COUNT(*), 50, GREATEST(5, CEIL(COUNT(*) * 0.3))) AS BIGINT) AS q FROM documents GROUP BY 1",
    "normalised_lookup": """WITH d AS (SELECT doc_id, md5(lower(regexp_replace(regexp_replace(text, '[ \\t\\n]+', ' ', 'g'), '^ | $', '', 'g'))) AS k FROM documents),
        b AS (SELECT item_id, md5(lower(regexp_replace(regexp_replace(text, '[ \\t\\n]+', ' ', 'g'), '^ | $', '', 'g'))) AS k FROM benchmark)
        SELECT item_id, COUNT(doc_id) AS n, MIN(doc_id) AS first_doc FROM b LEFT JOIN d USING (k) GROUP BY 1""",
    "missing_labels": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
    "compression_ratio": f"SELECT lang, ROUND(AVG(len(list_distinct({_WORDS})) / GREATEST(len({_WORDS}), 1)), 6) AS ratio FROM documents GROUP BY 1",
    "best_arm": """SELECT day, event_type, m FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY day ORDER BY m DESC, event_type) AS r FROM
        (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, ROUND(AVG(value), 6) AS m FROM events GROUP BY 1, 2)) WHERE r = 1""",
    "weight_grid": """SELECT wa, wb, ROUND(AVG(CAST(o_totalprice / 250000 * wa + (o_custkey % 10) / 10 * wb > 1 AS INT)), 6) AS hit_rate
        FROM orders, (SELECT x / 2 AS wa, y / 2 AS wb FROM range(1, 4) a(x), range(1, 4) b(y)) GROUP BY 1, 2""",
    "seed_scores": """WITH n AS (SELECT o_custkey AS c_custkey, COUNT(*) AS deg FROM orders GROUP BY 1),
        s AS (SELECT c_custkey, c_nationkey, ROUND(CASE WHEN c_acctbal > 0 THEN 2.5 ELSE 0 END + CASE WHEN c_mktsegment = 'BUILDING' THEN 0.8 ELSE 0 END + 0.3 * LN(COALESCE(deg, 0) + 1), 6) AS score FROM customer LEFT JOIN n USING (c_custkey))
        SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY score DESC, c_custkey) AS rank FROM s WHERE score >= 2.0) WHERE rank <= 5""",
    "running_fifo": """SELECT conv_id, turn, role, CAST(held AS BIGINT) AS held FROM (SELECT conv_id, turn, role, SUM(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC ROWS UNBOUNDED PRECEDING) AS held FROM conversations) WHERE held <= 400""",
}
