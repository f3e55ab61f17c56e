"""Searches by shared terms against plain loops: odd texts, ties, blocks of queries, dense and rare terms."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions.text import words
from siltstone.operators import lexical, retrieval


def rounded(x):
    return math.floor(x * 1e6 + 0.5) / 1e6


def brute(docs, queries, k):
    tf = {i: collections.Counter(t.split()) for i, t in docs if t is not None}
    n, mean = len(docs), sum(sum(c.values()) for c in tf.values()) / len(tf)
    df = collections.Counter(w for c in tf.values() for w in c)
    out = {}
    for kind in ("bm25", "cosine", "dot"):
        rows = []
        for q, text in queries:
            asked, found = collections.Counter((text or "").split()), []
            for d, c in tf.items():
                both = [w for w in asked if w in c]
                if not both:
                    continue
                if kind == "bm25":
                    s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in both)
                elif kind == "cosine":
                    s = sum(c[w] * asked[w] for w in both) / math.sqrt(sum(x * x for x in c.values())) / math.sqrt(sum(x * x for x in asked.values()))
                else:
                    s = sum(rounded(math.log1p(c[w])) * rounded(math.log1p(asked[w])) for w in both)
                found.append((-rounded(s), d))
            rows += [(q, d, i + 1, -s) for i, (s, d) in enumerate(sorted(found)[:k])]
        out[kind] = sorted(rows)
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(200)]
    make = lambda n: " ".join(vocabulary[min(int(rng.paretovariate(0.6)) - 1, 199)] for _ in range(n))
    docs = [(i, make(rng.randint(1, 40))) for i in range(400)] + [(400 + i, "w1 w2 w3") for i in range(60)] + [(500, None), (501, ""), (502, "--")]
    return docs, [(i, make(rng.randint(1, 15))) for i in range(40)] + [(40, None), (41, "zzz"), (42, "w1 w2 w3")]


@pytest.mark.parametrize("block", [20_000, 9])
def test_search(spark, texts, block, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_BLOCK", block)
    docs, queries = (spark.createDataFrame(t, "id long, text string") for t in texts)
    got = lexical.search(docs, queries.withColumnRenamed("id", "q"), "id", "q", words(), words(), {"bm25": 7, "cosine": 7, "dot": 7})
    want = brute([(i, t if t != "--" else "") for i, t in texts[0]], texts[1], 7)
    for kind, df in got.items():
        assert sorted((r["q"], r["id"], r["rank"]) for r in df.collect()) == [x[:3] for x in want[kind]]
        assert sorted(r["score"] for r in df.collect()) == pytest.approx(sorted(x[3] for x in want[kind]), abs=1.1e-6)


def test_postings_stay_where_they_are(spark, texts):
    """The best of each query alone are shuffled: no join of postings, and no aggregate of pairs."""
    docs = spark.createDataFrame(texts[0], "id long, text string")
    block = lexical.Block(spark.createDataFrame([(1, "w1", 1), (2, "w2", 1)], "k long, term string, tf long").toArrow())
    rows = lexical.postings(lexical.tokens_of(docs, "id", words()), block.terms)
    plan = lexical.best(rows, block, 3, lambda tf, length, norm: tf, 2)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Aggregate" not in plan


def test_sparse_vectors_do_not_answer_themselves(spark):
    rows = spark.createDataFrame([(1, {3: 1.0, 9: 2.0}), (2, {3: 1.0}), (3, {9: 1.0}), (4, {5: 1.0}), (6, {})], "id int, v map<int,double>")
    got = retrieval.sparse_top_k(rows, rows.where(F.col("id") < 3), "id", "v", 2, 10).collect()
    assert sorted((r["query_id"], r["id"], r["rank"], r["score"]) for r in got) == [(1, 2, 2, 1.0), (1, 3, 1, 2.0), (2, 1, 1, 1.0)]


@pytest.mark.parametrize("block", [20_000, 9])
def test_best_cosine_of_rows_without_keys(spark, texts, block, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_BLOCK", block)
    docs, queries = (spark.createDataFrame(t, "id long, text string") for t in texts)
    out = lexical.with_best_cosine(docs.select("text"), queries, "id", words(), words(), "best")
    assert "Join" not in out._jdf.queryExecution().toString() and "Exchange" not in out._jdf.queryExecution().toString()
    got = sorted((r["text"] or "", r["best"] or 0.0) for r in out.collect())
    tf = lambda t: collections.Counter((t or "").split())
    cos = lambda a, b: sum(a[w] * b[w] for w in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())) if a and b else 0.0
    asked = [tf(q) for _, q in texts[1]]
    want = sorted((t or "", max(cos(tf(t if t != "--" else ""), q) for q in asked)) for _, t in texts[0])
    assert [x[0] for x in got] == [x[0] for x in want] and [x[1] for x in got] == pytest.approx([x[1] for x in want])
