"""Reranking, sparse vectors, canonical JSON, redirects: against plain versions and hand-made cases."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from siltstone.functions import canonical, sparse
from siltstone.functions.text import words
from siltstone.operators import graph, rerank

CANDIDATES = "q long, d long, rank int, query string, text string"


def test_pair_slot_meets_the_native_scorer(spark):
    from siltstone.plans.stages import _jaccard

    rng = random.Random(1)
    text = lambda: " ".join(rng.choice("a b c d e".split()) for _ in range(rng.randint(0, 6)))
    rows = [(q, d, d + 1, f"{text()}", text()) for q in range(12) for d in range(9)] + [(99, 1, 1, None, "a"), (99, 2, 2, "a", "a")]
    df = spark.createDataFrame(rows, CANDIDATES)
    slot = rerank.rerank(df, "q", "d", rerank.pair_slot(_jaccard, batch=7)(F.col("query"), F.col("text")))
    native = rerank.rerank(df, "q", "d", rerank.overlap(F.col("query"), F.col("text")))
    a, b = ({tuple(r) for r in x.where("q < 99").collect()} for x in (slot, native))
    assert a == b and len(a) == 108
    assert [r.d for r in slot.where("q = 99").orderBy("rank").collect()] == [2, 1]
    for q in range(12):
        own = sorted((r for r in a if r[0] == q), key=lambda r: r[-1])
        assert [r[3] for r in own] == sorted((r[3] for r in own), reverse=True)
        assert all(x[2] < y[2] for x, y in zip(own, own[1:], strict=False) if x[3] == y[3])


def test_pair_slot_fills_batches_across_queries(spark):
    seen = spark.sparkContext.accumulator(0)

    def setup():
        def score(queries, texts):
            seen.add(1)
            return np.ones(len(queries))

        return score

    df = spark.createDataFrame([(q, 1, 1, "a", "b") for q in range(64)], CANDIDATES).coalesce(1)
    assert rerank.rerank(df, "q", "d", rerank.pair_slot(setup, batch=32)(F.col("query"), F.col("text")), 1).count() == 64
    assert seen.value == 2


def test_sparse_vectors(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "b")], "id long, text string")
    rows = sparse.encode(docs, "id", words())
    got = {r.id: r.sparse for r in rows.collect()}
    assert sorted(got[1].values()) == [round(math.log(2), 6), round(math.log(3), 6)] and not got[2] and not got[3]
    nnz, total = sparse.signature("sparse")
    assert {r.id: (r.n, r.t) for r in rows.select("id", nnz.alias("n"), total.alias("t")).collect()}[1] == (2, round(math.log(2) + math.log(3), 6))
    sparse.save_json(rows, "id", "sparse", f"{tmp_path}/s")
    assert {r.id: r.sparse or {} for r in sparse.load_json(spark, f"{tmp_path}/s", "id").collect()} == {k: v or {} for k, v in got.items()}


def test_collections(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 2.0], {3: 0.5}), (2, [0.0, 1.0], {})], "id long, v array<double>, sparse map<int,double>")
    hybrid = sparse.Collection(f"{tmp_path}/h", 2, hybrid=True)
    assert sparse.create(rows, hybrid, "id", "v") == 2
    assert sparse.create(rows.limit(1), hybrid, "id", "v", replace=False) == 2
    assert sparse.create(rows.limit(1), hybrid, "id", "v") == 1
    with pytest.raises(ValueError, match="no sparse vectors"):
        sparse.create(rows.drop("sparse"), hybrid, "id", "v")
    with pytest.raises(Exception, match="not of 3 numbers"):
        sparse.create(rows, sparse.Collection(f"{tmp_path}/d", 3), "id", "v")
    assert sparse.copy(spark, hybrid.path, f"{tmp_path}/c") == 1


def test_canonical_json(spark):
    cases = ['{"b": 1, "a": {"d": [ {"z":1,"y":2}, 3 ], "c": null}}', '{"a":{"c":null,"d":[{"y":2,"z":1},3]},"b":1}', "[]", '"é \\u00e9"', "nope", None, '{"A":1,"a":2,"B":3}']
    got = [r.c for r in spark.createDataFrame(list(enumerate(cases)), "i int, t string").orderBy("i").select(canonical.canonical(F.col("t")).alias("c")).collect()]
    plain = lambda t: json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert got[0] == got[1] == plain(cases[0])
    assert got[2:4] == ["[]", plain(cases[3])] and got[4:6] == [None, None] and got[6] == plain(cases[6])


def test_redirects(spark):
    rng = random.Random(5)
    links = {f"n{i}": f"n{rng.randrange(i + 1, 60)}" for i in range(50) if rng.random() < 0.9} | {"x": "y", "y": "z", "z": "x", "in": "x", "self": "self"}
    links |= {f"c{i}": f"c{i + 1}" for i in range(33)}
    df = spark.createDataFrame([*links.items(), ("n1", "zzz"), (None, "n1")], "from string, to string")

    def end(name):
        seen = set()
        while name in links and links[name] != name:
            if name in seen:
                return None
            seen.add(name)
            name = links[name]
        return name

    found = {r["from"]: r["to"] for r in graph.resolved(df).collect()}
    assert found == {n: end(n) for n in links if n != "self" and end(n) is not None}
    titles = spark.createDataFrame([("c0",), ("c5",), ("lone",), ("lost",)], "title string")
    views = spark.createDataFrame([("c0", 3), ("c33", 4), ("lone", 5)], "title string, views long")
    out = {r.title: (r.final, r.views) for r in graph.views_of(titles, spark.createDataFrame([*found.items(), ("lost", "nowhere")], "from string, to string"), views).collect()}
    assert out["c0"][0] == "c33" and out["lone"] == ("lone", 5) and out["lost"] == ("nowhere", 0)
    assert graph.resolved(df.limit(0)).count() == 0
