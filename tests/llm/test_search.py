"""Near duplicates, BM25 search and nearest neighbours against brute force, with edge cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from siltstone.llm import ann, neardup, search

UP = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split(t):
    return [x for x in re.split(r"[\x20\x09-\x0d]+", (t or "").translate(UP)) if x]


def shingle_set(t):
    w = split(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(texts: dict):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts, n = {}, 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 90))]
        texts[n := n + 1] = " ".join(base)
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts[n := n + 1] = " \n".join(copy).upper()
    shared = " ".join(rng.choice(words) for _ in range(60))
    for i in range(10):
        texts[n := n + 1] = shared + " " + " ".join(f"own{i}x{j}" for j in range(30))
    return texts | {900: None, 901: "", 902: " \t\n", 903: "one", 904: "ONE", 905: "a b c d", 906: "z " * 40_000, 907: "é\u00a0x È", 908: "É\u00a0x È"}


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    texts = corpus()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("kept", F.lit("clash"))
    want = groups(texts)
    assert {r["doc_id"]: tuple(r)[1:] for r in neardup.detect(df).collect()} == want
    # buckets and groups that are split into blocks, and bins of few shingles, give the same
    for name, value in {"BUCKET": 2, "GROUP_SHINGLES": 120, "BIN_SHINGLES": 60, "PAIRS": 2}.items():
        monkeypatch.setattr(neardup, name, value)
    assert {r["doc_id"]: tuple(r)[1:] for r in neardup.detect(df).collect()} == want


def test_a_shared_template_makes_no_group(spark):
    """Documents that share a third of their shingles but are not linked are told apart before full sets are compared."""
    rng = random.Random(8)
    shared = " ".join(f"t{rng.randrange(900)}" for _ in range(70))
    rows = [(i, shared + " " + " ".join(f"w{rng.randrange(5000)}" for _ in range(72))) for i in range(600)]
    classes = neardup.classes_of(neardup.sketch(spark.createDataFrame(rows, "doc_id long, text string")))
    edges = neardup.likely(neardup.stored(classes, "classes"))
    assert edges.count() < 60
    assert neardup.detect(spark.createDataFrame(rows, "doc_id long, text string")).where("NOT kept").count() == 0


def test_near_duplicates_of_odd_tables(spark):
    one = "a b c d e f g h"
    df = spark.createDataFrame([(1, one), (1, one), (2, one), (None, one)], "doc_id long, text string")
    assert sorted(tuple(r) for r in neardup.detect(df).collect()) == [(1, 4, 1, True), (2, 4, 1, False)]
    assert neardup.detect(df.limit(0)).count() == 0


def test_links_of_a_chain_are_all_found():
    # each set shares three quarters with the next one only
    ids = np.arange(6)
    sets = [np.arange(i * 10, i * 10 + 80).astype(np.uint64) for i in range(6)]
    found = neardup.Group(ids, [x.tobytes() for x in sets]).links()
    assert found == [(0, i) for i in range(1, 6)]


def brute_bm25(texts: list, ask: list, k: int):
    """(doc, score) of the k best for each id to ask, of rows (id, text); ties to the smaller id."""
    counts = [(i, Counter(split(t))) for i, t in texts]
    n, mean = len(counts), max(sum(sum(c.values()) for _, c in counts), 1) / len(counts)
    df = Counter(w for _, c in counts for w in c)
    idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    out = {}
    for q in ask:
        own = {w for i, c in counts if i == q for w in c}
        s = []
        for i, c in counts:
            hit = own & c.keys()
            if i != q and hit:
                norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
                s.append((i, round(math.fsum(idf[w] * c[w] * 2.2 / (c[w] + norm) for w in hit), 8)))
        out[q] = sorted(s, key=lambda p: (-p[1], p[0]))[:k]
    return out


def found_by_search(df, ask, k):
    got = defaultdict(list)
    for r in search.search(df, ask, k=k).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], round(r["score"], 8)))
        assert r["rank"] == len(got[r["query_id"]])
    return got


@pytest.mark.parametrize(("shard", "block", "segment", "queries", "dense"), [(2048, 32, 8, 256, 200), (16, 2, 2, 3, 200), (50, 4, 3, 7, 0), (16, 2, 1, 5, 1 << 40)])
def test_best_matches_against_brute_force(spark, monkeypatch, shard, block, segment, queries, dense):
    for name, value in {"SHARD_DOCS": shard, "BLOCK_DOCS": block, "SEGMENT": segment, "QUERIES": queries, "DENSE": dense}.items():
        monkeypatch.setattr(search, name, value)
    rng = random.Random(1)
    words = [f"t{int(rng.paretovariate(0.7))}" for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(200)]
    # no text, copies (ties at every rank), a very long text, repeated ids
    rows += [(300, None), (301, ""), (302, " \t\n"), (304, "T1 " * 30_000), (0, "repeated t1"), (0, "repeated t1")]
    rows += [(i, rows[8][1]) for i in range(400, 420)]
    df = spark.createDataFrame([*rows, (None, "t1 t2")], "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    got = found_by_search(df, df.where("doc_id % 4 = 0"), 5)
    want = brute_bm25(rows, sorted({i for i, _ in rows if i % 4 == 0}), 5)
    assert {q: w for q, w in want.items() if w} == got


def test_registered_query_against_brute_force(spark):
    from siltstone.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = defaultdict(list)
    for r in queries.op6_best_matches(spark, "/root/testdata/sf0.001").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], round(r["score"], 8)))
    rows = [tuple(r) for r in docs]
    want = brute_bm25(rows, [i for i, _ in rows if i % 20 == 0], 10)
    assert got.keys() == {q for q, w in want.items() if w}
    for q, g in got.items():
        assert [s for _, s in g] == pytest.approx([s for _, s in want[q]], abs=3e-8)
        last = want[q][-1][1] + 3e-8  # copies whose scores differ by the order of addition may change places at the end
        assert {i for i, s in g if s > last} == {i for i, s in want[q] if s > last}


def test_block_maxima_skip_blocks():
    rng = np.random.default_rng(3)
    # two kinds of documents that share few terms
    kind = np.arange(2000) % 2
    sets = [np.unique(np.concatenate([rng.integers(k * 300, k * 300 + 300, 60), [1000 + k]])).astype(np.uint64) for k in kind]
    row = np.repeat(np.arange(2000), [len(x) for x in sets])
    terms, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    label = search.clusters(row, code, df, 2000)
    assert sum(max(np.bincount(kind[label == x])) for x in np.unique(label)) > 1800  # clusters are mostly of one kind
    order = np.argsort(kind, kind="stable")
    place = np.empty(2000, np.int64)
    place[order] = np.arange(2000)
    at = np.lexsort((place[row], code))

    class Asked:
        qids, wanted, n, idf = np.arange(0, 2000, 20), terms, df, np.log(1 + (2000 - df + 0.5) / (df + 0.5))
        bounds = np.concatenate([[0], np.cumsum([len(sets[i]) for i in range(0, 2000, 20)])])
        code = np.concatenate([np.searchsorted(terms, sets[i]) for i in range(0, 2000, 20)])

    shard = search.Shard(order, np.full(2000, 60), terms, df, place[row][at], np.ones(len(at), np.int64), Asked, 60.0)
    least = np.full(100, -1.0)
    shard.search(least, 10)
    before = shard.scored
    shard.search(least, 10)  # with the thresholds that the first walk has found
    assert shard.scored - before < 0.6 * shard.pairs / 2 and (least > 0).all()


def shard_of(sets: list, tfs: list, ask: list):
    """A shard of documents with these terms and term frequencies, and the queries asked of it: the terms of some documents."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    terms, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    at = np.lexsort((row, code))

    class Asked:
        qids, wanted, n, idf = np.array(ask), terms, df, np.log(1 + (len(sets) - df + 0.5) / (df + 0.5))
        bounds = np.concatenate([[0], np.cumsum([len(sets[i]) for i in ask])])
        code = np.concatenate([np.searchsorted(terms, sets[i]) for i in ask])

    return search.Shard(np.arange(len(sets)), np.array([x.sum() for x in tfs]), terms, df, row[at], np.concatenate(tfs)[at], Asked, 60.0)


@pytest.mark.parametrize(("block", "segment", "queries", "dense", "postings"), [(64, 4, 1024, 200, 1 << 20), (4, 2, 7, 200, 64), (8, 1, 30, 0, 16), (16, 3, 5, 1 << 40, 16)])
def test_a_shard_finds_the_best_by_matrix_and_by_postings(monkeypatch, block, segment, queries, dense, postings):
    for name, value in {"BLOCK_DOCS": block, "SEGMENT": segment, "QUERIES": queries, "DENSE": dense, "POSTINGS": postings}.items():
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.zipf(1.3, rng.integers(1, 200)) % 3000).astype(np.uint64) for _ in range(300)]
    sets[7] = sets[8] = sets[90]  # ties
    tfs = [rng.integers(1, 4, len(x)) for x in sets]
    tfs[7] = tfs[8] = tfs[90]
    ask = list(range(0, 300, 5))
    shard = shard_of(sets, tfs, ask)
    got = defaultdict(list)
    for q, i, s in zip(*shard.search(np.full(len(ask), -1.0), 6), strict=True):
        got[ask[q]].append((i, round(s, 9)))
    df = Counter(int(t) for x in sets for t in x)
    for q in ask:
        want = []
        for i, (x, tf) in enumerate(zip(sets, tfs, strict=True)):
            norm = 1.2 * (0.25 + 0.75 * tf.sum() / 60.0)
            s = sum(math.log(1 + (300 - df[int(t)] + 0.5) / (df[int(t)] + 0.5)) * f * 2.2 / (f + norm) for t, f in zip(x, tf, strict=True) if t in sets[q])
            want += [(i, round(float(s), 9))] * int(i != q and s > 0)
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in sorted(want, key=lambda p: (-p[1], p[0]))[:6]], abs=2e-9)
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0])) and all(dict(want)[i] == pytest.approx(s, abs=2e-9) for i, s in got[q])


def test_few_pairs_are_scored_again_when_later_documents_are_better():
    """Documents of growing length are each better than those before: only what reaches the last threshold is scored again."""
    sets = [np.arange(20 + i // 2).astype(np.uint64) for i in range(1000)]
    shard = shard_of(sets, [np.ones(len(x), np.int64) for x in sets], list(range(0, 1000, 20)))
    again = sum(len(q) for pairs in shard.candidates(np.full(50, -1.0), 10) for q, *_ in pairs)
    assert 50 * 10 <= again < 50 * 40


def test_a_query_is_its_whole_text(spark):
    rare = [f"rare{i}" for i in range(20)]
    rows = [(0, " ".join([*(rare * 3), "common", "usual"])), (1, "common"), (2, "usual usual"), (3, "other"), (4, "common usual")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = found_by_search(df, df.where("doc_id = 0"), 5)
    assert [i for i, _ in got[0]] == [4, 2, 1]
    assert got == brute_bm25(rows, [0], 5)


def test_search_groups_and_empty_tables(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"apple pear {i} plum") for i in range(30)], "doc_id long, text string")
    one = sorted(map(tuple, search.search(df, df, k=3).collect()))
    monkeypatch.setattr(search, "GROUP", 7)
    monkeypatch.setattr(search, "SHARD_DOCS", 2)
    assert sorted(map(tuple, search.search(df, df, k=3).collect())) == one
    assert search.search(df, df.limit(0)).count() == 0
    assert search.search(df.limit(0), df.limit(0)).count() == 0


def vectors(spark, n=1500, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16)) * 3
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 16))
    return x, [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]


def test_neighbours_recall_and_measure(spark):
    x, rows = vectors(spark)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    router = ann.fit(df, n_parts=8, epochs=15)
    assert router.n_parts == 8
    got = ann.search(df, df.where("vec_id % 10 = 0"), router).collect()
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    hits, total = 0, 0
    by = defaultdict(list)
    for r in got:
        assert r["score"] == pytest.approx(np.sqrt(((x[r["query_id"]] - x[r["vec_id"]]) ** 2).sum()), rel=1e-12)
        by[r["query_id"]].append(r["vec_id"])
    for q in range(0, 1500, 10):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10]) & set(by[q]))
        total += 10
    assert hits / total >= 0.9
    sizes = np.bincount(router.logits(x).argmax(1), minlength=8)
    assert sizes.max() < 3 * sizes.mean()


def test_neighbours_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_BYTES", 48)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(8)] + [(20, [0.0, 2.0]), (21, None), (22, [0.0, 0.0]), (23, [nan, 1.0]), (24, [inf, 1.0]), (25, [None, 1.0]), (26, [1.0]), (27, []), (28, [4.0]), (None, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    router = ann.fit(df)
    got = ann.search(df, df, router, k=3).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in got} == {*range(8), 20, 26, 28}
    assert [r["vec_id"] for r in got if r["query_id"] == 0] == [1, 2, 3]
    assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 20][0] == (0, pytest.approx(math.sqrt(5)))
    # another length than the commonest: compared among themselves
    assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 26] == [(28, 3.0)]
    assert ann.search(df.limit(0), df.limit(0), ann.fit(df.limit(0))).count() == 0


def test_repeated_rows_are_candidates_of_their_own(spark):
    rows = [(0, [1.0, 1.0]), (0, [1.0, 1.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id = 0"), ann.fit(df), k=3).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 1), (2, 1), (3, 2)]


@pytest.mark.parametrize(("offset", "spread"), [(1e6, 1e-2), (0, 1e160), (1e155, 1e150), (0, 1e-200)])
def test_neighbours_are_exact_at_any_offset_and_size(offset, spread):
    rng = np.random.default_rng(6)
    x = offset + rng.normal(size=(400, 8)) * spread
    ids = np.arange(400)
    got = ann.nearest(x, ids, x[:40], ids[:40], 5)
    for q in range(40):
        exact = [math.hypot(*(x[i] - x[q])) if i != q else math.inf for i in ids]
        want = sorted(ids, key=lambda i: (exact[i], i))[:5]
        mine = [(i, s) for a, i, s in got if a == q]
        assert [i for i, _ in mine] == want
        assert [s for _, s in mine] == pytest.approx([exact[i] for i in want], rel=1e-12)


def test_whole_search_at_an_offset(spark):
    x, _ = vectors(spark, 1200)
    rows = [(i, [float(v) for v in 1e6 + 1e-2 * row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    y = np.array([r[1] for r in rows])
    got = defaultdict(set)
    for r in ann.search(df, df.where("vec_id % 20 = 0"), ann.fit(df, n_parts=8, epochs=15)).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(0, 1200, 20):
        d = ((y - y[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10]))
    assert hits / 600 >= 0.9


def test_registered_neighbours_against_brute_force(spark):
    from siltstone.llm import queries

    path = "/root/testdata/sf0.01"
    t = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in t]), np.array([r[1] for r in t], np.float64)
    got = defaultdict(list)
    for r in queries.op10_partitions(spark, path).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        for i, s in got[ids[q]]:
            assert s == pytest.approx(d[ids == i][0], rel=1e-12)
        d[q] = np.inf
        hits += len({i for i, _ in got[ids[q]]} & set(ids[np.argsort(d, kind="stable")[:10]]))
        total += 10
    assert hits / total >= 0.9


def test_bisection_is_balanced():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    part = ann.bisect(ann.neighbours(x, x, 6)[:, 1:], np.arange(400), 3, rng)
    assert set(np.bincount(part)) == {50}


def test_words_that_collide_modulo_powers_of_two(spark):
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    found = {r.doc_id: r for r in neardup.detect(spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")).collect()}
    assert [found[i].component_id for i in (1, 2, 3)] == [1, 2, 1]
    assert [found[i].kept for i in (1, 2, 3)] == [True, True, False]


def test_queries_of_one_id_have_one_answer(spark):
    rows = [(i, [float(i % 7), float(i), 1.0]) for i in range(1, 40)]
    twice = [(100, [1.0, 5.0, 1.0]), (100, [1.0, 30.0, 1.0])]
    answers = []
    for asked in (twice, twice[::-1]):
        df = spark.createDataFrame(rows + asked, "vec_id long, embedding array<double>")
        q = df.where("vec_id = 100")
        answers.append(sorted(tuple(r) for r in ann.search(df, q, ann.fit(df), k=3).collect()))
    assert answers[0] == answers[1] and len(answers[0]) == 3
    want = sorted((math.dist(v, [1.0, 5.0, 1.0]), i) for i, v in rows)[:3]
    assert [(r[2]) for r in answers[0]] == [i for _, i in want]
