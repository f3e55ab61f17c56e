"""Significance, planning, entity lookup, containment, tree order, grounding and positions, against plain versions."""

import random
from collections import defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F
from siltstone.operators import containment, entities, graph, grounding, planning, ranking, significance


def test_randomisation_against_all_flips(spark):
    rng = random.Random(3)
    a, b, c = ([round(rng.random(), 3) for _ in range(9)] for _ in range(3))
    b = [min(1.0, x + 0.4) for x in b]
    rows = [(r, q, s) for r, own in (("a", a), ("b", b), ("c", c)) for q, s in enumerate(own)]
    rows += [("a", 99, 0.3), ("d", 0, None)]  # a query of one run alone, a run without a score
    found = {(r.run_a, r.run_b): r for r in significance.randomisation_test(spark.createDataFrame(rows, "run string, query long, score double"), flips=6000).collect()}
    assert set(found) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (x, y), r in found.items():
        d = [round(u * 1e6) - round(v * 1e6) for u, v in zip({"a": a, "b": b}[x], {"b": b, "c": c}[y], strict=True)]
        all_flips = [abs(sum(s * v for s, v in zip(signs, d, strict=True))) >= abs(sum(d)) for signs in product((1, -1), repeat=9)]
        assert r.n == 9 and r.mean_diff == pytest.approx(sum(d) / 9e6, abs=1e-6)
        assert r.p == pytest.approx(sum(all_flips) / 512, abs=0.02)


def test_equal_runs_differ_by_chance(spark):
    rows = [(r, q, q / 10) for r in "ab" for q in range(6)]
    assert significance.randomisation_test(spark.createDataFrame(rows, "run string, query long, score double")).first().p == 1.0


def queue(plan):
    """Kahn's queue over [(node, deps)], residual steps at the end."""
    ready, out = [n for n, d in plan if not d], []
    while ready:
        out.append(ready.pop(0))
        ready += [n for n, d in plan if n not in out and n not in ready and set(d) <= set(out)]
    return out + [n for n, _ in plan if n not in out]


def inherited(plan, order, hits):
    deps, found = dict(plan), {}
    for n in order:
        found[n] = list(dict.fromkeys(h for d in deps[n] for h in found.get(d, []))) if deps[n] else hits[n]
    return found


def test_plans_against_a_queue(spark):
    rng = random.Random(4)
    plans, nodes, deps, hits = {}, [], [], []
    for p in range(25):
        n = rng.randint(1, 9)
        plan = [(i, sorted(rng.sample(range(n + 1), rng.randint(0, min(3, n))), key=lambda _: rng.random()) if rng.random() < 0.6 else []) for i in range(n)]
        plan = [(i, [d for d in ds if d != i or rng.random() < 0.2]) for i, ds in plan]
        plans[p] = plan
        own = {i: [rng.randrange(12) for _ in range(rng.randint(0, 4))] for i, ds in plan if not ds}
        own = {i: list(dict.fromkeys(h)) for i, h in own.items()}
        nodes += [(p, i, i, "synthesis" if ds else "lookup") for i, ds in plan]
        deps += [(p, i, d, k) for i, ds in plan for k, d in enumerate(ds)]
        hits += [(p, i, k + 1, h) for i, l in own.items() for k, h in enumerate(l)]
        plans[p] = (plan, own)
    node_df, dep_df = spark.createDataFrame(nodes, "plan int, node int, seq int, kind string"), spark.createDataFrame(deps, "plan int, node int, dep int, dep_seq int")
    ordered = planning.execution_order(node_df, dep_df)
    found = defaultdict(dict)
    for r in ordered.collect():
        found[r.plan][r.pos] = r.node
    for p, (plan, _) in plans.items():
        assert [found[p][i] for i in range(len(plan))] == queue(plan)
    evidence = planning.gathered(ordered, dep_df, spark.createDataFrame(hits, "plan int, node int, rank int, doc int"))
    got = defaultdict(list)
    for r in sorted(evidence.collect(), key=lambda r: r.place):
        got[r.plan, r.node].append(r.doc)
    union = defaultdict(list)
    for r in sorted(planning.union_of(ordered, evidence).collect(), key=lambda r: r.seen):
        union[r.plan].append(r.doc)
    for p, (plan, own) in plans.items():
        order = queue(plan)
        want = inherited(plan, order, own)
        assert {i: got[p, i] for i, _ in plan} == want
        assert union[p] == list(dict.fromkeys(h for n in order for h in want[n]))


def test_plans_of_cycles_alone(spark):
    nodes = spark.createDataFrame([(1, 5, 0, "synthesis"), (1, 3, 1, "synthesis")], "plan int, node int, seq int, kind string")
    deps = spark.createDataFrame([(1, 5, 3, 0), (1, 3, 5, 0)], "plan int, node int, dep int, dep_seq int")
    assert {r.node: r.pos for r in planning.execution_order(nodes, deps).collect()} == {5: 0, 3: 1}


def test_entity_tiers(spark):
    index = spark.createDataFrame([("Coca-Cola", 1), ("Coca-Cola", 2), ("Cola Nut", 3), ("New York", 4), ("York", 2), ("IBM", 5)], "entity string, node long")
    asked = spark.createDataFrame([("a", "COCA-COLA"), ("b", "ola"), ("c", "what of york, york and cola?"), ("d", "or"), ("e", "xyz"), ("f", "  "), ("g", "of a"), ("h", None)], "id string, q string")
    got = {(r.id, r.node): (r.tier, r.n) for r in entities.find_nodes(index, asked, "id", "q").collect()}
    assert got == {
        ("a", 1): (1, 1), ("a", 2): (1, 1), ("b", 1): (2, 1), ("b", 2): (2, 1), ("b", 3): (2, 1),
        # york counts twice, once for each time it is asked; node 2 holds Coca-Cola and York
        ("c", 2): (3, 3), ("c", 4): (3, 2), ("c", 1): (3, 1), ("c", 3): (3, 1), ("d", 4): (2, 1), ("d", 2): (2, 1),
    }
    assert entities.find_nodes(index.limit(0), asked, "id", "q").count() == 0


def test_entity_lookup_against_all_pairs(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abc ") for _ in range(rng.randint(1, 7)))
    names, parts = {word() for _ in range(60)}, {word()[:4] for _ in range(80)} | {""}
    got = entities.containing(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(p,) for p in parts], "part string"))
    assert {tuple(r) for r in got.select("part", "name").collect()} == {(p, n) for p in parts for n in names if p and p in n}


@pytest.mark.parametrize("block", [40, 8 << 20])
def test_containment_against_all_pairs(spark, block, monkeypatch):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("ab  \nÉ") for _ in range(n))
    a = [(i, text(rng.randint(0, 5))) for i in range(40)] + [(90, None), (91, "A  b"), (92, "a b")]
    b = [(i, text(rng.randint(0, 30))) for i in range(40)] + [(93, " a B "), (94, "a b\tc")]
    norm = lambda t: " ".join(t.replace("\n", " ").replace("\t", " ").split(" ")).lower().split()
    fold = lambda rows: {k: (min(i for i, t in rows if t and " ".join(norm(t)) == k), sum(1 for _, t in rows if t and " ".join(norm(t)) == k)) for k in {" ".join(norm(t)) for _, t in rows if t} - {""}}
    x, y = fold(a), fold(b)
    want = {(x[s][0], x[s][1], y[t][0], y[t][1], "equal" if s == t else "x inside" if s in t else "y inside") for s in x for t in y if s in t or t in s}
    original = containment.contained
    monkeypatch.setattr(containment, "contained", lambda *args: original(*args, block_bytes=block))
    dfs = spark.createDataFrame(a, "x long, text string"), spark.createDataFrame(b, "y long, text string")
    assert {tuple(r) for r in containment.either_way(*dfs, "x", "y").collect()} == want
    assert containment.either_way(dfs[0].limit(0), dfs[1], "x", "y").count() == 0


@pytest.mark.parametrize("last_first", [False, True])
def test_preorder_against_a_stack(spark, last_first):
    rng = random.Random(6)
    parent = {i: rng.randrange(i) if i and rng.random() < 0.9 else None for i in range(120)}
    rows = [(i, p, rng.randrange(10_000)) for i, p in parent.items()]
    seq = {i: s for i, _, s in rows}
    assert len(set(seq.values())) > 100
    below = defaultdict(list)
    for i, p in parent.items():
        below[p].append(i)

    def walk(n, depth):
        yield n, depth
        for c in sorted(below[n], key=lambda i: (-seq[i] if last_first else seq[i], i)):
            yield from walk(c, depth + 1)

    found = {r.node: (r.root, r.place, r.depth) for r in graph.preorder(spark.createDataFrame(rows, "node long, parent long, seq int"), last_first).collect()}
    assert found == {n: (root, k, d) for root in below[None] for k, (n, d) in enumerate(walk(root, 0))}


def test_positions_of_a_hot_group(spark):
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else f"g{i % 5}", i * 37 % 1001) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(9)
    placed, sizes = ranking.positions(df, ["g"], [F.desc("v")])
    by = defaultdict(list)
    for g, v in rows:
        by[g].append(v)
    assert {r.g: r.n for r in sizes.collect()} == {g: len(v) for g, v in by.items()}
    got = defaultdict(dict)
    for r in placed.collect():
        got[r.g][r.place] = r.v
    assert {g: [p[i] for i in range(len(p))] for g, p in got.items()} == {g: sorted(v, reverse=True) for g, v in by.items()}
    assert ranking.positions(df.limit(0), ["g"], ["v"])[0].count() == 0


def test_grounding(spark):
    passages = ["The river Ñandú is long and blue", "Trade grew by 5 percent in 2020"]
    answer = "- the ÑANDÚ river is blue [#1]\n- nothing shared here [#2]\n\n  no citation \n- beyond [#7] and [#1]\nof the [#1]"
    df = spark.createDataFrame([(answer, passages, "Is the river blue?"), (None, passages, ""), ("a [#1]", [], "a")], "a string, p array<string>, q string")
    stop = ["the", "of", "is"]
    kept = [r.k for r in df.select(grounding.undrifted(F.col("a"), F.col("p"), stop).alias("k")).collect()]
    assert kept == [["- the ÑANDÚ river is blue [#1]", "no citation", "- beyond [#7] and [#1]"], [], ["a [#1]"]]
    rates = [tuple(r.r) for r in df.select(grounding.rates(F.col("a"), F.col("p"), F.col("q"), stop).alias("r")).collect()]
    assert rates == [(0.8, 0.2, 1.0, round(2 / 3, 3), False), (0.0, 0.0, 0.0, 0.0, False), (1.0, 0.0, 1.0, 0.667, False)]


def test_context_coverage(spark):
    df = spark.createDataFrame([(["Alpha", "beta"], ["alpha", "BETA", "gamma", "a\nb"]), ([], ["x"]), (["x"], [])], "c array<string>, e array<string>")
    assert [r.v for r in df.select(grounding.context_coverage(F.col("c"), F.col("e")).alias("v")).collect()] == [0.75, 0.0, 0.0]
