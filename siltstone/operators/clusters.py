"""Clustering with a silhouette choice of k, and greedy near-duplicate removal."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from siltstone.session import shared_path, ship, stored


#: Passes of a fit and the way that a centre still moves when it counts as settled, as `KMeans` has them; rows of a product.
PASSES, SETTLED, LLOYD_ROWS = 20, 1e-4, 4096
FITS = 4  # that run side by side


def _lloyd(data: DataFrame, vector: str, starts: list[np.ndarray]) -> list[float]:
    """Costs that k-means from each of the starts ends with, as `KMeans` counts them: those of the last pass's centres.

    All fits take each pass over the rows together. A pass gives the sums, sizes and cost of each fit; a fit that has
    settled takes part in no more of them.
    """
    spark = data.sparkSession
    centres, costs, moving = [c.copy() for c in starts], [np.inf] * len(starts), list(range(len(starts)))
    for _ in range(PASSES):
        if not moving:
            break
        shared = spark.sparkContext.broadcast([centres[i] for i in moving])

        def run(batches, shared=shared, dim=centres[0].shape[1]):
            own = shared.value
            flat, cuts = np.concatenate(own), np.cumsum([0, *map(len, own)])
            sums, size, cost = np.zeros_like(flat), np.zeros(len(flat)), np.zeros(len(own))
            half = (flat**2).sum(1) / 2
            for batch in batches:
                values = batch.column(0).flatten().to_numpy().reshape(-1, dim)
                for y in range(0, len(values), LLOYD_ROWS):
                    x = values[y : y + LLOYD_ROWS]
                    away, norm = half - x @ flat.T, (x**2).sum(1)
                    chosen = np.zeros_like(away)
                    for f, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        nearest = away[:, i:j].argmin(1)
                        chosen[np.arange(len(x)), nearest + i] = 1
                        cost[f] += np.maximum(norm + 2 * away[np.arange(len(x)), nearest + i], 0).sum()
                    sums += chosen.T @ x
                    size += chosen.sum(0)
            parts = [np.append(np.column_stack([sums[i:j], size[i:j]]), cost[f]) for f, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own))), pa.array([p.tolist() for p in parts], pa.list_(pa.float64()))], names=["fit", "part"])

        def total(parts: pa.Table) -> pa.Table:
            every = parts.column("part").combine_chunks().flatten().to_numpy().reshape(parts.num_rows, -1).sum(0)
            return pa.table({"fit": parts.column("fit").slice(0, 1), "part": pa.array([every.tolist()], pa.list_(pa.float64()))})

        kind = "fit long, part array<double>"
        got = data.select(vector).mapInArrow(run, kind).groupBy("fit").applyInArrow(total, kind).toArrow()  # a row a fit
        still = []
        for f, part in zip(got.column("fit").to_pylist(), got.column("part").to_pylist(), strict=True):
            i, (*body, costs[moving[f]]) = moving[f], part
            body = np.array(body).reshape(len(centres[i]), -1)
            some = body[:, -1] > 0  # a centre without rows stays
            was, centres[i] = centres[i], np.where(some[:, None], body[:, :-1] / np.maximum(body[:, -1:], 1), centres[i])
            if ((centres[i] - was) ** 2).sum(1).max() > SETTLED**2:
                still.append(i)
        moving = sorted(still)
        shared.destroy()
    return costs


def auto_k(df: DataFrame, vector: str, ks: range, least_gain: float = 0.01, seed: int = 42, restarts: int = 10):
    """(k, silhouette by k, model): a larger k wins only if it beats the best so far by more than `least_gain`.

    For each k the model of least cost among `restarts` seeded fits counts. `KMeans` draws the first centres of each; the
    passes of all fits are made together, and only the best start of each k is then fitted by `KMeans`.
    """
    ship(df.sparkSession)
    data = df.select(F.col(vector).cast("array<double>").alias("_x")).withColumn("_v", array_to_vector("_x")).persist()
    judge = ClusteringEvaluator(featuresCol="_v", predictionCol="cluster", distanceMeasure="cosine")
    fits = [(k, KMeans(k=k, seed=seed + i, featuresCol="_v", predictionCol="cluster", maxIter=0)) for k in ks for i in range(restarts)]
    rows = data.select(F.col("_v").alias("_v"))  # no cached table itself, so that each fit keeps what it makes of the rows
    within = inheritable_thread_target(df.sparkSession)
    with ThreadPoolExecutor(FITS) as pool:  # as the tuning of Spark ML does
        starts = [r.result() for r in [pool.submit(within(f.fit), rows) for _, f in fits]]
        costs = _lloyd(data, "_x", [np.array(m.clusterCenters()) for m in starts])
        least = [min(((c, f) for c, (of, f) in zip(costs, fits, strict=True) if of == k), key=lambda x: x[0])[1] for k in ks]
        models = [r.result() for r in [pool.submit(within(f.fit), rows, {f.maxIter: PASSES}) for f in least]]
    best, seen = None, {}
    for k, model in zip(ks, models, strict=True):
        seen[k] = judge.evaluate(model.transform(data))
        if best is None or seen[k] > seen[best[0]] + least_gain:
            best = (k, model)
    data.unpersist()
    return best[0], seen, best[1]


#: Rows whose vectors are broadcast at once; terms of the dense part of a vector; groups that its other terms are hashed to.
VECTOR_BLOCK, DENSE_TERMS, TERM_GROUPS = 8_000, 512, 512


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


class _Vectors:
    """Term vectors of some rows: keys, bounds, term hashes in order, counts, norms."""

    def __init__(self, keys, terms, counts):
        self.keys, self.terms, self.counts = keys.to_numpy(), terms.flatten().to_numpy(), counts.flatten().to_numpy()
        self.n = terms.value_lengths().to_numpy().astype(np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.row = np.repeat(np.arange(len(self.keys)), self.n)
        self.norm = np.sqrt(np.bincount(self.row, self.counts.astype(float) ** 2, len(self.keys)))

    def number(self) -> None:
        """Numbers the terms: `known` in order, and `code` of each term of a row."""
        self.known, self.code = np.unique(self.terms, return_inverse=True)

    def top(self) -> np.ndarray:
        self.number()
        terms = self.known
        mass = np.bincount(self.code, (self.counts / self.norm[self.row]) ** 2)
        return np.sort(terms[np.argsort(-mass)[:DENSE_TERMS]])

    def dense(self, top: np.ndarray) -> np.ndarray:
        """The unit vectors' parts over the top terms, and the norms of what each group of other terms holds.

        The product of two such rows is no less than the cosine: in each group that of the norms bounds that of the parts.
        """
        place = np.minimum(np.searchsorted(top, self.terms), len(top) - 1)
        hit = top[place] == self.terms
        unit = self.counts / self.norm[self.row]
        out = np.zeros((len(self.keys), len(top) + TERM_GROUPS), np.float32)
        out[self.row[hit], place[hit]] = unit[hit]
        rest = np.bincount(self.row[~hit] * TERM_GROUPS + self.terms[~hit] % TERM_GROUPS, unit[~hit] ** 2, len(self.keys) * TERM_GROUPS)
        out[:, len(top) :] = np.sqrt(rest).reshape(len(self.keys), TERM_GROUPS)
        return out


#: Rows of a product, on either side, alike ones of them, and rows whose turns are looked at one by one; columns of a rough bound.
TURNS, LATER, ALIKE, LEAF, ROUGH = 2048, 1024, 256, 64, 64


class _Turns:
    """Rows that take their turns one after another: vectors, bounds, heats, which of them go.

    The product of rows of `dense` bounds cosines, and that of rows of `rough` bounds it: all but the `ROUGH` terms of most
    mass, and the groups of other terms, are put together in `ROUGH` sets each, of which the norms are kept.
    """

    def __init__(self, columns: list[pa.Array], least: float, like: _Turns | None = None):
        self.own, self.heat, self.least = _Vectors(*columns[:3]), columns[3].to_numpy(), least
        self.top = self.own.top() if like is None else like.top
        self.dense, self.gone = self.own.dense(self.top), np.zeros(len(self.heat), bool)
        n, square = len(self.top), self.dense**2
        self.by_mass = np.argsort(-square[:, :n].sum(0)) if like is None else like.by_mass
        sets = [square[:, self.by_mass[i::ROUGH]].sum(1) for i in range(ROUGH, min(2 * ROUGH, n))]
        sets += [square[:, n + i :: ROUGH].sum(1) for i in range(ROUGH)]
        self.rough = np.column_stack([self.dense[:, self.by_mass[:ROUGH]], np.sqrt(np.column_stack(sets))])

    def similar(self, later: _Turns, r: int, others: np.ndarray) -> np.ndarray:
        """Which of the others the later row r is similar to, in full."""
        own, weight, spot = self.own, self.weight, slice(later.own.start[r], later.own.start[r] + later.own.n[r])
        terms = later.own.terms[spot]
        code = np.searchsorted(own.known, terms)
        code[own.known[np.minimum(code, len(own.known) - 1)] != terms] = len(own.known)
        weight[code] = later.own.counts[spot]
        weight[-1] = 0
        at = _spread(own.start[others], own.n[others])
        dot = np.add.reduceat(weight[own.code[at]] * own.counts[at], np.cumsum(own.n[others]) - own.n[others])
        weight[code] = 0
        return np.floor(dot / (later.own.norm[r] * own.norm[others]) * 1e9 + 0.5) / 1e9 >= self.least

    @property
    def weight(self) -> np.ndarray:
        """Counts of one row by these rows' terms; the last place is for other terms."""
        if not hasattr(self, "_weight"):
            self._weight = np.zeros(len(self.own.known) + 1)
        return self._weight

    def bounds(self, turns: np.ndarray, later: _Turns, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the cosines of rows and turns are no less and no more than: dense parts alone, and all parts."""
        n, mine, block = len(self.top), later.dense[rows], self.dense[turns]
        low = mine[:, :n] @ block[:, :n].T
        high = mine[:, n:] @ block[:, n:].T
        high += low
        return low, high

    def near(self, turns: np.ndarray, later: _Turns, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(r, o, sure), by row and then by turn: places of the pairs that may be similar, and whether they are for sure.

        Turns of the same heaviest term and of alike numbers of terms stand together, so that few rows come near any of them.
        """
        heaviest = self.dense[turns, : len(self.top)].argmax(1)
        order = np.lexsort((self.own.n[turns], heaviest))
        rough, found = later.rough[rows], []
        for x in range(0, len(order), ALIKE):
            alike = order[x : x + ALIKE]
            r = np.flatnonzero((rough @ self.rough[turns[alike]].T).max(1) >= self.least - 2e-4)
            if len(r):
                low, high = self.bounds(turns[alike], later, rows[r])
                i, j = np.nonzero(high >= self.least - 1e-4)
                found.append((r[i], alike[j], low[i, j] >= self.least + 1e-4))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        r, o, sure = (np.concatenate(f) for f in zip(*found, strict=True))
        order = np.lexsort((o, r))
        return r[order], o[order], sure[order]

    def stop(self, turns: np.ndarray, later: _Turns, rows: np.ndarray) -> np.ndarray:
        """Those of the later rows that these turns, in order, leave; marks those of the turns that go.

        Only pairs between the two bounds are computed in full, and of them only those that still decide something.
        """
        for y in range(0, len(turns), TURNS):
            if not len(rows):
                break
            r, o, sure = self.near(turns[y : y + TURNS], later, rows)
            turn = turns[o + y]
            stops = self.heat[turn] >= later.heat[rows[r]]
            first = np.full(len(rows), TURNS)  # the turn that stops each row
            np.minimum.at(first, r[sure & stops], o[sure & stops])
            left = np.flatnonzero(stops & ~sure & (o < first[r]))
            cuts = np.flatnonzero(np.diff(r[left], prepend=-1, append=-1))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                step = 4
                while i < j:
                    some = left[i : min(i + step, j)]
                    hit = self.similar(later, rows[r[some[0]]], turn[some])
                    if hit.any():
                        first[r[some[0]]] = o[some[hit.argmax()]]
                        break
                    i, step = i + step, step * 4
            # a turn goes for a later and hotter row that nothing stopped before
            cooler = ~stops & (o < first[r])
            self.gone[turn[cooler & sure]] = True
            left = np.flatnonzero(cooler & ~self.gone[turn])
            cuts = np.flatnonzero(np.diff(r[left], prepend=-1, append=-1))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                some = turn[left[i:j]]
                some = some[~self.gone[some]]
                if len(some):
                    self.gone[some[self.similar(later, rows[r[left[i]]], some)]] = True
            rows = rows[first == TURNS]
        return rows

    def settle(self, rows: np.ndarray) -> np.ndarray:
        """Those of these rows, in order, that no turn before stops: first the half before, then what it leaves of the rest."""
        if len(rows) > LEAF:
            before, after = self.settle(rows[: len(rows) // 2]), rows[len(rows) // 2 :]
            after = [self.stop(before, self, after[x : x + LATER]) for x in range(0, len(after), LATER)]
            return np.concatenate([before, self.settle(np.concatenate(after))])
        low, high = self.bounds(rows, self, rows)
        live = np.ones(len(rows), bool)
        for i, row in enumerate(rows):
            o = np.flatnonzero(live & (high[i] >= self.least - 1e-4))
            o = o[o > i]
            if not live[i] or not len(o):
                continue
            hit = low[i, o] >= self.least + 1e-4
            if not hit.all():
                hit[~hit] = self.similar(self, row, rows[o[~hit]])
            o = o[hit]
            stops = self.heat[row] >= self.heat[rows[o]]
            live[o[stops]] = False
            self.gone[row] |= not stops.all()
        return rows[live]


def _term_vectors(rows: DataFrame, key: str, terms: Column, heat: Column) -> DataFrame:
    """(k, h, c, heat): the distinct hashes of each row's terms, in order, and how often each stands there."""

    def run(batches):
        for whole in batches:
            for x in range(0, whole.num_rows, LATER):
                batch = whole.slice(x, LATER)
                terms, n = batch.column(1).flatten().to_numpy(), batch.column(1).value_lengths().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((terms, row))
                terms = terms[order]
                at = np.flatnonzero((np.diff(terms, prepend=0) != 0) | (np.diff(row, prepend=-1) != 0))
                ends = pa.array(np.searchsorted(row[at], np.arange(len(n) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (terms[at], np.diff(at, append=len(terms)))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists, batch.column(2)], names=["k", "h", "c", "heat"])

    hashed = rows.select(F.col(key).cast("long").alias("k"), F.transform(terms, lambda t: F.xxhash64(t)).alias("t"), heat.cast("long").alias("heat"))
    return hashed.mapInArrow(run, "k long, h array<long>, c array<long>, heat long")


def greedy_similar(rows: DataFrame, key: str, terms: Column, heat: Column, least: float) -> DataFrame:
    """Keys, each once and as longs, of the rows that go in the pass of `greedy_survivors` over all similar pairs.

    Similar are pairs whose cosine of term counts, rounded to 9 places, reaches `least`; every row has a key and terms.
    Pairs are not listed, since their number may grow with the square: rows take their turns in blocks of about VECTOR_BLOCK,
    in order of their keys. A task settles a block by itself; the rows that it leaves are broadcast and stand against
    all later rows that nothing has stopped so far, each of which gives back at most that it is stopped. Exact; what is
    computed grows with the square of the rows that are not stopped.
    """
    spark = rows.sparkSession
    ship(spark)
    vectors = stored(_term_vectors(rows, key, terms, heat), "vectors")
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("keys")).first()
    if size["n"] > size["keys"]:  # rows of one key are one row of all their terms
        entry = vectors.select("k", "heat", F.explode(F.arrays_zip("h", "c")).alias("t")).groupBy("k", "t.h").agg(F.sum("t.c").alias("c"), F.max("heat").alias("heat"))
        entry = entry.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("h", "c"))).alias("t"), F.max("heat").alias("heat"))
        vectors = entry.select("k", F.col("t.h").alias("h"), F.col("t.c").alias("c"), "heat")
    # every file has its share of the rows after any key, and groups of rows before it need not be read
    path = shared_path(spark, "vectors")
    vectors.repartition("k").sortWithinPartitions("k").write.option("parquet.block.size", 2 << 20).parquet(path)
    vectors = spark.read.schema(vectors.schema).parquet(path)
    n_blocks = -(-size["keys"] // VECTOR_BLOCK)
    # the last key of each block but the last one
    ends = vectors.agg(F.percentile_approx("k", [i / n_blocks for i in range(1, n_blocks)], 20 * n_blocks)).first()[0] if n_blocks > 1 else []
    ends, gone = sorted(set(ends)), stored(vectors.select("k").limit(0), "gone")
    columns = ("k", "h", "c", "heat")

    def settle(batches):
        table = pa.Table.from_batches(batches)
        if table.num_rows:
            table = table.sort_by("k")
            turns = _Turns([c.combine_chunks() for c in table.columns], least)
            stopped = np.ones(table.num_rows, bool)
            stopped[turns.settle(np.arange(table.num_rows))] = False
            yield from table.append_column("stopped", pa.array(stopped)).append_column("goes", pa.array(turns.gone)).to_batches()

    for i in range(len(ends) + 1):
        open_ = vectors.join(gone, "k", "left_anti").select(*columns)
        own = F.lit(True) if i == len(ends) else F.col("k") <= ends[i]
        own = own if i == 0 else own & (F.col("k") > ends[i - 1])
        block = open_.where(own).repartition(1).mapInArrow(settle, f"{', '.join(f'{c} {vectors.schema[c].dataType.simpleString()}' for c in columns)}, stopped boolean, goes boolean").toArrow()
        out = pc.or_(block.column("stopped"), block.column("goes"))
        now = spark.createDataFrame(pa.table({"k": block.column("k").filter(out)}), "k long")
        block = block.filter(pc.invert(block.column("stopped")))
        if i < len(ends) and block.num_rows:
            turns = _Turns([block.column(c).combine_chunks() for c in columns], least)
            turns.gone = block.column("goes").to_numpy()
            shared = spark.sparkContext.broadcast(turns)

            def run(batches, shared=shared):
                turns = shared.value
                turns.gone, every = turns.gone.copy(), np.arange(len(turns.heat))
                before = turns.gone.copy()
                for whole in batches:
                    for x in range(0, whole.num_rows, LATER):
                        later = _Turns(whole.slice(x, LATER).columns, least, turns)
                        stopped = np.ones(len(later.heat), bool)
                        stopped[turns.stop(every, later, np.arange(len(later.heat)))] = False
                        yield pa.RecordBatch.from_arrays([pa.array(later.own.keys[stopped])], names=["k"])
                yield pa.RecordBatch.from_arrays([pa.array(turns.own.keys[turns.gone & ~before])], names=["k"])

            now = now.union(open_.where(F.col("k") > ends[i]).mapInArrow(run, "k long"))
            gone = stored(gone.union(now).distinct(), "gone")
            shared.destroy()
        else:
            gone = stored(gone.union(now).distinct(), "gone")
    return gone


#: Pairs that one task may settle.
LAST_PAIRS = 1_000_000


def _stopped(blocks: DataFrame) -> DataFrame:
    """(k): the rows b of pairs (a, b), a < b, that have an a which is not such a row itself.

    In rounds: a row whose every a is settled is settled as well. Once few pairs are left, one task goes through them.
    """
    spark = blocks.sparkSession
    left, out = blocks, spark.createDataFrame([], "k long")
    while left.limit(LAST_PAIRS + 1).count() > LAST_PAIRS:
        # rows that are no b any more stay, and so their bs are stopped
        free = left.select(F.col("a").alias("k")).distinct().join(left.select(F.col("b").alias("k")).distinct(), "k", "left_anti")
        now = stored(left.join(free, left.a == free.k, "left_semi").select(F.col("b").alias("k")).distinct(), "stopped")
        out = out.union(now)
        left = stored(left.join(free, left.a == free.k, "left_anti").join(now, left.b == now.k, "left_anti").join(now, left.a == now.k, "left_anti"), "open")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        gone: set[int] = set()
        for a, b in pdf.sort_values(["a", "b"])[["a", "b"]].itertuples(index=False):
            if a not in gone:
                gone.add(b)
        return pd.DataFrame({"k": sorted(gone)}, dtype="int64")

    return out.union(left.groupBy().applyInPandas(walk, "k long"))


def greedy_survivors(rows: DataFrame, pairs: DataFrame, key: str, heat: str) -> DataFrame:
    """Keys that a greedy pass leaves: for each pair (a < b) in order the cooler row goes, of equals the later one.

    A row that has gone in its own turn still removes rows after it; one that an earlier row removed does not. So a row is
    stopped if an earlier similar row that is at least as hot is not stopped itself, and the first such row stops it. A
    row that is not stopped goes if a later similar row is hotter and was not stopped before that turn. No group of rows
    has to be in one task.
    """
    ship(rows.sparkSession)
    heats = rows.select(F.col(key).cast("long").alias("k"), F.col(heat).alias("h"))
    full = pairs.join(heats.select(F.col("k").alias("a"), F.col("h").alias("ha")), "a").join(heats.select(F.col("k").alias("b"), F.col("h").alias("hb")), "b")
    full = stored(full.select("a", "b", F.coalesce(F.col("ha") < F.col("hb"), F.lit(False)).alias("cooler")), "turns")
    blocks = full.where("NOT cooler").select("a", "b")
    stopped = stored(_stopped(blocks), "stopped")
    first = blocks.join(stopped, blocks.a == stopped.k, "left_anti").groupBy("b").agg(F.min("a").alias("by"))
    own = full.where("cooler").join(stopped, full.a == stopped.k, "left_anti").join(first, "b", "left").where("by IS NULL OR by > a")
    gone = stopped.union(own.select("a")).distinct()
    return rows.join(gone, F.col(key) == F.col("k"), "left_anti")
