"""Approximate nearest neighbours by learned partitions.

`fit` takes a bounded, hashed sample of the vectors, builds its exact neighbour graph, cuts the graph into parts of
equal size by recursive spectral bisection (each part is halved at the median of its graph's second eigenvector), and
trains a small network to tell a vector's part from its coordinates; its targets are the parts of the vector and of its
neighbours. The number of parts grows with the square root of the number of vectors, from one (below 40 vectors) to
`MOST_PARTS`. The number of parts that a query visits is the smallest that covers `recall` of the true neighbours of
vectors the network has not seen. The network sees coordinates less their mean and divided by their spread.

`search` assigns every row to its most probable part and sends each query to its most probable ones. A part is split
into cells of a bounded number of bytes by a hash of the id and its queries into blocks likewise, so that no task grows
with a hot part. In a cell exact distances in double precision rank the candidates; the best of all cells win. A quick
form of the distance picks what is measured exactly; it is taken from the cell's centre, and its error bound is
proportional to the vectors' distances from there, so that nothing near the k-th distance is missed at any offset.

Defined cases: vectors that are null, empty, all zero or hold a null or non-finite component take no part, neither as
queries nor as candidates, and rows without an id take none either. Vectors of another length than the sample's
commonest meet those of their own length, all of them. Ties go to the smaller id. Rows with equal ids are separate
candidates, but a query never meets its own id; queries of one id are answered
once, by the smallest of their vectors in the order of arrays. An empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.llm.frames import key_share
from siltstone.session import ship, stored

CELL_BYTES = 24 << 20  # of the double-precision vectors of a cell, or of a block of queries
MOST_PARTS = 1024
PER_PART = 20  # sampled vectors for each part at least


def usable(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class Router:
    dim: int
    layers: list[np.ndarray]
    visits: int
    centre: np.ndarray
    spread: float

    @property
    def n_parts(self) -> int:
        return self.layers[-1].shape[0] if self.layers else 1

    def inputs(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):  # what is that far away lies at the rim
            return np.clip((x - self.centre) / self.spread, -1e6, 1e6)

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.zeros((len(x), 1))
        w1, b1, w2, b2 = self.layers
        return np.maximum(self.inputs(x) @ w1 + b1, 0) @ w2 + b2


def scale_of(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(mean, spread) of coordinates, without overflow; the spread is never zero."""
    if not len(x):
        return np.zeros(x.shape[1]), 1.0
    top = float(np.abs(x).max()) or 1.0
    y = x / top
    centre = y.mean(0)
    return centre * top, max(float(np.sqrt(((y - centre) ** 2).mean())), 1e-9) * top


def neighbours(x: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """Places in x of the k nearest to each row of `of`, without exact copies at the same place."""
    out = np.empty((len(of), k), np.int64)
    norms = (x**2).sum(1)
    for i in range(0, len(of), 256):
        d = norms[None, :] - 2 * of[i : i + 256] @ x.T
        out[i : i + 256] = np.argsort(d, 1, kind="stable")[:, :k]
    return out


def bisect(graph: np.ndarray, members: np.ndarray, levels: int, rng: np.random.Generator, first: int = 0, out: np.ndarray | None = None) -> np.ndarray:
    """The part of each vertex; `graph` has each vertex's neighbours."""
    out = np.zeros(len(graph), np.int64) if out is None else out
    if levels == 0:
        out[members] = first
        return out
    place = np.full(len(graph), -1)
    place[members] = np.arange(len(members))
    near = place[graph[members]]
    a = np.repeat(np.arange(len(members)), near.shape[1])
    b = near.ravel()
    a, b = a[b >= 0], b[b >= 0]
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    degree = np.bincount(src, minlength=len(members)) + 1e-9
    v = rng.normal(size=len(members))
    root = np.sqrt(degree)
    for _ in range(60):  # power iteration on the normalised adjacency, away from its leading eigenvector
        v -= root * (v @ root) / (root @ root)
        v = 0.5 * (v + np.bincount(src, v[dst] / root[dst], len(members)) / root)
        v /= np.linalg.norm(v) + 1e-30
    order = np.argsort(v / root, kind="stable")
    half = len(members) // 2
    bisect(graph, members[order[:half]], levels - 1, rng, first, out)
    bisect(graph, members[order[half:]], levels - 1, rng, first + (1 << (levels - 1)), out)
    return out


def train(x: np.ndarray, n_parts: int = 16, k: int = 10, hidden: int = 64, epochs: int = 40, recall: float = 0.93, seed: int = 5) -> Router:
    centre, spread = scale_of(x)
    router = Router(x.shape[1], [], 1, centre, spread)
    if n_parts < 2:
        return router
    rng = np.random.default_rng(seed)
    x = router.inputs(x[rng.permutation(len(x))])
    held = max(len(x) // 8, 1)
    probe, x = x[:held], x[held:]
    graph = neighbours(x, x, k + 1)[:, 1:]
    part = bisect(graph, np.arange(len(x)), int(np.log2(n_parts)), rng)
    target = np.zeros((len(x), n_parts))
    np.add.at(target, (np.arange(len(x)), part), 0.5)
    np.add.at(target, (np.repeat(np.arange(len(x)), k), part[graph].ravel()), 0.5 / k)
    w = [rng.normal(size=(x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.normal(size=(hidden, n_parts)) / np.sqrt(hidden), np.zeros(n_parts)]
    m, s, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    total = epochs * ((len(x) + 255) // 256)
    for _ in range(epochs):
        perm = rng.permutation(len(x))
        for i in range(0, len(perm), 256):
            own = perm[i : i + 256]
            h = x[own] @ w[0] + w[1]
            r = np.maximum(h, 0)
            z = r @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - target[own]) / len(own)
            dh = (d @ w[2].T) * (h > 0)
            grads = [x[own].T @ dh, dh.sum(0), r.T @ d, d.sum(0)]
            step += 1
            rate = 0.01 * (1 - 0.95 * step / total)
            for j, g in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * g
                s[j] = 0.99 * s[j] + 0.01 * g * g
                w[j] = w[j] - rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(s[j] / (1 - 0.99**step)) + 1e-9)
    router.layers = w
    # visits that cover the true neighbours of the vectors held back
    logits = lambda y: np.maximum(y @ w[0] + w[1], 0) @ w[2] + w[3]
    home = logits(x).argmax(1)
    near = home[neighbours(x, probe, k)]
    rank = np.argsort(np.argsort(-logits(probe), 1, kind="stable"), 1)
    cover = np.array([(np.take_along_axis(rank, near, 1) < v).mean() for v in range(1, n_parts + 1)])
    router.visits = int(np.argmax(cover >= recall)) + 1 if (cover >= recall).any() else n_parts
    return router


def parts_for(n: int) -> int:
    """A power of two near a quarter of the square root of n."""
    return int(min(MOST_PARTS, 2 ** max(0, int(np.log2(max(n, 1)) / 2 - 2 + 0.5))))


def fit(df: DataFrame, key: str = "vec_id", vector: str = "embedding", sample: int = 6000, **options) -> Router:
    """Train on about max(`sample`, PER_PART vectors a part), chosen by a hash of the id; at most twice as many reach the driver."""
    rows = df.where(usable(vector) & F.col(key).isNotNull())
    n = rows.count()
    n_parts = options.pop("n_parts", parts_for(n))
    sample = max(sample, 2 * PER_PART * n_parts)
    picked = rows.where(key_share(key, F.lit(min(1.0, sample / max(n, 1))))).select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).limit(2 * sample).toArrow().combine_chunks()
    sizes = picked.column(1).combine_chunks().value_lengths().to_numpy() if len(picked) else np.zeros(0, np.int64)
    dim = Counter(sizes.tolist()).most_common(1)[0][0] if len(sizes) else 0
    own = picked.filter(pa.array(sizes == dim))
    x = own.column(1).combine_chunks().flatten().to_numpy().reshape(-1, dim) if len(own) else np.zeros((0, dim))
    # by id and coordinates, so that equal tables give equal routers
    x = x[np.lexsort([*x.T[::-1], own.column(0).to_numpy()])] if len(own) else x
    while n_parts > 1 and len(x) < PER_PART * n_parts:  # few vectors have the commonest length
        n_parts //= 2
    return train(x, n_parts=n_parts, **options)


def routed(df: DataFrame, router: Router, most: int, key: str, vector: str) -> DataFrame:
    """(id, vec, part): the `most` most probable parts of every usable vector, whose doubles are packed.

    A vector of another length than the router's has the part -1 - length.
    """
    ship(df.sparkSession)
    rows = df.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy()
            for n in np.unique(sizes):
                own = pa.array(np.flatnonzero(sizes == n))
                ids, x = batch.column(0).take(own), lists.take(own).flatten().to_numpy().reshape(-1, n)
                best = np.argsort(-router.logits(x), 1, kind="stable")[:, :most] if n == router.dim else np.full((len(x), 1), -1 - n)
                again = pa.array(np.repeat(np.arange(len(x)), best.shape[1]))
                packed = pa.array([v.tobytes() for v in x], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.take(again), packed.take(again), pa.array(best.ravel().astype(np.int32))], names=["id", "vec", "part"])

    return rows.mapInArrow(run, "id long, vec binary, part int")


def _unit_power(x: np.ndarray, q: np.ndarray) -> float:
    """A power of two by which coordinates are multiplied so that no square overflows or vanishes; 1 in ordinary ranges."""
    top = max(float(np.abs(x).max(initial=0)), float(np.abs(q).max(initial=0)))
    return 1.0 if 1e-100 < top < 1e100 or top == 0 else 2.0 ** -int(np.clip(np.floor(np.log2(top)), -1000, 1000))


def nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, id, distance) of the k nearest rows of each query, exactly, ties to the smaller id."""
    out = []
    unit = _unit_power(x, q)
    x, q = x * unit, q * unit
    centre = x.mean(0)
    y, r = x - centre, q - centre
    # the quick form errs by less than this share of the squared lengths
    share = 8 * (x.shape[1] + 8) * 2.0**-53
    norms, q_norms = (y**2).sum(1), (r**2).sum(1)
    for i in range(0, len(q), 128):
        d = norms[None, :] - 2 * r[i : i + 128] @ y.T + q_norms[i : i + 128, None]
        err = share * (norms[None, :] + q_norms[i : i + 128, None])
        d[q_ids[i : i + 128, None] == ids[None, :]] = np.inf
        most = min(k, d.shape[1])
        bound = np.partition(d + err, most - 1, 1)[:, most - 1]
        for j, (row, b) in enumerate(zip(d - err, bound, strict=True)):
            # all rows that may be among the nearest are measured again
            near = np.flatnonzero((row <= b) & np.isfinite(row))
            exact = np.sqrt(((x[near] - q[i + j]) ** 2).sum(1))
            order = np.lexsort((ids[near], exact))[:k]
            out += [(int(q_ids[i + j]), int(ids[near[o]]), float(exact[o] / unit)) for o in order]
    return out


def search(df: DataFrame, queries: DataFrame, router: Router, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, other than itself."""
    rows = stored(routed(df, router, 1, key, vector), "rows")
    one = queries.where(usable(vector) & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias(key)).agg(F.min(F.col(vector).cast("array<double>")).alias(vector))
    asked = stored(routed(one, router, router.visits, key, vector), "asked")

    def cuts(t: DataFrame, name: str) -> DataFrame:  # one row a part
        return t.groupBy("part").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.octet_length("vec")) / CELL_BYTES)).cast("int").alias(name))

    # bounded by MOST_PARTS and the number of other lengths
    sizes = cuts(rows, "cells").join(cuts(asked, "blocks"), "part")
    split = lambda id_, n: F.pmod(F.xxhash64(id_), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    r = rows.join(sizes, "part").select("part", split("id", "cells").alias("cell"), every("blocks").alias("block"), "id", "vec", F.lit(False).alias("asks"))
    q = asked.join(sizes, "part").select("part", every("cells").alias("cell"), split("id", "blocks").alias("block"), "id", "vec", F.lit(True).alias("asks"))

    def look(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        unpack = lambda t: np.frombuffer(b"".join(t["vec"]), np.float64).reshape(len(t), -1)
        found = nearest(unpack(b), b["id"].to_numpy(), unpack(a), a["id"].to_numpy(), k) if len(a) and len(b) else []
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = r.unionByName(q).groupBy("part", "cell", "block").applyInPandas(look, "query_id long, vec_id long, score double")
    order = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
