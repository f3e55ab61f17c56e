"""Quality classification by nearest-neighbour voting over latent-semantic vectors.

A text becomes two blocks of relative term frequencies: n-grams of character classes with runs collapsed (how a text is
written: case, digits, symbols, tables) and hashed lower-cased words (what it says), beside the share of words that
repeat their predecessor. Square roots of the frequencies, weighted by inverse document frequency, are projected to the
leading right singular vectors of the labelled sample. The labelled vectors are broadcast (their number is bounded by
`per_label` times the two labels) and every document's exact cosine to each of them is computed in blocks; the `k`
nearest vote for their label with their similarity, and label counts of the sample are balanced by weight.

Defined cases: a null or empty text has the zero vector: no neighbour is nearer than another and the score is the
sample's share of label 1. Cosines are taken in double precision and rounded to 9 digits, scores to 6, so that equal
texts get equal results in any batch; ties between neighbours go to the earlier one of the sample, ordered by key. Without
any labelled row the score is 0.5. Rows without a key are scored like any other, but not learnt from. Input columns named
like an output are replaced, after they are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.frames import append_columns, give_back, key_share
from siltstone.llm.textkernel import LOWER, blocks, word_hashes, word_spans
from siltstone.session import ship

GRAMS, WORDS = 2048, 2048
REPEAT_AT = GRAMS + WORDS
DIMS = REPEAT_AT + 2
ROWS = 512  # documents whose term frequencies are in memory at once
AT = np.uint16  # a place among the DIMS features

#: Character classes: 0 lower case and bytes beyond ASCII, 1 upper case, 2 digit, 3 blank, 4 line break, then marks.
_CLASS = np.full(256, 10, np.uint8)
_CLASS[97:123] = _CLASS[128:] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[32, 9]] = 3
_CLASS[[10, 11, 12, 13]] = 4
_CLASS[[46, 44, 59, 58]] = 5
_CLASS[[33, 63]] = 6
_CLASS[124] = 7
_CLASS[[35, 36, 37, 38, 42]] = 8
_CLASS[[39, 34, 45]] = 9


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Dense [row, DIMS] relative frequencies, their roots taken, for one block of texts."""
    n = len(offs) - 1
    out = np.zeros((n, DIMS), np.float32)
    if not len(buf):
        return out
    kind = _CLASS[buf]
    change = np.ones(len(buf), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[offs[:-1][offs[:-1] < offs[1:]]] = True
    at = np.flatnonzero(change)
    row = np.searchsorted(offs, at, "right") - 1
    k = kind[at].astype(np.int64)
    if len(k) >= 3:
        code = (k[:-2] * 11 + k[1:-1]) * 11 + k[2:]
        same = row[:-2] == row[2:]
        _count(out, row[:-2][same], code[same], 0, GRAMS)
    s, e, owner = word_spans(buf, offs)
    if len(s):
        h = word_hashes(LOWER[buf], s, e)
        _count(out, owner, (h % np.uint64(WORDS)).astype(np.int64), GRAMS, WORDS)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        words = np.bincount(owner, minlength=n)
        share = np.bincount(owner[again], minlength=n) / np.maximum(words, 1)
        out[:, REPEAT_AT] = share
        out[:, REPEAT_AT + 1] = (1 - share) * (words > 0)
    return np.sqrt(out, out=out)


def _count(out: np.ndarray, row: np.ndarray, code: np.ndarray, first: int, width: int) -> None:
    n = len(out)
    counts = np.bincount(row * width + code, minlength=n * width).reshape(n, width).astype(np.float32)
    out[:, first : first + width] = counts / np.maximum(counts.sum(1, keepdims=True), 1)


@dataclass
class Model:
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float
    k: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        v = _unit(x.astype(np.float64) @ self.projection)
        out = np.empty(len(x))
        k = min(self.k, len(self.vectors))
        for i in range(0, len(x), 256):
            sims = np.round(v[i : i + 256] @ self.vectors.T, 9)
            kth = np.partition(sims, len(self.vectors) - k, axis=1)[:, len(self.vectors) - k, None]
            near = sims >= kth
            tied = near.sum(1) > k
            if tied.any():  # only the earliest of those at the k-th similarity stay
                above = (sims > kth)[tied]
                level = (sims == kth)[tied]
                near[tied] = above | (level & (np.cumsum(level, 1) <= k - above.sum(1, keepdims=True)))
            vote = np.where(near, np.maximum(sims, 1e-6) ** 4, 0) * self.weights
            out[i : i + 256] = (vote * self.labels).sum(1) / np.maximum(vote.sum(1), 1e-30)
        out[~v.any(1)] = self.prior
        return np.round(np.clip(out, 0, 1), 6)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def features_of(texts: pa.Array) -> np.ndarray:
    return np.concatenate([features(b, o) for _, _, b, o in blocks(texts, 1 << 20, ROWS)] or [np.zeros((0, DIMS), np.float32)])


class Packed:
    """Rows of features, of which only those that are not zero are held."""

    def __init__(self, at: list[np.ndarray], values: list[np.ndarray]):
        self.at, self.values = at, values

    @classmethod
    def of(cls, x: np.ndarray) -> Packed:
        at = [np.flatnonzero(row).astype(AT) for row in x]
        return cls(at, [row[a] for row, a in zip(x, at, strict=True)])

    def __len__(self) -> int:
        return len(self.at)

    def counts(self) -> np.ndarray:
        """The number of rows that have each feature."""
        out = np.zeros(DIMS, np.int64)
        for a in self.at:
            out[a] += 1
        return out

    def dense(self, first: int, last: int, weights: np.ndarray | None = None) -> np.ndarray:
        """Rows first to last - 1, each feature times its weight if there are weights."""
        out = np.zeros((max(0, min(last, len(self)) - first), DIMS), np.float32)
        for row, a, v in zip(out, self.at[first:last], self.values[first:last], strict=True):
            row[a] = v if weights is None else v * weights[a]
        return out


def train(x: np.ndarray, labels: list[int], **options) -> Model | None:
    """Fit on features [row, DIMS] and labels."""
    return train_packed(Packed.of(x), labels, **options)


def train_packed(x: Packed, labels: list[int], rank: int = 48, k: int = 15, word_weight: float = 0.5, seed: int = 3) -> Model | None:
    """Fit on packed features and labels. One dense matrix of single precision is held; all else goes by blocks."""
    if not len(x):
        return None
    idf = np.log((1 + len(x)) / (1 + x.counts())) + 1
    idf[GRAMS:REPEAT_AT] *= word_weight
    y = np.array(labels, np.float32)
    w = x.dense(0, len(x), idf.astype(np.float32))
    # the leading right singular vectors by subspace iteration
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(w.T @ rng.normal(size=(len(w), min(rank + 16, len(w)))).astype(np.float32))[0]
    for _ in range(6):
        q = np.linalg.qr(w.T @ (w @ q))[0]
    _, _, vt = np.linalg.svd(w @ q, full_matrices=False)
    del w
    projection = idf[:, None] * (q @ vt[:rank].T).astype(np.float64)
    vectors = np.concatenate([_unit(x.dense(i, i + ROWS).astype(np.float64) @ projection) for i in range(0, len(x), ROWS)])
    ones = float(y.mean())
    weights = np.where(y > 0, 0.5 / max(ones, 1e-9), 0.5 / max(1 - ones, 1e-9))
    return Model(projection, vectors, y, weights, ones, k)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", target: str = "quality", per_label: int = 1500, **options) -> Model | None:
    """Fit on about `per_label` rows of each label (0 and 1), chosen by a hash of the key.

    A key that `labels` holds more than once counts with its largest label. Whole texts are read where they lie; at most
    4 * per_label rows of DIMS features reach the driver, those that are not zero, and it holds one dense matrix of them.
    """
    rows = labels.where(F.col(target).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(target).alias("_label"))
    counts = {r[0]: r[1] for r in rows.groupBy("_label").count().collect()}
    if not counts:
        return None
    share = F.coalesce(*[F.when(F.col("_label") == c, F.lit(min(1.0, per_label / n))) for c, n in counts.items()])
    chosen = rows.where(key_share(key, share)).limit(4 * per_label)
    texts = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    chosen = texts.join(F.broadcast(chosen.withColumnRenamed(key, "_key")), "_key").limit(4 * per_label)
    found = sparse_features(chosen.select(F.col("_key").cast("string"), F.col("_label").cast("int"), "_text")).collect()
    found.sort(key=lambda r: (r["key"], bytes(r["at"]), bytes(r["value"])))
    x = Packed([np.frombuffer(r["at"], AT) for r in found], [np.frombuffer(r["value"], np.float32) for r in found])
    return train_packed(x, [r["label"] for r in found], **options)


def sparse_features(rows: DataFrame) -> DataFrame:
    """(key, label, at, value) of rows (key, label, text): packed places and values of the features that are not zero."""
    ship(rows.sparkSession)

    def run(batches):
        for batch in batches:
            for i, j, buf, offs in blocks(batch.column(2), 1 << 20, ROWS):
                x = features(buf, offs)
                rows = Packed.of(x)
                packed = [pa.array([v.tobytes() for v in part], pa.binary()) for part in (rows.at, rows.values)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *packed], names=["key", "label", "at", "value"])
        give_back()

    return rows.mapInArrow(run, "key string, label int, at binary, value binary")


def score(df: DataFrame, model: Model | None, text: str = "text", out: tuple[str, str] = ("score", "predicted"), keep: list[str] | None = None) -> DataFrame:
    """`df` (or its columns `keep`) with a score (0 to 1) and a prediction (score >= 0.5) under the names `out`, from the whole text alone."""
    fields = [T.StructField(out[0], T.DoubleType()), T.StructField(out[1], T.IntegerType())]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def apply(batch: pa.RecordBatch) -> list:
            column = batch.column(batch.schema.names.index(text))
            if model is None:
                found = np.full(batch.num_rows, 0.5)
            else:
                found = np.empty(batch.num_rows)
                for i, j, buf, offs in blocks(column, 1 << 20, ROWS):
                    found[i:j] = model.scores(features(buf, offs))
            return [found, (found >= 0.5).astype(np.int32)]

        return apply

    return append_columns(df, fields, make, keep)
