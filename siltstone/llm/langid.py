"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a document in windows of `WINDOW` bytes (A-Z lower-cased). Both directions start from a zero state at
a window's ends and carry it over everything inside, words and lines alike. Every byte gets a probability for each
language, and the document's probability is the mean over the bytes that belong to letters. The units' squashing function
is softsign, x / (1 + |x|), which needs no exponential. Windows of many documents take each step together, longest
first, so that a batch holds a bounded number of bytes whatever the lengths of the texts.

Training is backpropagation through time in numpy on a bounded, hashed sample: about `per_label` documents of each
language (fewer of each if there are more than `sample / per_label` languages; every language has its share), of which
`pieces` windows of `PIECE` bytes at hashed places are read. Only those windows reach the driver.

Defined cases: a null text, an empty text and a text without a letter give `und` with score 0. Probabilities are rounded
to 6 digits, so that equal texts get equal results in any batch; ties between languages go to the one that sorts first.
An empty table gives an empty table. With no usable training row every document is `und`. Rows without a key are
labelled like any other, but not learnt from. Input columns named like an output are replaced, after they are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.frames import append_columns, give_back, key_share
from siltstone.llm.textkernel import LOWER, blocks, flat, mix
from siltstone.session import ship

WINDOW, PIECE = 256, 96
CELLS = 1 << 22  # window bytes times languages that are in memory at once
UND = "und"


@dataclass
class Model:
    labels: list[str]
    weights: dict[str, np.ndarray]


def cut(offs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, row) of the windows of each row of a flat buffer."""
    sizes = np.diff(offs)
    n = -(-sizes // window)
    row = np.repeat(np.arange(len(sizes)), n)
    at = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * window
    return offs[row] + at, np.minimum(window, sizes[row] - at), row


def grid(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes [step, window], active windows at each step) of windows that are sorted by falling length."""
    steps = np.arange(int(length.max(initial=0)))
    x = buf[np.minimum(start[None, :] + steps[:, None], len(buf) - 1)].astype(np.intp)
    return x, np.searchsorted(-length, -steps, "left")


def walk(x: np.ndarray, active: np.ndarray, inp: np.ndarray, rec: np.ndarray, back: bool, visit, keep: dict | None = None) -> None:
    """Runs one direction over a grid and hands each step's states to `visit(step, number, states)`.

    Windows that are active at a step are a prefix; walking back, a window joins at its last byte with a zero state.
    The columns of `inp` and `rec` are those of the update gate, the reset gate and the candidate.
    """
    hidden = rec.shape[0]
    by_byte = [np.ascontiguousarray(inp[:, i : i + hidden]) for i in range(0, 3 * hidden, hidden)]
    by_state = [np.ascontiguousarray(rec[:, i : i + hidden]) for i in range(0, 3 * hidden, hidden)]
    h, z, r, u, c, size = (np.zeros((x.shape[1], hidden), np.float32) for _ in range(6))
    half, one = np.float32(0.5), np.float32(1)
    for t in range(len(x) - 1, -1, -1) if back else range(len(x)):
        k = int(active[t])
        own, byte, scale = h[:k], x[t, :k], size[:k]
        gates = (z[:k], r[:k])
        for i, gate in enumerate(gates):
            np.matmul(own, by_state[i], out=gate)
            gate += by_byte[i].take(byte, axis=0)
            np.abs(gate, scale)
            scale += one
            gate /= scale
            gate += one
            gate *= half
        np.matmul(own, by_state[2], out=u[:k])
        cand = np.multiply(u[:k], gates[1], out=c[:k])
        cand += by_byte[2].take(byte, axis=0)
        np.abs(cand, scale)
        scale += one
        cand /= scale
        if keep is not None:
            keep[t] = [v[:k].copy() for v in (h, z, r, u, c)]
        own -= cand
        own *= gates[0]
        own += cand
        visit(t, k, own)


def _learn(x, active, inp, rec, back, keep, grad, g_inp, g_rec) -> None:
    """Adds the gradients of one direction; `grad` is the loss's by the states [step, window, unit]."""
    carry = np.zeros((x.shape[1], rec.shape[0]), np.float32)
    bytes_, pres = [], []
    for t in range(len(x)) if back else range(len(x) - 1, -1, -1):
        k = int(active[t])
        old, z, r, u, cand = keep[t]
        d = carry[:k] + grad[t, :k]
        d_cand = d * (1 - z) * (1 - np.abs(cand)) ** 2
        d_z = d * (old - cand) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        d_r = d_cand * u * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        bytes_.append(x[t, :k])
        pres.append(np.concatenate([d_z, d_r, d_cand], 1))
        d_u = np.concatenate([d_z, d_r, d_cand * r], 1)
        g_rec += old.T @ d_u
        carry[:k] = d * z + d_u @ rec.T
    byte, pre = np.concatenate(bytes_), np.concatenate(pres)
    for i in range(pre.shape[1]):
        g_inp[:, i] += np.bincount(byte, pre[:, i], 256)


def positions(model: Model, x: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Probabilities [label, step, window] of every byte of a grid; those of steps beyond a window's end say nothing."""
    w = model.weights
    hidden = w["fr"].shape[0]
    p = np.empty((len(model.labels), *x.shape), np.float32)
    p[:] = w["bias"][:, None, None]

    def add(out):
        out = np.ascontiguousarray(out)

        def visit(t, k, h):
            p[:, t, :k] += (h @ out).T

        return visit

    walk(x, active, w["fi"], w["fr"], False, add(w["out"][:hidden]))
    walk(x, active, w["bi"], w["br"], True, add(w["out"][hidden:]))
    np.clip(p, -60, 60, out=p)
    np.exp(p, p)
    p /= p.sum(0)
    return p


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = True


def sums(model: Model, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Per row: the labels' probabilities summed over its letter bytes, then their number."""
    n_lab = len(model.labels)
    out = np.zeros((len(offs) - 1, n_lab + 1))
    start, length, row = cut(offs, WINDOW)
    order = np.argsort(-length, kind="stable")
    at = max(1, CELLS // (WINDOW * max(n_lab, 8)))
    for i in range(0, len(order), at):
        own = order[i : i + at]
        x, active = grid(buf, start[own], length[own])
        p = positions(model, x, active)
        use = _LETTER[x] & (np.arange(len(own))[None, :] < active[:, None])
        got = np.einsum("tn,ltn->ln", use.astype(np.float32), p)
        for lab in range(n_lab):
            out[:, lab] += np.bincount(row[own], got[lab], len(out))
        out[:, -1] += np.bincount(row[own], use.sum(0), len(out))
    return out


def gradients(w: dict[str, np.ndarray], x: np.ndarray, active: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
    """(gradients, loss) of the mean cross entropy over all bytes of a grid whose windows have the labels y."""
    n, hidden = x.shape[1], w["fr"].shape[0]
    both = np.zeros((len(x), n, 2 * hidden), np.float32)
    kept: tuple[dict, dict] = ({}, {})

    def into(first):
        def visit(t, k, h):
            both[t, :k, first : first + hidden] = h

        return visit

    walk(x, active, w["fi"], w["fr"], False, into(0), kept[0])
    walk(x, active, w["bi"], w["br"], True, into(hidden), kept[1])
    logits = both @ w["out"] + w["bias"]
    logits -= logits.max(2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(2, keepdims=True)
    live = (np.arange(n)[None, :] < active[:, None]).astype(np.float32)
    loss = float(-(np.log(p[:, np.arange(n), y]) * live).sum() / live.sum())
    p[:, np.arange(n), y] -= 1
    p *= (live / live.sum())[:, :, None]
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["out"] = np.einsum("tnh,tnl->hl", both, p)
    g["bias"] = p.sum((0, 1))
    d = p @ w["out"].T
    _learn(x, active, w["fi"], w["fr"], False, kept[0], d[:, :, :hidden], g["fi"], g["fr"])
    _learn(x, active, w["bi"], w["br"], True, kept[1], d[:, :, hidden:], g["bi"], g["br"])
    return g, loss


def train(examples: list[tuple[bytes, str]], hidden: int = 8, epochs: int = 2, batch: int = 256, rate: float = 0.04, seed: int = 7) -> Model | None:
    """Fit on (bytes, label) pairs; labels with few pairs are read as often as those with many."""
    examples = [(b, lab) for b, lab in examples if _LETTER[np.frombuffer(b, np.uint8)].any()]
    if not examples:
        return None
    rng = np.random.default_rng(seed)
    labels = sorted({lab for _, lab in examples})
    number = {lab: i for i, lab in enumerate(labels)}
    y = np.array([number[lab] for _, lab in examples])
    offs = np.concatenate([[0], np.cumsum([len(b) for b, _ in examples])])
    buf = LOWER[np.frombuffer(b"".join(b for b, _ in examples), np.uint8)]
    counts = np.bincount(y)
    chance = 1 / counts[y] / len(labels)
    w = {k: rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32) for k in ("fi", "bi")}
    w |= {k: rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32) for k in ("fr", "br")}
    w |= {"out": rng.normal(0, 0.2, (2 * hidden, len(labels))).astype(np.float32), "bias": np.zeros(len(labels), np.float32)}
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    total = max(60, epochs * -(-len(examples) // batch))
    for step in range(1, total + 1):
        own = rng.choice(len(examples), min(batch, 4 * len(examples)), p=chance)
        own = own[np.argsort(-np.diff(offs)[own], kind="stable")]
        x, active = grid(buf, offs[own], np.diff(offs)[own])
        g, _ = gradients(w, x, active, y[own])
        lr = rate * (1 - 0.95 * step / total)
        for k in w:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            w[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    return Model(labels, w)


def windows_of(df: DataFrame, text: str, pieces: int) -> DataFrame:
    """(lang, piece) of rows (key, lang, text): at most `pieces` windows of PIECE bytes, at places hashed from the key."""
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            buf, offs = flat(batch.column(2))
            keys = np.array([hash_of(k) for k in batch.column(0).to_pylist()], np.uint64)
            sizes = np.diff(offs)
            rows, found = [], []
            for i in np.flatnonzero(sizes):
                n = min(pieces, -(-int(sizes[i]) // PIECE))
                places = mix(keys[i] + np.arange(n, dtype=np.uint64)) % np.uint64(max(int(sizes[i]) - PIECE, 0) + 1)
                for p in places.astype(np.int64) + offs[i]:
                    rows.append(i)
                    found.append(buf[p : min(p + PIECE, offs[i + 1])].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(rows, pa.int64())), pa.array(found, pa.binary())], names=["lang", "piece"])
        give_back()

    return df.mapInArrow(run, "lang string, piece binary")


def hash_of(key) -> int:
    """64 bits of a key's text, the same in every process."""
    raw = np.frombuffer(str(key).encode(), np.uint8).astype(np.uint64)
    return int(mix((raw * np.cumprod(np.full(len(raw), 1099511628211, np.uint64))).sum(keepdims=True))[0])


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_label: int = 400, sample: int = 25_600, pieces: int = 4, **options) -> Model | None:
    """Train on about `per_label` documents of each language, `sample` documents in all, chosen by a hash of `key`.

    At most 2 * pieces * max(sample, number of languages) windows of PIECE bytes reach the driver.
    """
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    counts = rows.groupBy(lang).count().collect()  # one row a language
    if not counts:
        return None
    each = min(per_label, max(1, sample // len(counts)))
    chance = df.sparkSession.createDataFrame([(r[0], min(1.0, each / r[1])) for r in counts], "_lang string, _share double")
    picked = rows.select(F.col(key).alias("_key"), F.col(lang).cast("string").alias("_of"), F.col(text).cast("string").alias("_text"))
    picked = picked.join(F.broadcast(chance), F.col("_of") == F.col("_lang")).where(key_share("_key", F.col("_share")))
    most = 2 * max(sample, len(counts))
    found = windows_of(picked.select("_key", "_of", "_text").limit(most), text, pieces).collect()
    return train(sorted((bytes(r[1]), r[0]) for r in found), **options)


def label(df: DataFrame, model: Model | None, text: str = "text", out: tuple[str, str] = ("lang_pred", "score"), keep: list[str] | None = None) -> DataFrame:
    """`df` (or its columns `keep`) with the predicted language and its score under the names `out`, from the whole text alone."""
    fields = [T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def apply(batch: pa.RecordBatch) -> list:
            column = batch.column(batch.schema.names.index(text))
            langs: list[str] = [UND] * batch.num_rows
            scores = np.zeros(batch.num_rows)
            if own is None:
                return [langs, scores]
            for i, _, buf, offs in blocks(column, 4 << 20):
                total = sums(own, LOWER[buf], offs)
                mean = np.round(total[:, :-1] / np.maximum(total[:, -1:], 1), 6)
                best = mean.argmax(1)
                plain = np.concatenate([[0], np.cumsum(_LETTER[buf] & (buf < 128))])
                ascii_letters = plain[offs[1:]] - plain[offs[:-1]]
                for r in np.flatnonzero(total[:, -1] > 0):
                    if ascii_letters[r] or any(map(str.isalpha, column[i + int(r)].as_py())):
                        langs[i + r], scores[i + r] = own.labels[best[r]], min(1.0, mean[r, best[r]])
            return [langs, scores]

        return apply

    return append_columns(df, fields, make, keep)
