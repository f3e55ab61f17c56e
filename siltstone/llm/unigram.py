"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

`load` reads pieces, scores and kinds from a model file. All pieces of the vocabulary that stand for text go into one
double-array trie over their UTF-8 bytes. Encoding puts a word-start mark before the text and in place of each blank and
takes the best-scoring segmentation; of equal ones, the one whose last piece starts earliest. A character that no piece
covers becomes its bytes' pieces, or the unknown piece where the vocabulary has none. Decoding is the inverse.

No piece spans the place before a word-start mark that follows another character, and none holds a character outside the
trie's alphabet, so the best segmentation falls apart at those places. The words between them are looked up in a table
of bounded size that is kept per task; missing words of equal length run through the trie and the Viterbi recurrence
together. Vocabularies with pieces that do span such places are encoded without cutting.

Defined cases: a null text gives null, an empty text no piece. Characters outside the vocabulary go through bytes, so a
round trip is exact for every text without U+2581, which decodes to a blank. Repeated rows get equal results. Model
files with a character map or with removal of extra blanks are refused.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltstone.llm.frames import append_columns

MARK = "▁"
CACHE = 150_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the model format
UNKNOWN_PENALTY = 10.0  # fixed value of the model format


def _fields(raw: bytes):
    """(number, value) of a protocol buffer message; length-delimited values are bytes."""
    i = 0

    def varint():
        nonlocal i
        out = shift = 0
        while True:
            c = raw[i]
            i += 1
            out |= (c & 127) << shift
            shift += 7
            if c < 128:
                return out

    while i < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, raw[i : i + n]
            i += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, raw[i : i + n]
            i += n


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    prefix: bool
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    longest: int
    bytes_of: np.ndarray  # id of each byte's piece, or -1
    unknown: int
    floor: float
    cut: str  # characters that no piece holds, out of the ASCII controls; None: the text is not to be cut

    @property
    def cuttable(self) -> bool:
        return self.cut is not None


def double_array(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value): the child of state s by byte c is base[s] + c, if check of that is s; root is 0."""
    root: dict = {}
    for k, v in zip(keys, values, strict=True):
        node = root
        for c in k:
            node = node.setdefault(c, {})
        node[-1] = v
    size = 1 << 16
    base, check, value = (np.full(size, -1, np.int32) for _ in range(3))
    base[0], check[0] = 0, 0
    used = bytearray(size)
    used[0] = 1
    todo, lone, wide = [(0, root)], 257, 257
    while todo:
        state, node = todo.pop()
        value[state] = node.get(-1, -1)
        kids = sorted(c for c in node if c >= 0)
        if not kids:
            continue
        while used[lone]:
            lone += 1
        # a single child takes the first gap; several look from where the array is no longer crowded
        b, tries = (lone if len(kids) == 1 else max(wide, lone)) - kids[0], 0
        while True:
            while b + 256 >= size:
                grow = np.full(size, -1, np.int32)
                base, check, value = (np.concatenate([x, grow]) for x in (base, check, value))
                used += bytearray(size)
                size *= 2
            if not any(used[b + c] for c in kids):
                break
            b += 1
            tries += 1
        if len(kids) > 1 and tries > 20:
            wide = max(wide, b)
        base[state] = b
        for c in kids:
            used[b + c] = 1
            check[b + c] = state
            todo.append((b + c, node[c]))
    end = int(np.flatnonzero(np.frombuffer(used, np.uint8)).max()) + 257
    return base[:end].copy(), check[:end].copy(), value[:end].copy()


def load(path: str) -> Vocabulary:
    with open(path, "rb") as f:  # a driver-side parameter; what the tasks need is sent with them
        return parse(f.read())


def parse(raw: bytes) -> Vocabulary:
    pieces, scores, kinds, norm = [], [], [], {}
    for n, v in _fields(raw):
        if n == 1:
            p = dict(_fields(v))
            pieces.append(p.get(1, b"").decode("utf-8"))
            scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
            kinds.append(p.get(3, NORMAL))
        elif n == 3:
            norm = dict(_fields(v))
    if norm.get(2) or norm.get(4, 1):
        raise ValueError("model files with a character map or removal of extra blanks are not supported")
    return build(pieces, np.array(scores, np.float64), np.array(kinds), bool(norm.get(3, 1)))


def build(pieces: list[str], scores: np.ndarray, kinds: np.ndarray, prefix: bool = True) -> Vocabulary:
    text = [i for i, k in enumerate(kinds) if k in (NORMAL, USER) and pieces[i]]
    if any(kinds[i] == USER for i in text):
        raise ValueError("user-defined pieces are not supported")
    keys = [pieces[i].encode("utf-8") for i in text]
    base, check, value = double_array(keys, text)
    bytes_of = np.full(256, -1, np.int64)
    for i, k in enumerate(kinds):
        if k == BYTE:
            bytes_of[int(pieces[i][3:5], 16)] = i
    spans = any(MARK in pieces[i].lstrip(MARK) for i in text)
    held = set("".join(pieces[i] for i in text))
    cut = None if spans else "".join(chr(c) for c in range(32) if chr(c) not in held)
    unknown = int(np.flatnonzero(kinds == UNKNOWN)[0]) if (kinds == UNKNOWN).any() else 0
    return Vocabulary(pieces, scores, kinds, prefix, base, check, value, max(map(len, keys), default=1), bytes_of, unknown, float(scores[text].min(initial=0.0)) - UNKNOWN_PENALTY, cut)


def _char_length(lead: np.ndarray) -> np.ndarray:
    return np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))


def best_paths(v: Vocabulary, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts): pieces of each row of bytes (rows of equal length, whole characters), one row after another."""
    n, width = x.shape
    best = np.full((width + 1, n), -np.inf)
    best[0] = 0
    frm = np.zeros((width + 1, n), np.int32)
    via = np.zeros((width + 1, n), np.int32)
    rows = np.arange(n)
    for i in range(width):
        lead = (x[:, i] & 0xC0) != 0x80
        if not lead.any():
            continue
        size = _char_length(x[:, i])
        single = np.zeros(n, bool)
        live = rows[lead]
        state = np.zeros(len(live), np.int64)
        for j in range(i, min(width, i + v.longest)):
            nxt = v.base[state] + x[live, j].astype(np.int64)
            ok = (v.base[state] >= 0) & (v.check[np.maximum(nxt, 0)] == state)
            live, state = live[ok], nxt[ok]
            if not len(live):
                break
            piece = v.value[state]
            end = piece >= 0
            if end.any():
                r, p = live[end], piece[end]
                single[r] |= size[r] == j + 1 - i
                score = best[i, r] + v.scores[p]
                up = score > best[j + 1, r]
                r, p = r[up], p[up]
                best[j + 1, r], frm[j + 1, r], via[j + 1, r] = score[up], i, p
        for s in (1, 2, 3, 4):
            r = rows[lead & ~single & (size == s)]
            if len(r) and i + s <= width:
                score = best[i, r] + v.floor
                up = score > best[i + s, r]
                r = r[up]
                best[i + s, r], frm[i + s, r], via[i + s, r] = score[up], i, -1
    # walk back all rows at once, last piece first
    at, steps = np.full(n, width), []
    live = rows
    while len(live):
        p = via[at[live], live]
        a = frm[at[live], live]
        steps.append((live, p, a, at[live]))
        at[live] = a
        live = live[a > 0]
    owner = np.concatenate([s[0] for s in steps][::-1]) if steps else np.zeros(0, int)
    piece = np.concatenate([s[1] for s in steps][::-1]) if steps else np.zeros(0, int)
    a, b = (np.concatenate([s[k] for s in steps][::-1]) if steps else np.zeros(0, int) for k in (2, 3))
    order = np.argsort(owner, kind="stable")
    owner, piece, a, b = owner[order], piece[order], a[order], b[order]
    if (piece < 0).any():  # characters outside the vocabulary, byte by byte
        whole = (v.bytes_of >= 0).all()
        times = np.where((piece < 0) & whole, b - a, 1)
        inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        owner, start, piece = np.repeat(owner, times), np.repeat(a, times) + inner, np.repeat(piece, times)
        lost = piece < 0
        piece = piece.astype(np.int64)
        piece[lost] = v.bytes_of[x[owner[lost], start[lost]]] if whole else v.unknown
    return piece.astype(np.int32), np.bincount(owner, minlength=n)


class Encoder:
    """Encodes texts with a table of words that is emptied when it is full."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.words: dict[str, int] = {}
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.cutter = re.compile(f"[{re.escape(v.cut)}]| *[^ {re.escape(v.cut)}]+| +" if v.cut else " *[^ ]+| +") if v.cuttable else None

    def _learn(self, fresh: list[str]) -> None:
        raw = [w.replace(" ", MARK).encode("utf-8", "replace") for w in fresh]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        start, count = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        parts, total = [], len(self.ids)
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            for i in range(0, len(rows), max(1, min(2048, (1 << 19) // int(n)))):
                own = rows[i : i + max(1, min(2048, (1 << 19) // int(n)))]
                ids, k = best_paths(self.v, np.frombuffer(b"".join([raw[j] for j in own]), np.uint8).reshape(len(own), n))
                start[own] = total + np.cumsum(k) - k
                count[own] = k
                total += len(ids)
                parts.append(ids)
        self.words.update(zip(fresh, range(len(self.start), len(self.start) + len(fresh)), strict=True))
        self.start, self.count = np.concatenate([self.start, start]), np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, *parts])

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each text)."""
        lists = []
        for x in texts:
            if not x:
                lists.append([])
                continue
            x = (" " + x if self.v.prefix else x).replace(MARK, " ")
            lists.append(self.cutter.findall(x) if self.cutter else [x])
        flat = [w for ws in lists for w in ws]
        fresh = list(set(flat).difference(self.words))
        if len(self.words) + len(fresh) > CACHE:
            self.words.clear()
            self.start, self.count, self.ids = self.start[:0], self.count[:0], self.ids[:0]
            fresh = list(set(flat))
        if fresh:
            self._learn(fresh)
        at = np.fromiter(map(self.words.__getitem__, flat), np.int64, len(flat))
        n = self.count[at]
        ids = self.ids[np.repeat(self.start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        per = np.fromiter(map(len, lists), np.int64, len(lists))
        sums = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum(per)
        return ids, sums[ends] - sums[ends - per]


class Decoder:
    """Turns ids back into the bytes of texts."""

    def __init__(self, v: Vocabulary):
        out = []
        for i, p in enumerate(v.pieces):
            k = v.kinds[i]
            out.append(bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode())
        self.length = np.fromiter(map(len, out), np.int64, len(out))
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(out), np.uint8)
        self.prefix = v.prefix

    def __call__(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts; the blank of the dummy prefix is left out."""
        n = self.length[ids]
        skip = np.zeros(len(ids), np.int64)
        if self.prefix:
            first = (np.cumsum(counts) - counts)[counts > 0]
            blank = first[(n[first] > 0) & (self.bytes[np.minimum(self.start[ids[first]], len(self.bytes) - 1)] == 32)]
            skip[blank] = 1
        n = n - skip
        at = np.repeat(self.start[ids] + skip - np.cumsum(n) + n, n) + np.arange(n.sum())
        sums = np.concatenate([[0], np.cumsum(n)])
        return self.bytes[at], sums[np.concatenate([[0], np.cumsum(counts)])]


def _runs(column: pa.Array, most: int = 1 << 20):
    """(first row, texts) of runs of rows of about `most` characters."""
    first, run, size = 0, [], 0
    for i, x in enumerate(column):
        t = x.as_py()
        run.append(t)
        size += len(t or "")
        if size >= most:
            yield first, run
            first, run, size = i + 1, [], 0
    if run:
        yield first, run


def encode(df: DataFrame, v: Vocabulary, text: str = "text", out: str = "ids") -> DataFrame:
    """`df` with the array of piece ids of each text."""

    def make():
        encoder = Encoder(v)

        def apply(batch: pa.RecordBatch) -> list:
            column = batch.column(batch.schema.names.index(text))
            ids, counts = [], []
            for _, texts in _runs(column):
                a, b = encoder(texts)
                ids.append(a)
                counts.append(b)
            ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
            mask = column.is_null() if column.null_count else None
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)), mask=mask)]

        return apply

    return append_columns(df, [T.StructField(out, T.ArrayType(T.IntegerType()))], make)


def decode(df: DataFrame, v: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with the text of each array of piece ids; bytes that are no UTF-8 become replacement characters."""

    def make():
        decoder = Decoder(v)

        def apply(batch: pa.RecordBatch) -> list:
            column = batch.column(batch.schema.names.index(ids))
            counts = np.array([len(x) if x is not None else 0 for x in column.to_pylist()], np.int64)
            buf, offs = decoder(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            raw = buf.tobytes()
            return [[None if not ok else raw[a:b].decode("utf-8", "replace") for a, b, ok in zip(offs[:-1], offs[1:], column.is_valid().to_pylist(), strict=True)]]

        return apply

    return append_columns(df, [T.StructField(out, T.StringType())], make)


DIGEST = [T.StructField("n_pieces", T.LongType()), T.StructField("n_byte_pieces", T.LongType()), T.StructField("ids_hash", T.LongType()), T.StructField("round_trip", T.BooleanType())]


def digest(df: DataFrame, v: Vocabulary, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`df` (or its columns `keep`) with the number of pieces and byte pieces, a hash of the ids, and whether decoding them gives the text back.

    The hash is the sum of (id + 1) * 1000003^position over the ids, modulo 2^64, as a signed number.
    """

    def make():
        encoder, decoder = Encoder(v), Decoder(v)
        is_byte = np.array(v.kinds) == BYTE

        def apply(batch: pa.RecordBatch) -> list:
            out: list[list] = [[], [], [], []]
            for _, texts in _runs(batch.column(batch.schema.names.index(text))):
                ids, counts = encoder(texts)
                ends = np.cumsum(counts)
                place = np.arange(len(ids)) - np.repeat(ends - counts, counts)
                top = int(counts.max(initial=0))
                powers = np.full(max(top, 1), 1000003, np.uint64)
                powers[0] = 1
                powers = np.multiply.accumulate(powers)
                sums = np.concatenate([[np.uint64(0)], np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * powers[place])])
                hashes = (sums[ends] - sums[ends - counts]).astype(np.int64)
                bytes_before = np.concatenate([[0], np.cumsum(is_byte[ids])])
                raw, offs = decoder(ids, counts)
                raw = raw.tobytes()
                for k, t in enumerate(texts):
                    none = t is None
                    out[0].append(None if none else int(counts[k]))
                    out[1].append(None if none else int(bytes_before[ends[k]] - bytes_before[ends[k] - counts[k]]))
                    out[2].append(None if none else int(hashes[k]))
                    out[3].append(None if none else raw[offs[k] : offs[k + 1]] == t.encode("utf-8", "replace"))
            return out

        return apply

    return append_columns(df, DIGEST, make, keep)
