"""Vectorised kernels over the UTF-8 bytes of Arrow string columns.

A column is handled as one flat byte buffer with row offsets, cut into blocks of bounded size, so that memory does
not grow with the batch. A single text longer than the bound makes a block of its own. Nulls count as empty texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES, BLOCK_ROWS, HASH_BYTES = 2 << 20, 16_384, 1 << 17
#: Word hashes are polynomials in `BASE` modulo this prime; modulo a power of two, words of a Thue-Morse pattern collide.
PRIME = (1 << 61) - 1
BASE = 0x9E3779B97F4A7C15 % PRIME

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets has one entry more than there are rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offs else np.zeros(len(column) + 1, np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return b, o - o[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES, rows: int = BLOCK_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `limit` bytes and at most `rows` rows."""
    buf, offs = flat(column)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n, i + rows)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for any 64-bit x."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


def times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """a * b modulo the prime, for numbers below it, by halves of 30 and 31 bits."""
    low = np.uint64((1 << 31) - 1)
    ah, al, bh, bl = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
    middle = ah * bl + al * bh
    return _reduced(((ah * bh) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31)) + al * bl)


@cache
def _powers(base: int) -> np.ndarray:
    """The powers 0 to `HASH_BYTES` of a base."""
    out = np.ones(1, np.uint64)
    while len(out) <= HASH_BYTES:
        out = np.append(out, times(out, np.uint64(pow(base, len(out), PRIME))))
    return out[: HASH_BYTES + 1]


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of bytes other than 0x20 and 0x09 to 0x0D; runs end with their row."""
    solid = ~SPACE[buf]
    first, last = solid.copy(), solid.copy()
    if len(buf):
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        edges = offs[:-1][offs[:-1] < offs[1:]]
        first[edges] = solid[edges]
        ends = offs[1:][offs[:-1] < offs[1:]] - 1
        last[ends] = solid[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(offs, s, "right") - 1


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; equal bytes give equal hashes anywhere.

    Spans are in order and apart. They are taken in runs of about `HASH_BYTES`, whose prefix sums stay below 2^64: those of
    the lower 31 and the upper 30 bits of the powers are kept apart, so each byte needs no division. A longer word is
    digested by itself.
    """
    out, up, down = np.empty(len(s), np.uint64), _powers(BASE), _powers(pow(BASE, -1, PRIME))
    halves = up & np.uint64((1 << 31) - 1), up >> np.uint64(31)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + HASH_BYTES, "right")))
        first, n = s[i], int(e[j - 1] - s[i])
        if n > HASH_BYTES:
            out[i] = int.from_bytes(hashlib.blake2b(buf[first : first + n], digest_size=8).digest(), "little")
        else:
            start, end, value = s[i:j] - first, e[i:j] - first, buf[first : first + n].astype(np.uint64) + np.uint64(1)
            sums = np.zeros((2, n + 1), np.uint64)
            for half, row in zip(halves, sums, strict=True):
                np.cumsum(value * half[:n], out=row[1:])
            low, high = (_reduced(row[end] - row[start]) for row in sums)
            out[i:j] = mix(times(_reduced(low + times(high, np.uint64(1 << 31))), down[start]))
        i = j
    return out
