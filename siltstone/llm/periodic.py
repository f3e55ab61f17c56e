"""Maximal runs of repeated words, by tandem repeats of a suffix tree.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and a length of at least
max(`LEAST`, 2 q) that no neighbouring word extends with that period.

How it works, for a block of documents at once, with whole-array operations:

1. `suffix_order` sorts the suffixes of the word sequence by prefix doubling; only suffixes that are still tied go on.
   Documents are told apart by the first key, so nothing is ever shared between two of them. The lengths of common
   prefixes of neighbours follow from the ranks of all doublings.
2. `inner_nodes`: an inner node of the suffix tree is an interval of the order, bounded by the nearest smaller common
   prefixes; its children lie between those that are equal.
3. `branching_repeats`: a leaf list is a slice of the order. For each node of word depth D, every leaf i outside its
   largest child is tested: if i + D (or i - D) is in the node's leaf list and the next words differ, then a tandem repeat
   of period D ends there. Leaves outside the largest child are n log n at most over all nodes.
4. `maximal_runs` rotates each repeat to the left while the words D apart agree, and merges repeats of the same stretch
   into one run, with the smallest period.

Documents do not depend on one another and are never shuffled: one pass over the table, in blocks of about 2 MB of text
(a longer text is a block of its own; it takes 4 bytes a word for each doubling of its longest repeat).

Defined cases: words are `[^\\x20\\x09-\\x0D]+`, compared byte by byte. Null, empty and blank texts have no words and no
runs; the digests are those of empty strings. Equal texts with equal ids get equal rows. Very long texts are taken whole.
An empty table gives an empty table. Input columns named like an output are replaced; null ids are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltstone.llm.frames import append_columns
from siltstone.llm.textkernel import SPACE, blocks, word_spans

LEAST = 12  # words of the shortest run
STEPS = 32  # rotations that all repeats take side by side
JUMPS = 64  # pointer jumps that all intervals take side by side
WORDS = 1 << 18  # gathered at once


def suffix_order(x: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each suffix, common prefix of each with the one before it).

    `doc` and `end` give each word's document and that document's end. Different documents share no prefix.
    """
    n = len(x)
    key = doc * (int(x.max()) + 1) + x
    sa = np.argsort(key)
    tied = np.zeros(n, bool)
    tied[1:] = key[sa[1:]] == key[sa[:-1]]
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(tied, 0, np.arange(n)))
    levels, h = [rank], 1
    pairs = np.flatnonzero(tied)
    at = np.flatnonzero(tied | np.append(tied[1:], False))
    while len(at):
        who = sa[at]
        then = who + h
        second = np.where(then < end[who], rank[np.minimum(then, n - 1)] + 1, 0)
        both = rank[who].astype(np.int64) * (n + 1) + second
        order = np.argsort(both)
        both, sa[at] = both[order], who[order]
        same = np.zeros(len(at), bool)
        same[1:] = both[1:] == both[:-1]
        rank = rank.copy()
        rank[sa[at]] = at[np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))]
        levels.append(rank)
        at, h = at[same | np.append(same[1:], False)], 2 * h
    a, b = sa[pairs - 1], sa[pairs]
    stop, far = end[a], np.zeros(len(pairs), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.maximum(a, b) + far < stop
        i, j = np.minimum(a + far, n - 1), np.minimum(b + far, n - 1)
        far += (inside & (levels[k][i] == levels[k][j])).astype(np.int64) << k
    lcp = np.zeros(n, np.int64)
    lcp[pairs] = far
    return sa, rank, lcp


def nearest_smaller(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each index of `at`, the nearest one before it with a smaller value; v[0] must be smaller than all of them."""
    p = np.arange(-1, len(v) - 1)
    todo = at[v[p[at]] >= v[at]]
    for _ in range(JUMPS):
        if not len(todo):
            return p[at]
        p[todo] = p[p[todo]]
        todo = todo[v[p[todo]] >= v[todo]]
    for k in todo:  # few: those behind long slopes
        width = 256
        while not len(found := np.flatnonzero(v[max(0, p[k] - width) : p[k]] < v[k])):
            p[k], width = max(0, p[k] - width), 2 * width
        p[k] = max(0, p[k] - width) + found[-1]
    return p[at]


def inner_nodes(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, depth) of the inner nodes, and (node, bounds) of their children, as slices of the suffix order.

    The children of a node are bounded by consecutive entries of its bounds, the first of which is its left.
    """
    at, n = np.flatnonzero(lcp > 0), len(lcp)
    left = nearest_smaller(np.append(-1, lcp), at + 1) - 1
    right = n - nearest_smaller(np.append(-1, lcp[::-1]), n - at[::-1])[::-1]
    # an interval and its depth are known by their left end and depth
    order = np.argsort(left * (int(lcp.max()) + 1) + lcp[at], kind="stable")
    at, left, right = at[order], left[order], right[order]
    new = np.ones(len(at), bool)
    new[1:] = (left[1:] != left[:-1]) | (lcp[at[1:]] != lcp[at[:-1]])
    first = np.flatnonzero(new)
    node = np.cumsum(new) - 1
    # left end, inner bounds, right end of each node in a row
    bounds = np.insert(at, first, left[first])
    owner = np.insert(node, first, np.arange(len(first)))
    return left[first], right[first], lcp[at[first]], owner, bounds


def branching_repeats(x: np.ndarray, end: np.ndarray, sa: np.ndarray, rank: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the tandem repeats that the word after them does not continue."""
    if not lcp.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right, depth, owner, bounds = inner_nodes(lcp)
    last = np.append(owner[1:] != owner[:-1], True)
    stop = np.where(last, right[owner], np.append(bounds[1:], 0))
    size = stop - bounds
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    most = np.maximum.reduceat(size, starts)
    # of children of equal size the first one is the largest
    largest = np.flatnonzero(size == most[owner])
    largest = largest[np.append(True, owner[largest[1:]] != owner[largest[:-1]])]
    small = np.ones(len(size), bool)
    small[largest] = False
    b, size, owner = bounds[small], size[small], owner[small]
    slot = np.repeat(b - (np.cumsum(size) - size), size) + np.arange(size.sum())
    of = np.repeat(owner, size)
    i, d, lo, hi, n = sa[slot], depth[of], left[of], right[of], len(x)

    def ends(i: np.ndarray, d: np.ndarray) -> np.ndarray:
        e = i + 2 * d
        return (e >= end[i]) | (x[np.minimum(e, n - 1)] != x[i + d])

    found = []
    for step in (d, -d):
        j = i + step
        r = rank[np.clip(j, 0, n - 1)]
        hit = np.flatnonzero((j >= 0) & (j < n) & (r >= lo) & (r < hi))
        s, q = np.minimum(i[hit], j[hit]), d[hit]
        keep = ends(s, q)
        found.append((s[keep], q[keep]))
    s, q = (np.concatenate(c) for c in zip(*found, strict=True))
    one = np.unique(s * (n + 1) + q)
    return one // (n + 1), one % (n + 1)


def maximal_runs(x: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, ordered by start and period.

    `x` holds the word numbers of all documents, one after another; `bounds` holds the documents' ends, from 0 on.
    """
    none = np.zeros(0, np.int64)
    if not len(x):
        return none, none, none
    count = np.diff(bounds)
    doc = np.repeat(np.arange(len(count)), count)
    end, begin = bounds[1:][doc], bounds[:-1][doc]
    s, q = branching_repeats(x, end, *suffix_order(x, doc, end))
    stop, floor = s + 2 * q, begin[s]
    go = np.arange(len(s))
    for _ in range(STEPS):
        go = go[s[go] > floor[go]]
        go = go[x[s[go] - 1] == x[s[go] - 1 + q[go]]]
        s[go] -= 1
    for k in go:
        width, at, p, low = 256, int(s[k]), int(q[k]), int(floor[k])
        while at > low:
            b = max(low, at - width)
            differ = np.flatnonzero(x[b:at] != x[b + p : at + p])
            at = b + int(differ[-1]) + 1 if len(differ) else b
            if len(differ):
                break
            width *= 2
        s[k] = at
    long = stop - s >= least
    s, stop, q = s[long], stop[long], q[long]
    order = np.lexsort((q, stop, s))
    s, stop, q = s[order], stop[order], q[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (stop[1:] != stop[:-1])
    s, stop, q = s[first], stop[first], q[first]
    order = np.lexsort((q, s))
    return s[order], (stop - s)[order], q[order]


def word_numbers(buf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words and for no others; the words are the bytes of `buf` beyond white space."""
    data, offs = buf[~SPACE[buf]], np.append(0, np.cumsum(length))
    words = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offs), pa.py_buffer(data)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


#: Changes to the words of a document before runs are looked for: (id, number of words) -> (a, p) or None; each word from a on
#: becomes word a + (i - a) % p.
Planting = Callable[[object, int], "tuple[int, int] | None"]


def _hashed(buf: np.ndarray, s: np.ndarray, e: np.ndarray, doc: np.ndarray, docs: int) -> list[str]:
    """SHA-256 of each document's words joined by one space."""
    sums = [hashlib.sha256() for _ in range(docs)]
    for a in range(0, len(s), WORDS):
        b = min(a + WORDS, len(s))
        # a space stands before every word but the first one of its document
        lead = (doc[a:b] == (doc[a - 1 : b - 1] if a else np.append(-1, doc[: b - 1]))).astype(np.int64)
        width = e[a:b] - s[a:b] + lead
        to = np.cumsum(width)
        source = np.repeat(s[a:b] - lead - (to - width), width) + np.arange(to[-1])
        out = buf[source]
        out[(to - width)[lead > 0]] = 0x20
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(doc[a:b]) != 0)), b - a)
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            sums[doc[a + i]].update(out[to[i] - width[i] : to[j - 1]])
    return [h.hexdigest() for h in sums]


def describe(column: pa.Array, ids: Sequence, planting: Planting | None = None) -> Iterator[tuple]:
    """For each text (runs, longest run or None, digest of the runs, digest of the text without repeats).

    Runs are (start, length, period). A word is left out if any run holds it after the run's first period.
    """
    for a, b, buf, offs in blocks(column):
        s, e, doc = word_spans(buf, offs)
        count = np.bincount(doc, minlength=b - a)
        bounds = np.append(0, np.cumsum(count))
        x, use = word_numbers(buf, e - s), np.arange(len(s))
        if planting is not None:
            for k in np.flatnonzero(count):
                if (how := planting(ids[a + k], int(count[k]))) is not None:
                    at, p = bounds[k] + how[0], how[1]
                    use[at : bounds[k + 1]] = at + np.arange(bounds[k + 1] - at) % p
            x = x[use]
        start, length, period = maximal_runs(x, bounds)
        change = np.zeros(len(x) + 1, np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, start + length, -1)
        kept = np.flatnonzero(np.cumsum(change)[:-1] == 0)
        texts = _hashed(buf, s[use[kept]], e[use[kept]], doc[kept], b - a)
        cut = np.searchsorted(start, bounds)
        for k in range(b - a):
            i, j = cut[k], cut[k + 1]
            runs = list(zip((start[i:j] - bounds[k]).tolist(), length[i:j].tolist(), period[i:j].tolist(), strict=True))
            listed = "".join(f"{u},{v},{w}\n" for u, v, w in runs)
            yield runs, min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None), hashlib.sha256(listed.encode()).hexdigest(), texts[k]


RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def detect(docs: DataFrame, planting: Planting | None = None, key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with runs, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    long = lambda n: T.StructField(n, T.LongType())
    fields = [T.StructField("runs", T.ArrayType(RUN)), *map(long, ("n_runs", "start", "length", "period", "exponent_milli"))]
    fields += [T.StructField(n, T.StringType()) for n in ("runs_sha256", "collapsed_sha256")]
    names = docs.columns
    text, ids = names.index("text"), names.index(key)

    def make():
        def apply(batch):
            out = []
            for runs, best, listed, collapsed in describe(batch.column(text), batch.column(ids).to_pylist(), planting):
                milli = best and 1000 * best[1] // best[2]
                out.append(([dict(zip(RUN.names, r, strict=True)) for r in runs], len(runs), *(best or (None,) * 3), milli, listed, collapsed))
            return list(zip(*out, strict=True)) or [[]] * len(fields)

        return apply

    return append_columns(docs, fields, make, keep)
