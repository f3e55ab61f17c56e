"""Near-duplicate detection: MinHash with tensored banding, confirmed on full shingle sets.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D after lower-casing A-Z; a document's set holds its distinct
five-word shingles, or its whole word sequence as one shingle if it is shorter.

1. `sketch`: one pass over the texts gives each document the size and an order-free 128-bit digest of its set,
   `SKETCHES` small keys of `ROWS` minhashes each, and a signature of one byte of each minhash.
2. Documents with equal sets fall into classes by digest; only a class's smallest id goes on.
3. Tensored banding: a table's key combines a pair of small keys, so `SKETCHES * ROWS` minhashes serve
   `SKETCHES * (SKETCHES - 1) / 2` tables of `2 * ROWS` minhashes. A link at similarity 0.75 agrees in no table with
   probability 3.5e-5. Small keys that no other class shares are dropped before pairs are formed.
4. Candidates are checked bucket by bucket (`likely`): two classes of a bucket stay together only if their sizes allow a
   link and `AGREE` of the signatures' bytes agree (a link at 0.75 fails with probability 1e-5, a pair at one third
   passes with 1e-4). A bucket gives a spanning forest, never all pairs; one of more than `BUCKET` classes is split into
   pairs of blocks. So a template that many documents share does not chain them.
5. Classes joined by likely pairs form groups, in which all links are confirmed on full sets: an inverted index over the
   group counts the intersections of one document with all others at once. Small groups share a task of about
   `BIN_SHINGLES` shingles; groups of more than `GROUP_SHINGLES` shingles are split into blocks and each pair of blocks
   is a task, so that none grows with a group. A task returns a spanning forest of its links, never all pairs.
6. Components of the confirmed links, carried back to classes and documents.

Nothing is capped, sampled or collected, but for a Bloom filter of fixed size (`FILTER_BITS`) that spares the second
text pass the documents without a partner; its false positives are dropped by a join.

Defined cases: null, empty and blank texts have no shingle, size 0, are linked with nothing and are kept. Rows without
an id are left out. Rows with equal ids make one document: the one of them with the smallest digest counts. Input
columns beyond id and text do not matter. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.components import components
from siltstone.llm.frames import give_back
from siltstone.llm.textkernel import LOWER, blocks, mix, word_hashes, word_spans
from siltstone.session import ship, stored

SHINGLE = 5
ROWS, SKETCHES = 3, 24
AGREE = 38
BUCKET = 4096
PAIRS = 16  # classes of a bucket up to which all pairs are compared at once
GROUP_SHINGLES, BIN_SHINGLES = 1_500_000, 1_000_000
FILTER_BITS = 1 << 26

_rng = np.random.default_rng(20240229)
_PLACE = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _rng.integers(0, 1 << 63, ROWS * SKETCHES, dtype=np.uint64)
_TIMES = _rng.integers(1, 1 << 62, ROWS * SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each row one after another, row bounds)."""
    n = len(offs) - 1
    s, e, row = word_spans(buf, offs)
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    h = word_hashes(LOWER[buf], s, e)
    words = np.bincount(row, minlength=n)
    first = np.cumsum(words) - words
    count = np.where(words >= SHINGLE, words - SHINGLE + 1, (words > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(count)])
    # the place of each shingle's first word
    start = np.repeat(first - bounds[:-1], count) + np.arange(bounds[-1])
    out = np.zeros(len(start), np.uint64)
    left = np.repeat(np.minimum(words, SHINGLE), count)
    for j in range(SHINGLE):
        use = left > j
        out[use] += h[start[use] + j] * _PLACE[j]
    out = mix(out + left.astype(np.uint64))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a > 1:
            out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[bounds[:-1][count > 0]] = True
    sums = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], sums[bounds]


def first_digest(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)))])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def sketch_block(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, digest 1, digest 2, small keys [row, SKETCHES], signatures [row, ROWS * SKETCHES]) of the sets in a block."""
    sizes = np.diff(bounds)
    some = np.flatnonzero(sizes)
    d = np.zeros((2, len(sizes)), np.uint64)
    keys = np.zeros((len(sizes), SKETCHES), np.uint64)
    signs = np.zeros((len(sizes), SKETCHES * ROWS), np.uint8)
    if len(some):
        at = bounds[:-1][some]
        d[0] = first_digest(h, bounds)
        d[1, some] = np.add.reduceat(mix(h + np.uint64(0x14057B7EF767814F)), at)
        for j in range(SKETCHES):
            key = np.full(len(some), j, np.uint64)
            for i in range(j * ROWS, (j + 1) * ROWS):
                least = np.minimum.reduceat((h ^ _SALT[i]) * _TIMES[i], at)
                key = mix(key * np.uint64(0x2545F4914F6CDD1D) + least)
                signs[some, i] = mix(least) & np.uint64(255)
            keys[some, j] = key
    return sizes, d[0], d[1], keys, signs


def sketch(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, d1, d2, small, sign): sizes, digests, small keys and signatures."""
    ship(df.sparkSession)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("small", T.ArrayType(T.LongType())), T.StructField("sign", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for i, j, buf, offs in blocks(batch.column(1)):
                sizes, d1, d2, keys, signs = sketch_block(*shingles(buf, offs))
                full = sizes > 0
                ends = np.concatenate([[0], np.cumsum(full * SKETCHES)]).astype(np.int32)
                small = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[full].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sizes.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), small, pa.array([x.tobytes() for x in signs], pa.binary())], names=schema.names)
        give_back()

    return df.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, schema)


def sets(df: DataFrame, wanted, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, hashes): first digest and packed 64-bit hashes of the whole sets that pass the filter `wanted`."""
    ship(df.sparkSession)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("digest", T.LongType()), T.StructField("hashes", T.BinaryType())])

    def run(batches):
        bits = wanted.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(passes(bits, ids))
            part = batch.take(pa.array(rows))
            for i, _, buf, offs in blocks(part.column(1)):
                h, bounds = shingles(buf, offs)
                raw = [h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(i, len(raw)), pa.array(first_digest(h, bounds).view(np.int64)), pa.array(raw, pa.binary())], names=schema.names)
        give_back()

    return df.select(F.col(key).cast("long"), F.col(text).cast("string")).where(F.col(key).isNotNull()).mapInArrow(run, schema)


def _places(ids: np.ndarray) -> list[np.ndarray]:
    x = ids.astype(np.int64).view(np.uint64)
    return [mix(x + np.uint64(c)) & np.uint64(FILTER_BITS - 1) for c in (0x9E37, 0x79B9, 0x7F4A)]


def passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.ones(len(ids), bool)
    for p in _places(ids):
        out &= (bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) > 0
    return out


def membership_filter(ids: DataFrame):
    """A broadcast Bloom filter of FILTER_BITS bits over the ids; its size does not depend on their number."""
    ship(ids.sparkSession)

    def run(batches):
        bits = np.zeros(FILTER_BITS >> 6, np.uint64)
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            for p in _places(x):
                np.bitwise_or.at(bits, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].view(np.int64))], names=["w", "b"])

    found = ids.mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(FILTER_BITS >> 6, np.uint64)
    bits[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return ids.sparkSession.sparkContext.broadcast(bits)


def linked(small: int, size_a, size_b):
    """100 * intersection >= 75 * union."""
    return 100 * small >= 75 * (size_a + size_b - small)


def _confirm(pdf):
    import pandas as pd

    pdf = pdf.drop_duplicates("doc_id").sort_values("doc_id")
    found = Group(pdf["doc_id"].to_numpy(), list(pdf["hashes"])).links() if len(pdf) > 1 else []
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def classes_of(sketches: DataFrame) -> DataFrame:
    """(d1, d2, n_shingles, rep, small, sign): one row for each distinct non-empty set; rep is its smallest doc_id."""
    return sketches.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.any_value("small").alias("small"), F.any_value("sign").alias("sign"))


def banded(classes: DataFrame) -> DataFrame:
    """(key, rep, n): the classes of every table key that several share, with their number.

    Keys that are shared are stored before they are joined: the join then shuffles both sides itself and adaptive
    execution can split a hot key.
    """
    small = classes.select("rep", F.explode("small").alias("key"))
    shared = stored(small.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("key"), "shared")
    kept = small.join(shared, "key").groupBy("rep").agg(F.array_sort(F.collect_list("key")).alias("own")).where("size(own) > 1")
    kept = kept.select("rep", "own", F.explode(F.sequence(F.lit(1), F.size("own") - 1)).alias("x"))
    pairs = kept.select("rep", F.element_at("own", F.col("x")).alias("p"), F.explode(F.slice("own", F.col("x") + 1, F.size("own"))).alias("q"))
    tables = stored(pairs.select("rep", F.xxhash64("p", "q").alias("key")), "tables")
    several = stored(tables.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "several")
    return tables.join(several, "key")


def _alike(sizes: np.ndarray, signs: np.ndarray, a, b) -> np.ndarray:
    """Whether the classes at a and at b may be linked."""
    x, y = sizes[a], sizes[b]
    return (4 * np.minimum(x, y) >= 3 * np.maximum(x, y)) & (np.count_nonzero(signs[a] == signs[b], axis=-1) >= AGREE)


class Forest:
    """Trees over n members, grown by probing members for all their partners."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def grow(self, partners) -> list[tuple[int, int]]:
        """(smallest member, member) for every member of a tree.

        First each member that no probe has reached is probed against all members. Two members that are still in
        different trees may be linked all the same, so every member outside the largest tree is then probed as well;
        what is left unprobed lies in one tree.
        """
        n = len(self.parent)
        probed, reached = np.zeros(n, bool), np.zeros(n, bool)

        def probe(i: int) -> None:
            probed[i] = True
            for j in partners(i):
                reached[j] = True
                a, b = self.root(i), self.root(int(j))
                if a != b:
                    self.parent[max(a, b)] = min(a, b)

        for i in range(n):
            if not reached[i]:
                probe(i)
        roots = np.array([self.root(i) for i in range(n)])
        largest = np.bincount(roots).argmax()
        for i in np.flatnonzero((roots != largest) & ~probed):
            probe(int(i))
        return [(self.root(i), i) for i in range(n) if self.root(i) != i]


class Group:
    """Full sets of some classes, with an inverted index from shingle to members."""

    def __init__(self, ids: np.ndarray, raw: list[bytes]):
        self.ids = ids
        self.sets = [np.frombuffer(x, np.uint64) for x in raw]
        self.sizes = np.fromiter(map(len, self.sets), np.int64, len(ids))
        _, self.code = np.unique(np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64), return_inverse=True)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        order = np.argsort(self.code, kind="stable")
        self.members = np.repeat(np.arange(len(ids)), self.sizes)[order]
        self.posting = np.concatenate([[0], np.cumsum(np.bincount(self.code))])

    def partners(self, i: int) -> np.ndarray:
        """All members linked with member i."""
        terms = self.code[self.bounds[i] : self.bounds[i + 1]]
        a, n = self.posting[terms], self.posting[terms + 1] - self.posting[terms]
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(self.members[at], minlength=len(self.ids))
        hit = 100 * both >= 75 * (self.sizes[i] + self.sizes - both)
        hit[i] = False
        return np.flatnonzero(hit)

    def links(self) -> list[tuple[int, int]]:
        """(smallest member, member) for every member of a tree of links; ids are in rising order."""
        return [(int(self.ids[a]), int(self.ids[b])) for a, b in Forest(len(self.ids)).grow(self.partners)]


def bucket_edges(homes: np.ndarray, reps: np.ndarray, sizes: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (smaller, larger) of likely links in whole buckets, whose rows stand together."""
    starts = np.flatnonzero(np.concatenate([[True], homes[1:] != homes[:-1]])) if len(homes) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([starts, [len(homes)]]))
    out = [np.zeros((0, 2), np.int64)]
    few = counts <= PAIRS
    rows = np.repeat(starts[few] - np.cumsum(counts[few]) + counts[few], counts[few]) + np.arange(counts[few].sum())
    after = np.repeat((starts + counts)[few], counts[few]) - rows - 1  # rows of the bucket that follow
    for i in range(0, len(rows), 20_000):
        own, n = rows[i : i + 20_000], after[i : i + 20_000]
        a = np.repeat(own, n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        hit = _alike(sizes, signs, a, b)
        out.append(np.stack([reps[a[hit]], reps[b[hit]]], 1))
    for s, c in zip(starts[~few], counts[~few], strict=True):
        order = s + np.argsort(reps[s : s + c], kind="stable")
        z, g = sizes[order], signs[order]
        found = Forest(c).grow(lambda i: np.flatnonzero(_alike(z, g, i, slice(None))))  # noqa: B023
        if found:
            out.append(reps[order][np.array(found)])
    pairs = np.concatenate(out)
    pairs.sort(1)
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    return pairs[:, 0], pairs[:, 1]


def likely(classes: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of each bucket's pairs that may be linked."""
    rows = banded(classes)
    n = F.ceil(F.col("n") / BUCKET)
    rows = rows.select("key", "rep", F.pmod(F.xxhash64("rep"), n).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("other"))
    rows = rows.select("rep", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("home"))
    rows = rows.join(classes.select("rep", "n_shingles", "sign"), "rep").select("home", "rep", "n_shingles", "sign")

    def run(batches):
        rest = None
        for batch in _then_none(batches):
            table = pa.Table.from_batches([x for x in (rest, batch) if x is not None]) if rest is not None or batch is not None else None
            if table is None:
                return
            homes = table.column(0).to_numpy()
            cut = int(np.searchsorted(homes, homes[-1])) if batch is not None and len(homes) else len(homes)
            whole = table.slice(0, cut)
            if cut:
                raw = whole.column(3).combine_chunks()
                signs = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(cut, ROWS * SKETCHES)
                a, b = bucket_edges(homes[:cut], whole.column(1).to_numpy(), whole.column(2).to_numpy(), signs)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            rest = table.slice(cut).combine_chunks().to_batches()[0] if cut < len(homes) else None

    return rows.repartition("home").sortWithinPartitions("home").mapInArrow(run, "a long, b long")


def _then_none(batches):
    yield from batches
    yield None


def detect(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document."""
    rows = sketch(df.where(F.col(key).isNotNull()), key, text)
    sketches = stored(rows.groupBy("doc_id").agg(F.min(F.struct("d1", "d2", "n_shingles", "small", "sign")).alias("s")).select("doc_id", "s.*"), "sketches")
    classes = stored(classes_of(sketches), "classes")
    groups = stored(components(likely(classes)), "groups")
    wanted = membership_filter(groups.select("node"))
    # a group of ordinary size shares a bin with others, a large one is split into blocks and each pair of blocks is a bin
    placed = stored(groups.join(classes.select(F.col("rep").alias("node"), "d1", "n_shingles"), "node"), "placed")
    sizes = stored(placed.groupBy("component").agg(F.sum("n_shingles").alias("size")), "sizes")
    bins = max(1, -(-(sizes.agg(F.sum("size")).first()[0] or 0) // BIN_SHINGLES))
    blocks_of = F.ceil(F.col("size") / GROUP_SHINGLES)
    placed = placed.join(sizes, "component")
    placed = placed.select("node", "d1", "component", blocks_of.alias("n"), F.when(F.col("size") <= BIN_SHINGLES // 2, F.pmod(F.xxhash64("component"), F.lit(bins))).alias("bin"), F.pmod(F.xxhash64("node"), blocks_of).alias("own"))
    full = sets(df, wanted, key, text).join(placed, (F.col("doc_id") == F.col("node")) & (F.col("digest") == F.col("d1")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other")
    spread = full.select("doc_id", "hashes", "component", "bin", "own", other)
    home = F.when(F.col("bin").isNotNull(), F.struct(F.col("bin").alias("g"), F.lit(-1).cast("long").alias("x"), F.lit(-1).cast("long").alias("y")))
    home = F.coalesce(home, F.struct(F.col("component").alias("g"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")))
    links = spread.select(home.alias("home"), "doc_id", "hashes").groupBy("home").applyInPandas(_confirm, "a long, b long")
    joined = components(links)
    # classes that are linked with others keep their component; all others are their own
    named = stored(classes.join(joined, F.col("rep") == F.col("node"), "left").select("d1", "d2", F.col("n_shingles").alias("n"), F.coalesce("component", "rep").alias("home")), "named")
    same = (F.col("s.d1") == F.col("h.d1")) & (F.col("s.d2") == F.col("h.d2")) & (F.col("n_shingles") == F.col("n"))
    out = sketches.drop("small", "sign").alias("s").join(named.alias("h"), same, "left")
    component = F.coalesce("home", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
