"""Alignment of two tokenizers over the same texts: groups of tokens between common ends, and links between tokens.

A text with a space before it is encoded by a byte-level BPE (A) and by a piece model with byte fallback (B). Every byte
gets a label: no token ends here, a token of A ends, one of B, or both. A regular expression takes the string of labels
apart into spans that each run up to a label of both; the labels counted in a span say how many tokens of A and of B
form a group. Between two neighbouring labels lies a stretch of one token of A and one of B: that is one link.

`groups` gives tokens and groups of each document. `align` also counts how often each pair of ids is linked in the whole
corpus, and gives each document the sum of these counts over its links and the number of links that are the most common
ones of their id of B.

Where both models provably cut a text before a blank that follows a letter (`Tokenizers.cut_at_blanks`), `align` takes
texts apart there: tokens, groups and links of a text are those of its segments one after another. Each distinct segment
is encoded and aligned once and kept in a table of bounded size that is emptied when full; the counts, the digest and the
pairs of a document are put together from those of its segments. A text with a segment that is not its own tokens is
encoded whole.

How `align` runs: tasks encode their documents in chunks of about `CHUNK` bytes (a longer text makes one of its own) and
store for each document the places of its pairs in the chunk's list of distinct pairs, with counts. Only the lists are
taken apart and summed over the corpus; the totals go back to the chunks that asked for them and meet their documents in
one group a chunk, which is bounded. The most common count of each id of B is broadcast: one row an id of the vocabulary.

Defined cases: null and empty texts, and texts whose joined token bytes of A or B are not the text with its space (a model
may rewrite letters), have no tokens: all counts are 0 and the digest is an empty string. Special tokens' strings are
ordinary text. Repeated rows, with equal or no ids, count each. Very long texts are encoded whole. Empty tables give empty
tables. Columns beyond the id and the text are not looked at by `align`; `groups` replaces those named like its outputs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.frames import append_columns, give_back, small_batches
from siltstone.llm.textkernel import flat
from siltstone.session import ship, stored

CHUNK = 8 << 20  # bytes of text whose distinct pairs are listed together
PIECE = 1 << 20  # bytes of text that are encoded together
ROWS = 1024  # of an Arrow batch
DIGITS = 6
NONE, A_END, B_END, BOTH = b".ABC"  # labels of a byte
SPANS = re.compile(b"[^C]*C")
BLANKS = re.compile(r"(?<=\S) (?!\Z)")  # a text is cut here: after a letter, but not at the end of the text
SEGMENTS, LETTERS = 1 << 19, 8 << 20  # of the table of segments


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Tokenizers:
    """Both tokenizers as they are sent to tasks, and the bytes of their entries."""

    a_json: str
    b_model: bytes

    def entries(self) -> tuple[list[bytes], list[bytes]]:
        import sentencepiece

        letters, model = byte_of_letter(), json.loads(self.a_json)
        vocabulary = model["model"]["vocab"] | {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            a[i] = bytes(letters[c] for c in entry)
        b_of = sentencepiece.SentencePieceProcessor(model_proto=self.b_model)
        pieces = [b_of.id_to_piece(i) for i in range(b_of.get_piece_size())]
        b = [bytes([int(p[3:5], 16)]) if b_of.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        return a, b

    def cut_at_blanks(self) -> bool:
        """Whether no token of A or B reaches over a blank after a letter, so that what lies on either side stands alone.

        A's words (a regular expression that takes blanks only before letters) end there. B joins letters into pieces of
        its vocabulary, none of which holds its mark for a blank after another letter, and it rewrites nothing else.
        """
        from sentencepiece import sentencepiece_model_pb2

        a = json.loads(self.a_json)
        words = a.get("pre_tokenizer") or {}
        b = sentencepiece_model_pb2.ModelProto.FromString(self.b_model)
        how, kinds = b.normalizer_spec, {p.type for p in b.pieces}
        return (
            (a.get("normalizer"), a.get("post_processor"), a["model"]["type"]) == (None, None, "BPE")
            and (words.get("type"), words.get("use_regex"), words.get("add_prefix_space")) == ("ByteLevel", True, False)
            and b.trainer_spec.model_type == b.trainer_spec.BPE
            and not b.trainer_spec.treat_whitespace_as_suffix
            and how.add_dummy_prefix and how.escape_whitespaces and not how.remove_extra_whitespaces and not how.precompiled_charsmap
            and b.pieces[0].USER_DEFINED not in kinds
            and not any("▁" in p.piece.lstrip("▁") for p in b.pieces)
        )

    def n_b(self) -> int:
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.b_model).get_piece_size()


def load(a_path: str, b_path: str) -> Tokenizers:
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:  # driver-side parameters
        return Tokenizers(a.read(), b.read())


class Entries:
    """The bytes of a vocabulary's entries, and its ids as digits."""

    def __init__(self, entries: list[bytes]):
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        self.length = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.length) - self.length
        ids = np.arange(len(entries))
        powers = 10 ** np.arange(DIGITS - 1, -1, -1)
        shown = (ids[:, None] >= powers) | (powers == 1)
        # right-aligned, zeros stand for nothing, and a column is left for a separator
        self.text = np.zeros((len(ids), DIGITS + 1), np.uint8)
        self.text[:, :-1] = np.where(shown, ids[:, None] // powers % 10 + 48, 0)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        width = self.length[ids]
        to = np.cumsum(width)
        return self.data[np.repeat(self.start[ids] - (to - width), width) + np.arange(to[-1] if len(to) else 0)]


@dataclass
class Aligned:
    """Tokens of a run of documents one after another, their groups, and their linked pairs."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray  # by document
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    group_end: np.ndarray  # byte after each group, in all texts together
    group_a: np.ndarray  # tokens of A in each group
    group_b: np.ndarray
    bytes: np.ndarray  # by document
    shown: list[bytes]  # the ids of each document by groups
    pair_doc: np.ndarray
    pair: np.ndarray  # id of A times the size of B's vocabulary plus id of B
    pair_n: np.ndarray

    @property
    def digest(self) -> list[str]:
        return _digests(self.shown)


def _digests(shown: Iterable[bytes]) -> list[str]:
    return [hashlib.sha256(s).hexdigest() if s else "" for s in shown]


class Aligner:
    def __init__(self, both: Tokenizers):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        import sentencepiece
        from tokenizers import Tokenizer

        if len(both.b_model) == 0 or not both.a_json:
            raise ValueError("both tokenizers are needed")
        self._a = Tokenizer.from_str(both.a_json)
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_proto=both.b_model)
        a, b = both.entries()
        self.a, self.b, self.size_b = Entries(a), Entries(b), len(b)

    def encode(self, texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(ids, tokens of each text) by A and by B."""
        of_a = [e.ids for e in self._a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        out = []
        for ids in (of_a, self._b.encode(texts, num_threads=1)):
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            out.append((np.fromiter(chain.from_iterable(ids), np.int64, count.sum()), count))
        return out[0], out[1]

    def __call__(self, texts: list[str | None]) -> Aligned:
        real = np.array([bool(t) for t in texts], bool)
        raw, offs = flat(pa.array([" " + t for t, ok in zip(texts, real, strict=True) if ok], pa.large_string()))
        size, n = np.diff(offs), len(texts)
        tokens = self.encode([t for t, ok in zip(texts, real, strict=True) if ok])
        good = np.ones(len(size), bool)
        for (ids, count), of in zip(tokens, (self.a, self.b), strict=True):
            got, to = of.joined(ids), np.append(0, np.cumsum(count))
            long = np.append(0, np.cumsum(of.length[ids]))[to]
            fits = np.diff(long) == size
            if fits.all():  # every text lies where its tokens do
                wrong = np.flatnonzero(got != raw)
                fits[np.searchsorted(offs, wrong, "right") - 1] = False
            else:
                for k in np.flatnonzero(fits):
                    fits[k] = np.array_equal(got[long[k] : long[k + 1]], raw[offs[k] : offs[k + 1]])
            good &= fits
        (a, n_a), (b, n_b) = (x if good.all() else (x[0][np.repeat(good, x[1])], x[1] * good) for x in tokens)
        size = size * good
        # labels
        label = np.full(int(size.sum()), NONE, np.uint8)
        a_end, b_end = np.cumsum(self.a.length[a]) - 1, np.cumsum(self.b.length[b]) - 1
        label[a_end] = A_END
        label[b_end] = np.where(label[b_end] == A_END, BOTH, B_END)
        group_end = np.cumsum(np.fromiter(map(len, SPANS.findall(label.tobytes())), np.int64))
        at = np.flatnonzero(label != NONE)
        is_a, is_b = label[at] != B_END, label[at] != A_END
        done_a, done_b = np.cumsum(is_a), np.cumsum(is_b)
        last = np.searchsorted(at, group_end - 1)
        group_a, group_b = np.diff(done_a[last], prepend=0), np.diff(done_b[last], prepend=0)
        # documents of tokens, groups and links
        ends = np.cumsum(size)
        group_doc, link_doc = np.searchsorted(ends, group_end - 1, "right"), np.searchsorted(ends, at, "right")
        link = (link_doc << 32) + a[done_a - is_a] * self.size_b + b[done_b - is_b]
        link, link_n = np.unique(link, return_counts=True)
        where = np.flatnonzero(real)
        spread = lambda x: np.bincount(where, weights=x, minlength=n).astype(np.int64)
        count = lambda x: spread(np.bincount(x, minlength=len(size)))
        shown = [b""] * n
        for k, s in zip(where, self._shown(a, b, group_a, group_b, group_doc, n_a + n_b), strict=True):
            shown[k] = s
        return Aligned(a, b, spread(n_a), spread(n_b), count(group_doc), count(link_doc), group_end, group_a, group_b, spread(size), shown, where[link >> 32], link & 0xFFFFFFFF, link_n)

    def _shown(self, a, b, group_a, group_b, group_doc, tokens) -> list[bytes]:
        """The ids of each document in order of groups, those of A before those of B."""
        to_a, to_b = np.cumsum(group_a), np.cumsum(group_b)
        out = np.empty((len(a) + len(b), DIGITS + 1), np.uint8)
        at_a = np.arange(len(a)) + np.repeat(to_b - group_b, group_a)
        at_b = np.arange(len(b)) + np.repeat(to_a, group_b)
        out[at_a], out[at_b] = self.a.text[a], self.b.text[b]
        out[:, -1] = ord(",")
        out[to_a + to_b - group_b - 1, -1] = ord("|")
        final = np.append(group_doc[1:] != group_doc[:-1], True) if len(group_doc) else np.zeros(0, bool)
        out[to_a + to_b - 1, -1] = np.where(final, 0, ord(";"))
        shown = out != 0
        ends = np.append(0, np.cumsum(shown.sum(1)))[np.append(0, np.cumsum(tokens))]
        text = out[shown].tobytes()
        return [text[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


class Numbers(dict):
    """Segments by number; those that were not known get the next one and are listed in `new`."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, segment: str) -> int:
        self[segment] = n = len(self)
        self.new.append(segment)
        return n


@dataclass
class Counted:
    """Counts of documents, the digests of their groups, and their linked pairs."""

    counts: np.ndarray  # a row each of `COUNTS`, a column a document
    bytes: np.ndarray
    digest: list[str]
    pair_doc: np.ndarray
    pair: np.ndarray
    pair_n: np.ndarray


class Counter:
    """Counts of documents from those of their segments, each of which is aligned once."""

    def __init__(self, both: Tokenizers):
        self.aligner, self.cut = Aligner(both), both.cut_at_blanks()
        self._clear()

    def _clear(self) -> None:
        self.number, self.letters, self.shown = Numbers(), 0, []
        self.counts = np.zeros((len(COUNTS) + 1, 0), np.int64)  # the last row: bytes
        self.n_pairs = self.pair = self.pair_n = np.zeros(0, np.int64)

    def _numbers(self, cut: list[list[str]]) -> np.ndarray:
        """The numbers of all segments one after another; what is new among them is aligned."""
        code = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        new, self.number.new = self.number.new, []
        parts = [self.aligner(new[i:j]) for i, j in pieces(new)]
        if parts:
            self.letters += sum(map(len, new))
            self.shown += chain.from_iterable(x.shown for x in parts)
            self.counts = np.concatenate([self.counts, *(np.stack([*(getattr(x, c) for c in COUNTS), x.bytes]) for x in parts)], axis=1)
            self.n_pairs = np.concatenate([self.n_pairs, *(np.bincount(x.pair_doc, minlength=len(x.n_a)) for x in parts)])
            self.pair, self.pair_n = (np.concatenate([own, *(getattr(x, c) for x in parts)]) for own, c in ((self.pair, "pair"), (self.pair_n, "pair_n")))
        return code

    def __call__(self, texts: list[str | None]) -> Counted:
        if len(self.number) > SEGMENTS or self.letters > LETTERS:
            self._clear()
        n = len(texts)
        cut = [([t] if not self.cut else BLANKS.split(t)) if t else [] for t in texts]
        code = self._numbers(cut)
        size = np.fromiter(map(len, cut), np.int64, n)
        doc = np.repeat(np.arange(n), size)
        wrong = np.unique(doc[self.counts[0, code] == 0])
        wrong = wrong[size[wrong] > 1]
        if len(wrong):  # such texts are judged whole
            for k in wrong:
                cut[k] = [texts[k]]
            code, size = self._numbers(cut), np.fromiter(map(len, cut), np.int64, n)
            doc = np.repeat(np.arange(n), size)
        *counts, long = (np.bincount(doc, weights=x[code], minlength=n).astype(np.int64) for x in self.counts)
        ends, listed = np.cumsum(size), code.tolist()
        digest = _digests(b";".join([self.shown[c] for c in listed[j - m : j]]) for j, m in zip(ends.tolist(), size.tolist(), strict=True))
        # pairs of each document, from its distinct segments
        own, times = np.unique((doc << 32) + code, return_counts=True)
        of = own & 0xFFFFFFFF
        each = self.n_pairs[of]
        at = np.repeat((np.cumsum(self.n_pairs) - self.n_pairs)[of] - np.cumsum(each) + each, each) + np.arange(each.sum())
        pair, pair_n = (np.repeat(own >> 32, each) << 32) + self.pair[at], np.repeat(times, each) * self.pair_n[at]
        order = np.argsort(pair, kind="stable")
        pair, pair_n = pair[order], pair_n[order]
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        if len(first):
            pair, pair_n = pair[first], np.add.reduceat(pair_n, first)
        return Counted(np.array(counts), long, digest, pair >> 32, pair & 0xFFFFFFFF, pair_n)


def pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `PIECE` letters."""
    first, letters = 0, 0
    for i, t in enumerate(texts):
        letters += len(t or "")
        if letters >= PIECE:
            yield first, i + 1
            first, letters = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


GROUP = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("a", T.ArrayType(T.IntegerType())), T.StructField("b", T.ArrayType(T.IntegerType()))])


def groups(docs: DataFrame, both: Tokenizers, keep: list[str] | None = None) -> DataFrame:
    """`docs` with token_groups: the bytes that each group spans in the text with its space, and its ids of A and B."""
    text = docs.columns.index("text")

    def make():
        aligner = Aligner(both)

        def apply(batch):
            texts, out = batch.column(text).to_pylist(), []
            for i, j in pieces(texts):
                x = aligner(texts[i:j])
                a_to, b_to, start = np.append(0, np.cumsum(x.group_a)), np.append(0, np.cumsum(x.group_b)), np.append(0, x.group_end)
                g = 0
                for first, n in zip(np.cumsum(x.bytes) - x.bytes, x.n_groups, strict=True):
                    out.append([{"start": int(start[k] - first), "end": int(start[k + 1] - first), "a": x.a[a_to[k] : a_to[k + 1]].tolist(), "b": x.b[b_to[k] : b_to[k + 1]].tolist()} for k in range(g, g + n)])
                    g += n
            return [out]

        return apply

    return append_columns(docs, [T.StructField("token_groups", T.ArrayType(GROUP))], make, keep)


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
DOC = T.StructType([*(T.StructField(n, T.LongType()) for n in COUNTS), T.StructField("groups_sha256", T.StringType())])
#: A row is a document (its id and counts, and the places of its pairs in the chunk's list) or a chunk's list (pairs and counts).
STORED = [T.StructField("_chunk", T.LongType()), *DOC, T.StructField("_places", T.BinaryType()), T.StructField("_counts", T.BinaryType()), T.StructField("_pairs", T.ArrayType(T.LongType())), T.StructField("_sums", T.ArrayType(T.LongType()))]


def _encoded(docs: DataFrame, both: Tokenizers) -> DataFrame:
    """Rows of `STORED` with the id of each document, one list after the documents of each chunk."""
    schema = T.StructType([docs.schema.fields[0], *STORED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, task, chunk = Counter(both), TaskContext.get().partitionId(), 0
        ids, parts, letters = [], [], 0

        def flush() -> pa.RecordBatch:
            every = np.concatenate([x.pair for x in parts])
            pairs, place = np.unique(every, return_inverse=True)
            counts = np.concatenate([x.pair_n for x in parts])
            cuts = np.append(0, np.cumsum(np.concatenate([np.bincount(x.pair_doc, minlength=len(x.bytes)) for x in parts])))
            n, known = len(cuts) - 1, pa.concat_arrays(ids)
            place, small = place.astype("<u4"), counts.astype("<u4")
            cut = lambda x: pa.array([*(x[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)), None], pa.binary())
            sums = np.bincount(place, weights=counts, minlength=len(pairs)).astype(np.int64)
            columns = [pa.concat_arrays([known, pa.nulls(1, known.type)]), pa.array(np.full(n + 1, (task << 32) + chunk))]
            columns += [pa.array([*np.concatenate([x.counts[c] for x in parts]), None], pa.int64()) for c in range(len(COUNTS))]
            columns += [pa.array([*(d for x in parts for d in x.digest), None], pa.string()), cut(place), cut(small)]
            columns += [pa.array([*[None] * n, x.tolist()], pa.list_(pa.int64())) for x in (pairs, sums)]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        try:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for i, j in pieces(texts):
                    parts.append(counter(texts[i:j]))
                    ids.append(batch.column(0).slice(i, j - i))
                    letters += int(parts[-1].bytes.sum())
                    if letters >= CHUNK:
                        yield flush()
                        ids, parts, letters, chunk = [], [], 0, chunk + 1
            if parts:
                yield flush()
        finally:
            del counter
            give_back()

    return docs.mapInArrow(run, schema)


def align(docs: DataFrame, both: Tokenizers, key: str = "doc_id") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of a table with key and text."""
    spark = docs.sparkSession
    ship(spark)
    with small_batches(spark, ROWS):
        rows = stored(_encoded(docs.select(key, F.col("text").cast("string")), both), "encoded")
    size_b = both.n_b()
    listed = rows.where(F.col("_pairs").isNotNull()).select("_chunk", F.posexplode(F.arrays_zip("_pairs", "_sums")).alias("_place", "_x"))
    listed = listed.select("_chunk", "_place", F.col("_x._pairs").alias("_pair"), F.col("_x._sums").alias("_n"))
    totals = stored(listed.groupBy("_pair").agg(F.sum("_n").alias("_total")), "pairs")
    most = totals.groupBy(F.pmod("_pair", F.lit(size_b)).alias("_b")).agg(F.max("_total").alias("_most"))  # a row an id of B
    totals = stored(totals.join(F.broadcast(most), F.pmod("_pair", F.lit(size_b)) == F.col("_b")).select("_pair", "_total", (F.col("_total") == F.col("_most")).alias("_best")), "totals")
    answers = listed.drop("_n").join(totals, "_pair").select(F.col("_chunk").alias("_of"), F.col("_place").alias("_spot"), "_total", "_best")
    schema = T.StructType([rows.schema[key], *DOC, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    names = [key, *DOC.names]

    def meet(found: pa.Table, known: pa.Table) -> pa.Table:
        place = known.column("_spot").to_numpy()
        total, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        total[place], best[place] = known.column("_total").to_numpy(), known.column("_best").to_numpy(zero_copy_only=False)
        sums = []
        for at, n in zip(found.column("_places").to_pylist(), found.column("_counts").to_pylist(), strict=True):
            at, n = np.frombuffer(at, "<u4"), np.frombuffer(n, "<u4").astype(np.int64)
            sums.append((int(n @ best[at]), int(n @ total[at])))
        best_of, sum_of = zip(*sums, strict=True) if sums else ((), ())
        return pa.table([*(found.column(c) for c in names), pa.array(best_of, pa.int64()), pa.array(sum_of, pa.int64())], names=schema.names)

    docs_of = rows.where(F.col("_pairs").isNull()).select("_chunk", *names, "_places", "_counts")
    out = docs_of.groupBy("_chunk").cogroup(answers.groupBy("_of")).applyInArrow(meet, schema)
    return out.select(key, *COUNTS, "n_best", "count_sum", "groups_sha256")
