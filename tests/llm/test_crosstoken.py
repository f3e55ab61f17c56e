"""Alignment of two tokenizers: the query against a plain version, spans of groups, chunks, odd tables."""

import base64
import hashlib
from collections import Counter

import pytest
from siltstone.llm import crosstoken
from siltstone.llm.queries import BYTES, PIECES, RANKS

KIND = "doc_id long, text string"


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    with open(RANKS, "rb") as f:
        entry = {int(i): base64.b64decode(t) for t, i in map(bytes.split, f)}
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") else p.replace("▁", " ").encode()

    def tokens(text):
        """([(id, bytes)] of A, the same of B), or none where they are not the text."""
        if not text:
            return [], []
        x = [(i, entry[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, piece(i)) for i in b.encode(text)]
        want = (" " + text).encode()
        return (x, y) if all(b"".join(t for _, t in z) == want for z in (x, y)) else ([], [])

    return tokens


def spans(tokens):
    at, out = 0, []
    for i, t in tokens:
        out.append((at, at + len(t), i))
        at += len(t)
    return out


def by_hand(rows, tokens):
    parts, linked = [], Counter()
    for i, text in rows:
        a, b = map(spans, tokens(text))
        pairs = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        linked.update(pairs)
        ends = sorted({x[1] for x in a} & {y[1] for y in b})
        start, groups = 0, []
        for e in ends:
            groups.append((start, e, [x[2] for x in a if start < x[1] <= e], [y[2] for y in b if start < y[1] <= e]))
            start = e
        parts.append((i, len(a), len(b), groups, pairs))
    most = Counter()
    for (_, y), n in linked.items():
        most[y] = max(most[y], n)
    show = lambda g: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for _, _, x, y in g)
    rows = [(i, na, nb, len(g), len(p), sum(linked[x] == most[x[1]] for x in p), sum(linked[x] for x in p), hashlib.sha256(show(g).encode()).hexdigest() if g else "") for i, na, nb, g, p in parts]
    return rows, [g for *_, g, _ in parts]


TEXTS = [
    None, "", " ", "a", "  two  blanks\n\n\ttab ", "naïve façade, 12345 und Straße", "日本語テキスト 🙂🙂 é", "<|endoftext|> <s> </s> <0x41> <unk>",
    "it is ▁ here", " x\u0085y z", "zero\x00byte", "repeat " * 400, "\r\n" * 50, "𝔘𝔫𝔦 ﬁ é", "don't we'll I'M", "a" * 3000,
]


@pytest.mark.parametrize("chunk", [200, 8 << 20])
def test_query_against_plain_version(spark, tmp_path, plain, monkeypatch, chunk):
    from siltstone.llm import queries

    sample = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(25).collect()]
    rows = list(enumerate([*TEXTS, *(t[:1500] for t in sample), "a", "repeat " * 3]))
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(crosstoken, "CHUNK", chunk)
    found = queries.op13_token_groups(spark, str(tmp_path))
    order = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(found.columns) == sorted(order)
    assert sorted(tuple(r[c] for c in order) for r in found.collect()) == by_hand(rows, plain)[0]


def test_groups_and_small_pieces(spark, plain, monkeypatch):
    rows = list(enumerate(TEXTS))
    want = by_hand(rows, plain)[1]
    both = crosstoken.load(BYTES, PIECES)
    df = spark.createDataFrame([(*r, "old") for r in rows], KIND + ", token_groups string")
    found = {r.doc_id: [tuple(g) for g in r.token_groups] for r in crosstoken.groups(df, both, keep=["doc_id"]).collect()}
    assert found == dict(enumerate(want))
    monkeypatch.setattr(crosstoken, "PIECE", 5)
    aligner = crosstoken.Aligner(both)
    got = [aligner(TEXTS[i:j]) for i, j in crosstoken.pieces(TEXTS)]
    assert len(got) > 5
    assert [d for x in got for d in x.digest] == aligner(TEXTS).digest


def test_odd_tables(spark, plain):
    both = crosstoken.load(BYTES, PIECES)
    rows = [(None, "x y"), (None, "x y"), (4, "x y"), (4, None), (5, "word " * 300_000)]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], KIND + ", _chunk int, n_a string")
    found = sorted((tuple(r) for r in crosstoken.align(df, both).collect()), key=repr)
    assert [r[0] for r in found] == [4, 4, 5, None, None]
    assert found[3] == found[4] and found[3][1:] == found[0][1:] or found[3][1:] == found[1][1:]
    long = next(r for r in found if r[0] == 5)
    assert long[1] >= 300_000 and long[3] >= 300_000
    assert crosstoken.align(spark.createDataFrame([], KIND), both).collect() == []
    assert crosstoken.align(spark.createDataFrame([(1, None)], KIND), both).collect()[0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_segments_are_aligned_once_and_give_what_whole_texts_give(monkeypatch):
    import random

    both = crosstoken.load(BYTES, PIECES)
    assert both.cut_at_blanks()
    rng, whole = random.Random(5), crosstoken.Aligner(both)
    parts = [" ", "  ", "\n", "\t", "\u0085", "\xa0", "᠎", "​", "a", "É", "12", "'s", "!", "▁", "▁▁", "<s>", "<|endoftext|>", "日本", "🙂", "\x00", "\x1c", "the", "́"]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    for limit in (crosstoken.SEGMENTS, 50):
        monkeypatch.setattr(crosstoken, "SEGMENTS", limit)
        counter = crosstoken.Counter(both)
        for i in range(0, len(texts), 500):
            x, y = whole(texts[i : i + 500]), counter(texts[i : i + 500])
            assert [getattr(x, c).tolist() for c in crosstoken.COUNTS] == y.counts.tolist() and x.digest == y.digest
            assert all((getattr(x, c) == getattr(y, c)).all() for c in ("bytes", "pair_doc", "pair", "pair_n"))
    # words that come again are not encoded again
    counter, seen, encode = crosstoken.Counter(both), [], crosstoken.Aligner.encode
    monkeypatch.setattr(crosstoken.Aligner, "encode", lambda self, texts: seen.extend(texts) or encode(self, texts))
    counter(["one two " * 500 + "one", "two one"]), counter(["two one two"])
    assert sorted(seen) == ["one", "two"]
    # models that are not known to end their tokens at blanks see whole texts
    other = crosstoken.Tokenizers(both.a_json.replace('"use_regex":true', '"use_regex":false').replace('"use_regex": true', '"use_regex": false'), both.b_model)
    assert not other.cut_at_blanks()
