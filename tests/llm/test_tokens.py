"""Unigram pieces, token attribution, mixing and revisits: round trips, brute force and edge cases."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from siltstone.llm import mixing, queries, tokencount, unigram, warc


def tiny():
    pieces = ["<unk>", "<s>", *[f"<0x{i:02X}>" for i in range(256)], "▁", "a", "b", "c", "ab", "▁a", "▁ab", "bc", "abc", "é", "▁▁"]
    kinds = np.array([2, 3] + [6] * 256 + [1] * 11)
    scores = np.array([0.0] * 258 + [-5, -4, -4.5, -4.2, -6, -5.5, -7, -6.5, -9, -8, -30])
    return unigram.build(pieces, scores, kinds)


def best_by_hand(v, text):
    """Score of the best segmentation, by trying every piece at every place."""
    chars = ("▁" + text.replace(" ", "▁")) if text else ""
    known = {p: v.scores[i] for i, p in enumerate(v.pieces) if v.kinds[i] == 1}
    best = [0.0] + [-math.inf] * len(chars)
    for i in range(len(chars)):
        for j in range(i + 1, len(chars) + 1):
            if chars[i:j] in known:
                best[j] = max(best[j], best[i] + known[chars[i:j]])
        if chars[i] not in known:
            best[i + 1] = max(best[i + 1], best[i] + v.floor)
    return best[-1]


def score_of(v, ids):
    total, run = 0.0, 0
    raw = b""
    for i in ids:
        if v.kinds[i] == unigram.BYTE:
            raw += bytes([int(v.pieces[i][3:5], 16)])
        else:
            total += v.scores[i]
    run = len(raw.decode("utf-8"))
    return total + run * v.floor


def test_viterbi_against_brute_force():
    v, rng = tiny(), random.Random(3)
    texts = ["".join(rng.choice("aabbcé x日\n") for _ in range(rng.randint(0, 25))) for _ in range(300)]
    encode, decode = unigram.Encoder(v), unigram.Decoder(v)
    ids, counts = encode(texts)
    at = 0
    for t, n in zip(texts, counts, strict=True):
        assert score_of(v, ids[at : at + n]) == pytest.approx(best_by_hand(v, t))
        at += n
    raw, offs = decode(ids, counts)
    assert [raw[a:b].tobytes().decode() for a, b in zip(offs[:-1], offs[1:], strict=True)] == texts


def test_cache_and_cutting_change_nothing(monkeypatch):
    v = tiny()
    texts = ["abc ab", "b  c\nabc", "日本 a"] * 4
    whole = unigram.Encoder(v)
    whole.cutter = None
    a, _ = whole([t.replace(" ", " ") for t in texts])
    # without cutting, words begin with the mark just as well
    b, _ = unigram.Encoder(v)(texts)
    monkeypatch.setattr(unigram, "CACHE", 2)
    c, _ = unigram.Encoder(v)(texts)
    assert list(b) == list(c) and len(a) == len(b)


def test_double_array_holds_exactly_its_keys():
    keys = [b"a", b"ab", b"abc", b"b", "é".encode(), b"\xff\x00"]
    base, check, value = unigram.double_array(keys, list(range(len(keys))))

    def find(k):
        s = 0
        for c in k:
            n = base[s] + c
            if base[s] < 0 or check[n] != s:
                return -1
            s = n
        return value[s]

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert [find(k) for k in (b"", b"c", b"abcd", b"\xff", b"bb")] == [-1] * 5


def test_pieces_of_the_file_match_the_library(spark):
    sp = pytest.importorskip("sentencepiece")
    import struct

    raw = open(queries.PIECES, "rb").read()
    # the same pieces as a unigram model; runs of blanks get a score that single precision can add up
    raw = raw.replace(struct.pack("<f", -1e9), struct.pack("<f", -60000.0))
    trainer = [x for n, x in unigram._fields(raw) if n == 2][0]
    lib = sp.SentencePieceProcessor(model_proto=raw.replace(trainer, trainer.replace(b"\x18\x02", b"\x18\x01", 1), 1))
    mine = unigram.Encoder(unigram.parse(raw))
    docs = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    lines = [x for t in docs for x in t.split("\n")[:3] if x][:300]
    ids, counts = mine(lines)
    at = 0
    for t, n in zip(lines, counts, strict=True):
        assert list(ids[at : at + n]) == lib.encode(t)
        at += n


def test_encode_and_decode_frames(spark):
    v = tiny()
    df = spark.createDataFrame([(1, "abc ab"), (2, None), (3, ""), (4, "日\n" * 5000), (1, "abc ab")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = unigram.decode(unigram.encode(df, v), v)
    for r in out.collect():
        assert r["decoded"] == r["text"] and (r["ids"] is None) == (r["text"] is None)
    assert unigram.encode(df.limit(0), v).count() == 0
    d = {r["doc_id"]: r for r in unigram.digest(df, v).collect()}
    assert d[2]["n_pieces"] is None and d[3]["n_pieces"] == 0 and d[4]["round_trip"] and d[4]["n_byte_pieces"] == 4 * 5000


def test_attribution_rules():
    ends, bounds = np.array([2, 6, 7]), np.array([0, 3, 7])
    assert list(tokencount.attribute(ends, bounds, "start")) == [2, 1]
    assert list(tokencount.attribute(ends, bounds, "most")) == [1, 2]
    assert list(tokencount.attribute(ends, bounds, "share")) == [1.25, 1.75]
    # a token over three sections, and equal parts
    assert list(tokencount.attribute(np.array([6]), np.array([0, 2, 4, 6]), "most")) == [1, 0, 0]
    assert list(tokencount.attribute(np.array([6]), np.array([0, 2, 4, 6]), "share")) == pytest.approx([1 / 3] * 3)


def test_line_tokens_against_offsets(spark):
    import tiktoken

    v = tokencount.load(queries.RANKS, queries.PATTERN)
    texts = ["One line\n\n\ntwo lines\n", "no break", "", None, "\n", "é\n日本 x\n" * 2000, "a\n\nb"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    enc = tiktoken.Encoding("t", pat_str=v.pattern, mergeable_ranks=v.ranks, special_tokens={})
    for rule in tokencount.RULES:
        for r in tokencount.per_line(df, v, rule).collect():
            t = texts[r["doc_id"]]
            if t is None:
                assert r["line_tokens"] is None
                continue
            lines = t.encode().splitlines(keepends=True)
            owner = [k for k, x in enumerate(lines) for _ in x]
            want, at = [0.0] * len(lines), 0
            for token in enc.encode_ordinary(t):
                size = len(enc.decode_single_token_bytes(token))
                own = owner[at : at + size]
                for k in set(own):
                    most = max(own.count(x) for x in own)
                    first = next(x for x in own if own.count(x) == most)
                    want[k] += {"start": own[0] == k, "most": first == k, "share": own.count(k) / size}[rule]
                at += size
            assert r["line_tokens"] == pytest.approx(want)
            assert r["n_tokens"] == len(enc.encode_ordinary(t))
    assert tokencount.per_line(df.limit(0), v).count() == 0
    with pytest.raises(ValueError):
        tokencount.per_line(df, v, "none")


SHARES = [("a", 10, 1000), ("b", 5, 100), ("c", 3, 10), (None, 1, 10), ("z", 2, 0)]


def test_exponents(spark):
    src = spark.createDataFrame(SHARES, "source string, n_docs long, n_tokens long")
    p = np.array([1000, 100, 10, 10]) / 1120

    def entropy(a):
        w = p**a / (p**a).sum()
        return -(w * np.log(w)).sum()

    for target in (0.6, 1.0, 1.3):
        a = mixing.weights(src, entropy=target).first()["exponent"]
        assert entropy(a) == pytest.approx(target, abs=1e-6)
    assert mixing.weights(src, entropy=9.0).first()["exponent"] == pytest.approx(0, abs=1e-9)
    assert mixing.weights(src, entropy=0.0).first()["exponent"] == 1.0
    a = mixing.weights(src, repeats=4.0).first()["exponent"]
    assert (p.min() / p.max()) ** (a - 1) == pytest.approx(4.0)
    assert mixing.weights(src, repeats=1000.0).first()["exponent"] == 0.0
    w = {r["source"]: r["weight"] for r in mixing.weights(src, repeats=4.0).collect()}
    assert sum(w.values()) == pytest.approx(1) and w["z"] == 0
    with pytest.raises(ValueError):
        mixing.weights(src)
    assert mixing.weights(src.limit(0), repeats=2.0).count() == 0


def docs_of(spark):
    rng = random.Random(5)
    rows = [(i, "big" if i % 2 else "mid" if i % 4 else None, rng.randint(0, 50)) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


def test_schedule_against_brute_force(spark):
    docs = docs_of(spark)
    plan = mixing.budgets(mixing.weights(mixing.source_tokens(docs), repeats=1.5))
    give = {r["source"]: r for r in plan.collect()}
    got = mixing.schedule(docs.withColumns({"start": F.lit("clash"), "place": F.lit("clash")}), plan, block_tokens=-(-sum(r["tokens"] for r in give.values()) // 8)).collect()
    rows = docs.collect()
    want = {}
    for s, g in give.items():
        own = [r for r in rows if r["source"] == s]
        for epoch in range(g["whole"] + (g["rest"] > 0)):
            at = spark.createDataFrame([(r["doc_id"],) for r in own], "doc_id long").select("doc_id", mixing.place(1, F.lit(epoch), "doc_id").alias("p")).collect()
            order = {r["doc_id"]: r["p"] for r in at}
            run = 0
            for r in sorted(own, key=lambda r: order[r["doc_id"]]):
                if epoch < g["whole"] or run < g["rest"]:
                    start = epoch * g["n_tokens"] + run
                    want[r["doc_id"], epoch] = (start, min(start * 8 // max(g["tokens"], 1), 7))
                run += r["n_tokens"]
    assert {(r["doc_id"], r["epoch"]): (r["start"], r["block"]) for r in got} == want
    # the copies of a block are permuted together: all sources lie in one order by the second hash
    by_block = defaultdict(list)
    for r in got:
        by_block[r["block"]].append(r)
    mixed = {(r["epoch"], r["doc_id"]): r["m"] for r in spark.createDataFrame([(r["epoch"], r["doc_id"]) for r in got], "epoch long, doc_id long").select("epoch", "doc_id", mixing.place(1, F.col("epoch"), "doc_id", 16).alias("m")).collect()}
    for own in by_block.values():
        own.sort(key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(1, len(own) + 1))
        assert [mixed[r["epoch"], r["doc_id"]] for r in own] == sorted(mixed[r["epoch"], r["doc_id"]] for r in own)
    # every block holds each source in proportion to its weight
    per = defaultdict(int)
    for r in got:
        per[r["source"], r["block"]] += r["n_tokens"]
    for (s, _), n in per.items():
        assert abs(n - give[s]["tokens"] / 8) <= 100


def test_repeat_takes_the_same_copies(spark):
    docs = docs_of(spark)
    plan = mixing.budgets(mixing.weights(mixing.source_tokens(docs), repeats=1.5)).cache()
    copies = mixing.schedule(docs, plan).groupBy("doc_id").count()
    rows = mixing.repeat(docs.withColumn("extra", F.lit("x")), plan, mixing.cuts(docs, plan))
    assert rows.columns == ["doc_id", "source", "n_tokens", "extra"]
    assert {tuple(r) for r in rows.groupBy("doc_id").count().collect()} == {tuple(r) for r in copies.collect()}
    assert docs.join(rows, "doc_id", "left_anti").count() == 0


def test_mixing_of_odd_tables(spark):
    empty = docs_of(spark).limit(0)
    plan = mixing.budgets(mixing.weights(mixing.source_tokens(empty), repeats=2.0))
    assert mixing.schedule(empty, plan).count() == 0
    assert mixing.repeat(empty, plan, mixing.cuts(empty, plan)).count() == 0
    blank = spark.createDataFrame([(1, "s", 0), (2, "s", 0), (2, "s", 0)], "doc_id long, source string, n_tokens long")
    plan = mixing.budgets(mixing.weights(mixing.source_tokens(blank), repeats=2.0))
    assert mixing.repeat(blank, plan, mixing.cuts(blank, plan)).count() == 3
    assert mixing.schedule(blank, plan, block_tokens=1).count() == 3
    # many rows without a token lie in many blocks; repeated rows and rows without an id are kept
    odd = spark.createDataFrame([(i, "empty", 0) for i in range(300)] + [(None, "full", 40), (None, "full", 40), (7, "full", 40)], "doc_id long, source string, n_tokens long")
    plan = mixing.budgets(mixing.weights(mixing.source_tokens(odd), repeats=2.0))
    got = mixing.schedule(odd, plan, block_tokens=10).collect()
    assert len(got) == 303 and len({r["block"] for r in got if r["source"] == "empty"}) > 5
    clash = odd.withColumns({"_copy": F.lit("a"), "_source": F.lit("b"), "_cut": F.lit("c")})
    assert mixing.repeat(clash, plan, mixing.cuts(odd, plan)).where("_copy = 'a' AND _source = 'b' AND _cut = 'c'").count() == 303
    texts = spark.createDataFrame([(None,), ("",), (" \t",), ("a b\nc",)], "text string")
    assert [r[0] for r in texts.select(mixing.tokens()).collect()] == [0, 0, 0, 3]


def records(spark, rows):
    return spark.createDataFrame(rows, "record_id long, kind string, url string, ts long, status int, etag string, last_modified string, digest string, headers map<string,string>")


def test_revisits(spark):
    rows = [
        (1, "response", "http://www.A.com/x/?utm_s=1", 10, 200, '"e1"', "lm", "d1", {"content-type": "text/html", "date": "old", "vary": "a"}),
        (2, "response", "https://a.com/x#f", 20, 200, '"e2"', "lm", "d2", {"date": "mid"}),
        (3, "revisit", "http://a.com/x", 15, 304, 'W/"e1"', None, None, {"date": "new", "content-length": "0"}),
        (4, "revisit", "http://a.com/x", 30, 304, '"e1"', None, None, {"date": "x"}),
        (5, "revisit", "http://a.com/x", 10, 304, '"e1"', None, None, None),
        (6, "revisit", "http://b.com/", 99, 304, None, None, None, None),
        (7, "revisit", None, 50, 304, None, None, None, None),
        (8, "revisit", "http://a.com/x", None, 304, None, None, None, None),
        (9, "revisit", "http://a.com/x", 25, 304, None, None, None, None),
        (10, "revisit", "http://a.com/x", 26, 304, None, "lm", None, None),
        (11, "request", "http://a.com/x", 26, 304, None, "lm", None, None),
        (12, "response", "http://a.com/x", 20, 200, '"e0"', None, None, None),
    ]
    got = {r["record_id"]: r for r in warc.resolve(records(spark, rows).withColumn("outcome", F.lit("clash"))).collect()}
    assert set(got) == {3, 4, 5, 6, 7, 8, 9, 10}
    assert (got[3]["source_id"], got[3]["outcome"], got[3]["status"]) == (1, "resolved", 200)
    assert got[3]["headers"] == {"content-type": "text/html", "date": "new", "vary": "a"}
    assert (got[4]["source_id"], got[4]["outcome"], got[4]["headers"]) == (12, "mismatch", {"date": "x"})
    assert [got[i]["outcome"] for i in (5, 6, 7, 8)] == ["orphan"] * 4
    assert (got[9]["source_id"], got[9]["outcome"]) == (12, "unverified")
    assert got[10]["outcome"] == "unverified"
    assert warc.resolve(records(spark, [])).count() == 0


def test_bursts_and_stray_times_are_cut_evenly(spark, monkeypatch):
    monkeypatch.setattr(warc, "SLICES", 16)
    times = [*range(10**6, 10**6 + 800), 1, 10**15, None]
    rows = spark.createDataFrame([(t,) for t in times], "ts long")
    sizes = [r["count"] for r in warc.sliced(rows).where("ts IS NOT NULL").groupBy("slice").count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 150
    assert warc.sliced(rows.limit(0)).count() == 0


def test_odd_revisits(spark):
    long_url = "http://h.com/" + "a" * 200_000
    rows = [(1, "response", long_url, 1, 200, "x", None, None, None), (2, "revisit", long_url, 5, 304, "x", None, None, {"etag": "x"}), (2, "revisit", long_url, 5, 304, "x", None, None, {"etag": "x"})]
    got = warc.resolve(records(spark, rows)).collect()
    assert [(r["source_id"], r["outcome"]) for r in got] == [(1, "resolved")] * 2


@pytest.mark.parametrize("slices", [1024, 5])
def test_revisits_against_brute_force(spark, monkeypatch, slices):
    monkeypatch.setattr(warc, "SLICES", slices)
    rng = random.Random(8)
    rows = [(i, rng.choice(["response", "revisit"]), f"http://h.com/{rng.choice('aaaaab')}", rng.randint(0, 300), 200, rng.choice(["x", "y"]), None, None, {}) for i in range(500)]
    got = {r["record_id"]: r["source_id"] for r in warc.resolve(records(spark, rows)).collect()}
    for r in rows:
        if r[1] == "revisit":
            before = [(o[3], o[0]) for o in rows if o[1] == "response" and o[2] == r[2] and o[3] < r[3]]
            assert got[r[0]] == (max(before)[1] if before else None)


def test_pages_without_html_and_lengths_in_bytes(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", None), (2, "http://a.org/y", "é")], "page_id long, url string, html string")
    found = {r.record_id: r.headers for r in warc.records_of(pages).where("kind = 'response'").collect()}
    assert [found[i]["content-length"] for i in (2, 4)] == ["0", "2"]
    assert {r.outcome for r in warc.resolve(warc.records_of(pages)).collect()} == {"resolved"}
