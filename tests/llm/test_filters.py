"""Language ID, quality votes and URL filtering: held-out accuracy, gradients, brute force and edge cases."""

import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from siltstone.llm import langid, quality, queries, urlfilter

SF = "/root/testdata/sf0.01"


def test_gru_gradient_matches_differences():
    rng = np.random.default_rng(0)
    hidden, items, y = 3, [b"cdec", b"ab", b"a"], np.array([1, 0, 1])
    w = {k: rng.normal(0, 0.5, shape) for k, shape in {"fi": (256, 9), "bi": (256, 9), "fr": (3, 9), "br": (3, 9), "out": (6, 2), "bias": (2,)}.items()}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    offs = np.cumsum([0, *map(len, items)])
    x, active = langid.grid(np.frombuffer(b"".join(items), np.uint8), offs[:-1], np.diff(offs))
    assert active.tolist() == [3, 2, 1, 1] and hidden == w["fr"].shape[0]
    g, _ = langid.gradients(w, x, active, y)
    for name, places in {"fi": [(97, 0), (98, 4), (99, 8)], "bi": [(97, 1), (98, 5), (100, 6)], "fr": [(0, 0), (1, 5), (2, 8)], "br": [(0, 2), (1, 4), (2, 7)], "out": [(0, 0), (5, 1)], "bias": [(0,)]}.items():
        for at in places:
            old = w[name][at]
            losses = []
            for step in (1e-2, -1e-2):
                w[name][at] = old + step
                losses.append(langid.gradients(w, x, active, y)[1])
            w[name][at] = old
            assert abs((losses[0] - losses[1]) / 2e-2 - g[name][at]) < 2e-3


def brute_language(m, text):
    """The same network, byte by byte in double precision."""
    if not text or not any(map(str.isalpha, text)):
        return "und", 0.0
    raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode()
    w = {k: v.astype(float) for k, v in m.weights.items()}
    h = w["fr"].shape[0]
    squash = lambda v: v / (1 + np.abs(v))
    total, n = np.zeros(len(m.labels)), 0
    for i in range(0, len(raw), langid.WINDOW):
        part = raw[i : i + langid.WINDOW]
        states = []
        for inp, rec, seq in ((w["fi"], w["fr"], part), (w["bi"], w["br"], part[::-1])):
            s, own = np.zeros(h), []
            for c in seq:
                u = s @ rec
                z, r = np.split((squash(inp[c, : 2 * h] + u[: 2 * h]) + 1) / 2, 2)
                cand = squash(inp[c, 2 * h :] + r * u[2 * h :])
                s = z * s + (1 - z) * cand
                own.append(s)
            states.append(own)
        for c, f, b in zip(part, states[0], states[1][::-1], strict=True):
            if c >= 128 or 97 <= c <= 122:
                e = np.exp(np.concatenate([f, b]) @ w["out"] + w["bias"])
                total += e / e.sum()
                n += 1
    return m.labels[int((total / n).round(6).argmax())], float((total / n).max())


@pytest.fixture(scope="module")
def tongue():
    en, de = b"the thing and other with", b"der die und nicht eine"
    return langid.train([(en, "en"), (de, "de")] * 30, epochs=200)


def test_language_against_brute_force(spark, tongue, monkeypatch):
    texts = ["the other thing", "Nicht eine\n und die", "x", "é", "THE " * 300, "die und " * 200 + "the", "12 a 34", "—", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.label(df.coalesce(1), tongue).collect()}
    alone = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.label(df.repartition(10), tongue).collect()}
    assert got == alone
    for i, t in enumerate(texts):
        want = brute_language(tongue, t)
        assert got[i][0] == want[0] and got[i][1] == pytest.approx(want[1], abs=1e-4)


def test_registered_languages_against_brute_force(spark, monkeypatch):
    """The registered query labels as the byte-by-byte network with the weights that it has fitted."""
    models = []
    fit = langid.fit
    monkeypatch.setattr(langid, "fit", lambda *a, **b: models.append(fit(*a, **b)) or models[-1])
    path = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.op5_language_id(spark, path).collect()}
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    assert got.keys() == {r["doc_id"] for r in docs}
    for r in [r for r in docs if len(r["text"] or "") < 1500][:40]:
        want = brute_language(models[0], r["text"])
        mine = got[r["doc_id"]]
        assert mine["score"] == pytest.approx(want[1], abs=1e-3) and (mine["lang_pred"] == want[0] or abs(mine["score"] - want[1]) < 1e-3)


def test_language_edge_cases(spark, tongue):
    long_text = "and other " * 60_000 + "x" * 100_000
    rows = [(1, "the other thing", 5), (2, "nicht eine", None), (3, None, 1), (4, "", 2), (5, "12 !! 3", 3), (6, long_text, 4), (1, "the other thing", 5), (7, "—", 6), (8, "É", 7), (None, "the thing", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    out = langid.label(df, tongue).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows)
    assert got[1]["lang_pred"] == "en" and got[2]["lang_pred"] == "de" and got[6]["lang_pred"] == "en" and got[None]["lang_pred"] == "en"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (3, 4, 5, 7))
    assert got[8]["lang_pred"] in ("en", "de") and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.label(df, tongue).columns == ["doc_id", "text", "lang_pred", "score"]
    assert langid.label(df.limit(0), tongue).count() == 0
    empty = df.limit(0).withColumn("lang", F.lit("en"))
    assert langid.fit(empty) is None
    assert {r["lang_pred"] for r in langid.label(df, None).collect()} == {"und"}
    # the text column may have an output's name, and outputs may be called otherwise
    named = df.drop("score").withColumnRenamed("text", "score")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.label(named, tongue, text="score").collect()}[2] == "de"
    assert langid.label(df, tongue, out=("l", "s")).columns == ["doc_id", "text", "score", "l", "s"]


def test_every_language_is_learnt(spark):
    """No label is left out, however many there are and however rare they are."""
    rows = [(i, chr(97 + i % 26) * 2 + chr(97 + i // 26) * 3 + " " + chr(97 + i // 26) * 4, f"l{i:03d}") for i in range(90)]
    m = langid.fit(spark.createDataFrame(rows + [(None, "zz", "none"), (500, None, "nil")], "doc_id long, text string, lang string"), sample=45, epochs=1)
    assert m.labels == [f"l{i:03d}" for i in range(90)]


def test_language_held_out_accuracy(spark):
    got = queries.op5_language_id(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = got.join(truth, "doc_id").where("held_out AND lang_pred <> 'und'")
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    assert got.count() == truth.count()


def test_quality_votes_match_brute_force():
    good, bad = ["A calm line of words, %d of them." % i for i in range(40)], ["BUY!! NOW!! %d!!" % i for i in range(40)]
    m = quality.train(quality.features_of(pa.array(good + bad)), [1] * 40 + [0] * 40, rank=8, k=5)
    texts = ["A calm line of other words.", "SELL!! NOW!! 7!!", ""]
    x = quality.features_of(pa.array(texts))
    v = x @ m.projection
    want = []
    for row in v:
        n = np.linalg.norm(row)
        if n == 0:
            want.append(m.prior)
            continue
        s = m.vectors @ (row / max(n, 1e-12))
        near = sorted(range(len(s)), key=lambda i: (-s[i], i))[:5]
        w = [max(s[i], 1e-6) ** 4 * m.weights[i] for i in near]
        want.append(sum(a * m.labels[i] for a, i in zip(w, near, strict=True)) / sum(w))
    assert np.allclose(m.scores(x), want, atol=1e-5)
    assert m.scores(x)[0] > 0.5 > m.scores(x)[1]


def test_quality_blocks_do_not_matter():
    texts = pa.array(["One two two.", None, "", "x" * 3000, "A|B|C\nd !!", "é è"] * 3)
    whole = quality.features_of(texts)
    single = np.concatenate([quality.features_of(texts.slice(i, 1)) for i in range(len(texts))])
    assert np.allclose(whole, single)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(None, "fine words", 0)] + [(i, f"fine words number {i}" if i % 2 else f"BAD!! {i}!!", 0) for i in range(40)] + [(90, None, 0), (91, "", 0), (92, "fine words " * 200_000, 0)], "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1), (None, 1), (91, None)], "doc_id long, quality int")
    m = quality.fit(docs, labels, rank=4, k=5)
    got = {r["doc_id"]: r for r in quality.score(docs, m).collect()}
    assert got[1]["predicted"] == 1 and got[2]["predicted"] == 0 and got[92]["predicted"] == 1
    assert got[90]["score"] == got[91]["score"] == pytest.approx(m.prior)
    assert quality.fit(docs, labels.limit(0)) is None
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(docs.limit(0), m).count() == 0
    # the text column may have an output's name, and outputs may be called otherwise
    named = docs.drop("predicted").withColumnRenamed("text", "score")
    assert {r["doc_id"]: r["predicted"] for r in quality.score(named, m, text="score").collect()}[1] == 1
    assert quality.score(docs, m, out=("s", "p")).columns == ["doc_id", "text", "predicted", "s", "p"]
    # equal texts get equal scores in any batch
    again = quality.score(docs.repartition(7), m).collect()
    assert {(r["doc_id"], r["score"]) for r in again} == {(k, r["score"]) for k, r in got.items()}


def test_quality_fit_holds_one_dense_matrix(spark):
    """The driver's memory: neither copies nor a matrix of double precision beside the one that is factored."""
    n = 2000
    docs = spark.createDataFrame([(i, f"fine words number {i}" if i % 2 else f"BAD!! {i}!!") for i in range(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, quality int")
    tracemalloc.start()
    try:
        m = quality.fit(docs, labels, per_label=n, rank=4, k=5)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(m.vectors) == n
    assert most < 2 * n * quality.DIMS * 4


def test_registered_votes_against_brute_force(spark, monkeypatch):
    models = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a, **b: models.append(fit(*a, **b)) or models[-1])
    path = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.op3_quality_votes(spark, path).collect()}
    m = models[0]
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    assert got.keys() == {r["doc_id"] for r in docs}
    for r in docs:
        v = quality.features_of(pa.array([r["text"]]))[0].astype(float) @ m.projection
        size = math.sqrt(sum(c * c for c in v))
        want = m.prior
        if size:
            sims = [round(float(sum(a * b for a, b in zip(v / size, other, strict=True))), 9) for other in m.vectors]
            near = sorted(range(len(sims)), key=lambda i: (-sims[i], i))[: m.k]
            votes = [max(sims[i], 1e-6) ** 4 * m.weights[i] for i in near]
            want = sum(a * m.labels[i] for a, i in zip(votes, near, strict=True)) / sum(votes)
        assert got[r["doc_id"]]["score"] == pytest.approx(want, abs=2e-6)


def test_quality_held_out_accuracy(spark):
    got = queries.op3_quality_votes(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    both = got.where("held_out").join(labels, "doc_id")
    rates = both.groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).collect()
    assert all(r[1] > 0.9 for r in rates)


URLS = ["http://a.example.com/de/1", "https://B.net/x?q#f", "http://x.example.net/en/5", "http://example.net/en", "http://q.org/fr/9.html", "http://other.org/en/1", None, "no scheme", "", "http://net", "x://h?p/q", "http://evilnet/", "ftp://a.com/é ü"]


def brute_parts(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    i = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    tail = rest[i:]
    j = min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:i]), tail[:j]


def test_url_rules_against_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(URLS)) + [(0, URLS[0])], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = urlfilter.judge(df, queries.RULES).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path = brute_parts(URLS[r["page_id"]])
        best = None
        for text, what in queries.RULES:
            h, _, p = text.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(text) > len(best[0])):
                best = (text, what)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0])
        assert r["verdict"] == best[1] if best else r["verdict"] in ("allow", "block")


def test_url_ratio_against_brute_force(spark):
    pages = [(i, u) for i, u in enumerate(["http://abc.net/x1", "http://abd.net/y22", "http://abc.example.net/en/1", "http://q.org/fr/2", "http://q.org/en/77", "http://abc.com/x1?q=7&r", "http://abc.com/x1#top", "http://abc.com/" + "long/" * 20_000])]
    got = {r["page_id"]: r for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string"), queries.RULES).collect()}

    def norm(u):
        h, p = brute_parts(u)
        seen = u.split("://", 1)[1].split("#")[0].lower()
        assert seen.startswith(h + p.lower())
        return "".join("0" if c.isdigit() else c if c.islower() or c in "./_-" else "~" for c in seen)

    counts = {"a": Counter(), "r": Counter()}
    for i, u in pages:
        side = {"allow": "a", "block": "r"}.get(got[i]["verdict"]) if got[i]["rule"] else None
        if side:
            s = "^^^" + norm(u) + "$"
            for j in range(3, len(s)):
                for k in range(4):
                    counts[side]["n", k, s[j - k : j + 1]] += 1
                    counts[side]["c", k, s[j - k : j]] += 1

    def p(side, s, j):
        out = 1 / 33
        for k in range(4):
            out = (counts[side]["n", k, s[j - k : j + 1]] + 5 * out) / (counts[side]["c", k, s[j - k : j]] + 5)
        return out

    for i, u in pages:
        s = "^^^" + norm(u) + "$"
        want = sum(math.log(p("a", s, j)) - math.log(p("r", s, j)) for j in range(3, len(s))) / (len(s) - 3)
        assert got[i]["score"] == pytest.approx(want, abs=2e-6)


def test_urls_without_both_kinds_are_allowed(spark):
    df = spark.createDataFrame([(1, "http://a.com/x"), (2, None)], "page_id long, url string")
    assert {(r["verdict"], r["score"]) for r in urlfilter.judge(df, queries.RULES).collect()} == {("allow", 0.0)}
    assert urlfilter.judge(df.limit(0), queries.RULES).count() == 0
