"""Maximal runs of words: brute force over all periods, the query's contract on a small table, odd tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from siltstone.llm import periodic
from siltstone.llm.queries import planted

KIND = "doc_id long, text string"


def by_hand(x, least=12):
    """(start, length, period) by comparing all words at all distances."""
    found = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def row_by_hand(i, text, planting=None):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if planting is not None and words and (how := planting(i, len(words))):
        a, p = how
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    runs = sorted(by_hand(words), key=lambda r: (r[0], r[2]))
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (i, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha(listed), sha(kept))


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_against_brute_force(letters):
    rng = random.Random(letters)
    for _ in range(60):
        docs = []
        for _ in range(rng.randint(1, 6)):
            d = [rng.randrange(letters) for _ in range(rng.randint(0, 110))]
            if d and rng.random() < 0.5:
                a, p = rng.randrange(len(d)), rng.randint(1, max(1, len(d) // 3))
                d = d[:a] + [d[a + (k - a) % p] if a + (k - a) % p < len(d) else 0 for k in range(a, len(d))]
            docs.append(d)
        ends = np.append(0, np.cumsum([len(d) for d in docs]))
        s, n, q = periodic.maximal_runs(np.array([w for d in docs for w in d], np.int64), ends)
        want = [(int(ends[k]) + a, b, c) for k, d in enumerate(docs) for a, b, c in by_hand(d)]
        assert list(zip(s.tolist(), n.tolist(), q.tolist(), strict=True)) == sorted(want, key=lambda r: (r[0], r[2]))


def test_long_slopes_and_long_rotations(monkeypatch):
    monkeypatch.setattr(periodic, "JUMPS", 1)
    monkeypatch.setattr(periodic, "STEPS", 1)
    x = [0] * 900 + [1] + [0, 0, 2] * 400 + [3] + list(range(4, 700)) * 2 + [0, 1]
    s, n, q = periodic.maximal_runs(np.array(x), np.array([0, len(x)]))
    assert list(zip(s.tolist(), n.tolist(), q.tolist(), strict=True)) == by_hand(x)


def texts():
    rng = random.Random(5)
    words = ["a", "b", "é", "日本", "c,", "A"]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    return [*out, None, "", " \n\t ", "x", "x\n" * 40, "\x0bx\x1fy z " * 13, " ".join(map(str, range(300))) * 3]


def test_query_on_a_small_table(spark, tmp_path, monkeypatch):
    from siltstone.llm import queries

    rows = list(enumerate(texts()))
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(rows_of(queries.op12_word_runs(spark, str(tmp_path)))) == [row_by_hand(i, t, planted) for i, t in rows]
    assert any(planted(i, 5) for i, _ in rows)


def test_pieces_of_a_block_change_nothing(spark, monkeypatch):
    want = [row_by_hand(i, t) for i, t in enumerate(texts())]
    import pyarrow as pa

    for words in (1, 7, 1 << 18):
        monkeypatch.setattr(periodic, "WORDS", words)
        found = periodic.describe(pa.array(texts()), range(len(texts())))
        assert [x[3] for x in found] == [r[-1] for r in want]


def test_odd_tables(spark):
    rows = [(None, "a " * 20), (3, "b " * 20), (3, "b " * 20), (4, None), (5, ("p q r " * 400_000))]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], KIND + ", runs string, start int")
    found = periodic.detect(df)
    assert found.columns[:2] == ["doc_id", "text"] and dict(found.dtypes)["start"] == "bigint"
    assert sorted(rows_of(found), key=repr) == sorted([row_by_hand(i, t) if len(t or "") < 99 else (5, 1, 0, 1_200_000, 3, 400_000_000, hashlib.sha256(b"0,1200000,3\n").hexdigest(), hashlib.sha256(b"p q r").hexdigest()) for i, t in rows], key=repr)
    assert rows_of(periodic.detect(spark.createDataFrame([], KIND))) == []
