"""Word hashes: against a plain polynomial, long words, and the words that collide modulo powers of two."""

import random

import numpy as np
import pytest
from siltstone.llm import neardup, textkernel
from siltstone.llm.textkernel import BASE, HASH_BYTES, PRIME, mix, word_hashes, word_spans


def hashes(words):
    buf = np.frombuffer(b" ".join(words), np.uint8)
    s, e, _ = word_spans(buf, np.array([0, len(buf)]))
    assert len(s) == len(words)
    return word_hashes(buf, s, e)


def thue_morse(n, one=b"a", two=b"b"):
    return b"".join(two if i.bit_count() % 2 else one for i in range(n))


def test_against_plain_polynomial():
    rng = random.Random(1)
    words = [bytes(rng.choice(range(33, 256)) for _ in range(rng.randint(1, 60))) for _ in range(500)]
    want = [sum((c + 1) * pow(BASE, i, PRIME) for i, c in enumerate(w)) % PRIME for w in words]
    assert hashes(words).tolist() == mix(np.array(want, np.uint64)).tolist()


def test_place_and_runs_do_not_matter():
    rng = random.Random(2)
    words = [b"x" * rng.randint(1, 3000) for _ in range(300)]
    found = hashes(words)
    assert {len(w): int(h) for w, h in zip(words, found, strict=True)} == {len(w): int(hashes([w])[0]) for w in words}
    assert len({int(h) for h in found}) == len(set(words))


@pytest.mark.parametrize("n", [256, 1024, 2048, 4096, 16384, 65536, 1 << 18])
def test_thue_morse_words_differ(n):
    a, b = thue_morse(n), thue_morse(n, b"b", b"a")
    assert len({int(h) for h in hashes([a, b, a + b, b + a])}) == 4
    x, y = neardup.shingles(np.frombuffer(a + b, np.uint8), np.array([0, n, 2 * n]))
    assert x[0] != x[1]


def test_words_longer_than_a_run():
    long = b"q" * (HASH_BYTES + 1)
    found = hashes([b"a", long, b"b", long, long + b"q", b"q" * HASH_BYTES])
    assert found[1] == found[3] and len({int(x) for x in found}) == 5


def test_products():
    a = np.array([0, 1, PRIME - 1, PRIME // 2, 12345678901234567], np.uint64)
    for b in a:
        assert textkernel.times(a, b).tolist() == [int(x) * int(b) % PRIME for x in a]
