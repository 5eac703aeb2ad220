"""Periodic runs against every stretch and period tried one by one."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from gridloom.llm import periodic_runs as pr
from tests.llm.helpers import cases, empty


def plain_runs(w, least=24, times=3):
    n, out = len(w), {}
    for q in range(1, n // times + 1):
        s = 0
        while s < n - q:
            e = s
            while e < n - q and w[e] == w[e + q]:
                e += 1
            if e > s and e - s + q >= max(least, times * q):
                out.setdefault((s, e - s + q), q)
            s = max(e, s) + 1
    return sorted([(s, length, q) for (s, length), q in out.items()], key=lambda r: (r[0], r[2]))


def made_texts(seed, many):
    rng = random.Random(seed)
    for _ in range(many):
        alphabet = rng.choice([1, 2, 2, 3, 5, 50])
        w = []
        for _ in range(rng.randint(0, 6)):
            part = [str(rng.randrange(alphabet)) for _ in range(rng.randint(1, 14))]
            w += part * rng.choice([1, 1, 2, 3, 4, 9])
            if rng.random() < 0.4:
                w += part[: rng.randint(0, len(part))]
        yield w


@pytest.mark.parametrize("seed", range(8))
def test_runs_are_those_of_brute_force(seed):
    documents = [[x.encode() for x in w] for w in made_texts(seed, 150)]
    found = pr.runs_of(documents)
    for k, w in enumerate(documents):
        assert found.get(k, []) == plain_runs(w), w
    assert sum(map(len, found.values())) > 20


def test_short_runs_of_any_exponent():
    """The array itself, without the windows: least length 2 and two periods give all runs."""
    rng = random.Random(5)
    for _ in range(300):
        x = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(2, 40))]
        assert pr.runs(np.array(x), 2, 2) == plain_runs(x, 2, 2), x


def test_one_word_many_times_and_long_periods():
    x = [b"w"] * 60_000
    y = [str(i).encode() for i in range(9_000)] * 4 + [b"0"]
    found = pr.runs_of([x, y, x[:23]])
    assert found == {0: [(0, 60_000, 1)], 1: [(0, 36_001, 9_000)]}
    assert pr.collapsed(y, found[1]) == y[:9_000]


def test_tail_is_rewritten_as_defined():
    for i in range(300):
        words = [str(k).encode() for k in range(i % 41)]
        h, n = zlib.crc32(str(i).encode()), len(words)
        want = words
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            want = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        assert pr.repeated_tail(i, words) == want
    assert pr.repeated_tail(None, [b"a"]) == [b"a"]


def test_rows_of_the_cases(spark):
    df = cases(spark)
    got = [r.asDict() for r in pr.find_runs(df).collect()]
    assert len(got) == df.count()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = [(r.doc_id, r.text or "") for r in df.collect()]
    want = []
    for i, t in texts:
        w = pr.repeated_tail(i, t.encode().split())
        if len(w) > 1000:
            continue
        found = plain_runs(w)
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        want.append((i, len(found), best and best[0], sha("".join(f"{s},{n},{q}\n" for s, n, q in found))))
    small = [(r["doc_id"], r["n_runs"], r["start"], r["runs_sha256"]) for r in got if r["n_words"] <= 1000]
    assert sorted(map(str, small)) == sorted(map(str, want))
    long = next(r for r in got if r["doc_id"] == 9)
    assert (long["n_runs"], long["period"], long["exponent_milli"]) == (1, 2, 30_000_000) or zlib.crc32(b"9") % 10 == 0
    null = next(r for r in got if r["doc_id"] == 2)
    assert null["n_words"] == null["n_runs"] == 0 and null["start"] is None and null["collapsed_sha256"] == sha("")
    assert pr.find_runs(empty(spark)).count() == 0
