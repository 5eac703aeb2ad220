import os
import random
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import near_dedup as nd
from tests.llm.helpers import CASES, DOCS, cases, empty

FIXTURE = os.environ.get("TEST_DATA_DIR", "/root/testdata") + "/sf0.001/documents.parquet"


def lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, best[j] = best[j], before + 1 if x == y else max(best[j], best[j - 1])
    return best[-1]


def brute_similar(a, b):
    if not a or not b:
        return False
    need = nd.SIMILARITY * max(len(a), len(b)) - 1e-9
    if min(len(a), len(b)) < need or (Counter(a) & Counter(b)).total() < need:
        return False
    return lcs(a, b) >= need


def brute_classes(rows):
    h = nd.Hasher()
    texts = {}
    for i, t in rows:
        texts.setdefault(nd.node_of(h.words(t or ""), t or ""), []).append((i, t or ""))
    keys = list(texts)
    s = {k: h.hashes(h.words(texts[k][0][1])).tolist() for k in keys}
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for x, a in enumerate(keys):
        for b in keys[:x]:
            if find(a) != find(b) and brute_similar(s[a], s[b]):
                root[find(a)] = find(b)
    groups = {}
    for k in keys:
        groups.setdefault(find(k), []).extend(i for i, _ in texts[k])
    return {frozenset((i, k2) for k2 in keys if find(k2) == r for i, _ in texts[k2]): min((i for i in g if i is not None), default=None) for r, g in groups.items()}, groups


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    _, groups = brute_classes(rows)
    want = sorted((sorted(g, key=str) for g in groups.values()), key=str)
    got = {}
    for r in nd.classes(df).collect():
        got.setdefault(r.class_id if r.class_id is not None else ("null", r.text_hash), []).append(r.doc_id)
    assert sorted((sorted(g, key=str) for g in got.values()), key=str) == want


def near_copies(seed, n, words):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [rng.choice(vocabulary) for _ in range(words)]
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [t[k], rng.choice(vocabulary)]])
        yield " ".join(t)


def test_classes_equal_brute_force(spark):
    check(spark.read.parquet(FIXTURE))
    check(cases(spark))
    texts = [t for s in range(6) for t in near_copies(s, 12, 60 + 40 * s)]
    check(spark.createDataFrame([(k * 7 % 1000, t, "", "", 0) for k, t in enumerate(texts)], DOCS))
    assert nd.classes(empty(spark)).count() == 0


def test_band_lcs_equals_full_table(monkeypatch):
    rng = np.random.default_rng(3)
    for rows in (7, 2048):
        monkeypatch.setattr(nd, "BAND_ROWS", rows)
        for _ in range(60):
            a = rng.integers(0, 30, rng.integers(1, 60)).astype(np.uint64)
            b = np.delete(a, rng.integers(0, len(a), 3)) if rng.random() < 0.7 else rng.integers(0, 30, rng.integers(1, 60)).astype(np.uint64)
            assert nd.band_lcs(a, b, 200) == lcs(a.tolist(), b.tolist())
            for width in (0, 3, 9):
                assert nd.band_lcs(a, b, width) == banded(a.tolist(), b.tolist(), width)
            assert nd.similar(a, b) == (len(b) > 0 and brute_similar(a.tolist(), b.tolist()))


def banded(a, b, width):
    low, high = min(0, len(b) - len(a)) - width, max(0, len(b) - len(a)) + width
    best = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        before = 0
        for j, y in enumerate(b, 1):
            hit = x == y and low <= j - 1 - i <= high
            before, best[j] = best[j], before + 1 if hit else max(best[j], best[j - 1])
    return best[-1]


def test_very_long_texts_are_aligned():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 20_000, 150_000).astype(np.uint64)
    b = np.insert(np.delete(a, rng.integers(0, len(a), 3_000)), rng.integers(0, 140_000, 3_000), 7)
    assert nd.similar(a, b)
    assert not nd.similar(a, rng.permutation(a))


@pytest.mark.parametrize("few", [0, 200_000])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(nd, "FEW_LINKS", few)
    rng = random.Random(6)
    key = lambda k: k.to_bytes(2, "big")
    old = [(rng.randrange(300), rng.randrange(300)) for _ in range(120)]
    new = [(rng.randrange(300), rng.randrange(300)) for _ in range(60)]
    old, new = ([(a, b) for a, b in x if a != b] for x in (old, new))
    root = list(range(300))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in old + new:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {(key(k), key(find(k))) for k in range(300) if find(k) != k}
    frame = lambda x: spark.createDataFrame([(key(a), key(b)) for a, b in x], "a binary, b binary")
    got = nd.joined(nd.components(frame(old)), frame(new)).collect()
    assert {(bytes(r.node), bytes(r.root)) for r in got} == want and len(got) == len(want)


def test_order_counts():
    a = np.arange(100, dtype=np.uint64)
    assert not nd.similar(a, np.concatenate([a[50:], a[:50]])) and nd.similar(a, np.delete(a, [5, 60]))


def test_one_of_each_keeps_rows_and_columns(spark):
    df = cases(spark).withColumnRenamed("n_tokens", "node")
    out = nd.one_of_each(df)
    assert out.columns == df.columns
    rows = [(r.doc_id, r.text) for r in out.collect()]
    assert len(rows) == len(set(rows)) and (7, "same text") in rows and all(i != 8 for i, _ in rows)
    assert len(rows) == len(CASES) - 4  # copies of 7, and the null text with the empty one


def test_copies_of_a_template_are_one_class(spark):
    """Copies are near the template only, not one another, and the template is hardly ever a bucket's end."""
    rows = []
    for seed, n in ((1, 50), (2, 300), (3, 1000)):
        rng = random.Random(seed)
        base = [f"w{seed}y{k}" for k in range(200)]
        texts = [" ".join(base)]
        for c in range(n):
            t = list(base)
            k = rng.randrange(175)
            t[k : k + 26] = [f"x{c}y{j}" for j in range(26)]
            texts.append(" ".join(t))
        s = [nd.Hasher().hashes(t.split()) for t in texts]
        assert all(nd.similar(s[0], x) for x in s[1:]) and sum(nd.similar(s[1], x) for x in s[2:]) < n / 3
        rows += [(10_000 * seed + k, t, "", "", 0) for k, t in enumerate(texts)]
    got = nd.classes(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r.class_id, r.class_size) for r in got} == {(10_000, 51), (20_000, 301), (30_000, 1001)}


def test_members_of_a_bucket_all_meet(spark):
    """Two classes and texts like no other in the same buckets, against all pairs."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for c in range(60):
        t = list(base)
        size = rng.choice([2, 8, 13, 18, 24])
        k = rng.randrange(len(t) - size)
        t[k : k + size] = [f"x{rng.randrange(40)}" for _ in range(size)]
        texts.append(" ".join(t))
    check(spark.createDataFrame([(k, t, "", "", 0) for k, t in enumerate(texts)], DOCS))


def edited(rng, words, how, share):
    """words with a share of them changed, left out or doubled by others, at least one."""
    t, out = list(words), []
    at = set(rng.sample(range(len(t)), max(1, int(share * len(t)))))
    for k, w in enumerate(t):
        other = f"e{rng.getrandbits(40)}"
        out += [w] if k not in at else {"change": [other], "drop": [], "add": [w, other]}[how]
    return out


@pytest.mark.parametrize("how", ["change", "drop", "add"])
def test_linked_pairs_share_a_key(how):
    """Recall of candidates among the pairs that the rule links, by length and share of edited words."""
    rng, hasher = random.Random(17), nd.Hasher()
    for n in (6, 7, 8, 10, 13, 15, 20, 30, 60, 200):
        for share in (0.01, 0.05, 0.1, 0.13):
            found = linked = 0
            for _ in range(100):
                a = [f"w{rng.getrandbits(40)}" for _ in range(n)]
                x, y = hasher.hashes(a), hasher.hashes(edited(rng, a, how, share))
                if nd.similar(x, y):
                    linked += 1
                    keys = [set(nd.sketches(nd.shingles(h)).tolist() + nd.left_out(h)) for h in (x, y)]
                    found += bool(keys[0] & keys[1])
            assert found >= 0.9 * linked, (n, share, found, linked)
            if linked and n <= nd.SHORT - 1:
                assert found == linked


def test_bitmaps_rule_out_no_link_and_most_shared_passages(spark):
    rng, hasher = random.Random(18), nd.Hasher()
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, linked = [], []
    for k in range(300):
        a = [rng.choice(vocabulary) for _ in range(rng.choice([5, 20, 80, 300]))]
        b = edited(rng, a, rng.choice(["change", "drop", "add"]), rng.choice([0.02, 0.1, 0.2]))
        x, y = hasher.hashes(a), hasher.hashes(b)
        rows.append((k, len(x), nd.bits_of(x).tolist(), len(y), nd.bits_of(y).tolist()))
        if nd.similar(x, y):
            linked.append(k)
    df = spark.createDataFrame(rows, "k long, n long, p array<long>, m long, q array<long>")
    fit = {r.k for r in df.filter(nd.linkable(df.n, df.p, df.m, df.q)).collect()}
    assert set(linked) <= fit and len(linked) > 100
    passage = [f"p{k}" for k in range(120)]
    h = [nd.bits_of(hasher.hashes(passage + [f"t{k}x{j}" for j in range(60)])).tolist() for k in range(80)]
    pairs = spark.createDataFrame([(h[i], h[j]) for i in range(80) for j in range(i)], "p array<long>, q array<long>").withColumns({"n": nd.F.lit(180), "m": nd.F.lit(180)})
    assert pairs.filter(nd.linkable(pairs.n, pairs.p, pairs.m, pairs.q)).count() < 0.02 * 80 * 79 / 2


def test_passages_make_few_alignments(spark, monkeypatch):
    """Texts that share two thirds of their words and are no near copies: hardly a pair goes to the alignment."""
    passage = [f"p{k}" for k in range(120)]
    rows = [(k, " ".join(passage[:50] + [f"t{k}x{j}" for j in range(60)] + passage[50:]), "", "", 0) for k in range(150)]
    asked = []
    verify = nd.verified

    def counted(pairs, texts):
        asked.append(pairs.count())
        return verify(pairs, texts)

    monkeypatch.setattr(nd, "verified", counted)
    got = nd.classes(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.class_size for r in got} == {1} and sum(asked) < 300


def test_buckets_that_stay_open_take_two_rounds(spark, monkeypatch):
    """Texts that share a passage, few of which are near copies, against all pairs."""
    rng = random.Random(21)
    passage = [f"p{k}" for k in range(90)]
    texts = [passage[:45] + [f"t{k}x{j}" for j in range(30)] + passage[45:] for k in range(130)]
    texts += [edited(rng, texts[k], "change", 0.05) for k in range(20)]
    df = spark.createDataFrame([(k, " ".join(t), "", "", 0) for k, t in enumerate(texts)], DOCS)
    rounds = []
    make = nd.new_candidates

    def counted(members, tested):
        rounds.append(1)
        return make(members, tested)

    monkeypatch.setattr(nd, "new_candidates", counted)
    check(df)
    assert 1 <= len(rounds) <= 2
    rounds.clear()
    monkeypatch.setattr(nd, "WHOLE", 20)  # larger ones go on in rounds
    check(df)
    assert len(rounds) > 2
