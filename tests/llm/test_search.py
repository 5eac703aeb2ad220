import math
import os
import random
import re

import numpy as np
import pytest

from gridloom.llm import license_scan, nearest
from tests.llm.helpers import CASES, cases, empty

DATA = os.environ.get("TEST_DATA_DIR", "/root/testdata")
FIXTURE = f"{DATA}/sf0.001"


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    base = sorted((k, label) for p, label in license_scan.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
    labels, score = {x for _, x in base}, 0.0
    blocks = [b for p in re.split(r"\n[ \t\r]*\n", text or "") for b in [p, *p.split("\n")]]
    for block in blocks:
        own = set(license_scan.words_of(block))
        for label, t in license_scan.TEMPLATES:
            tokens = set(t.split())
            if (c := len(tokens & own) / len(tokens)) >= license_scan.THRESHOLD - 1e-12:
                labels.add(label)
                score = max(score, c)
    at = [k for k, _ in base]
    return len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), 1.0 if base else score


@pytest.mark.parametrize("name", ["cases", "fixture", "notices"])
def test_licenses_against_brute_force(spark, name):
    if name == "cases":
        df = cases(spark)
    elif name == "fixture":
        df = spark.read.parquet(f"{FIXTURE}/documents.parquet")
    else:
        rng = random.Random(1)
        texts = []
        for label, t in license_scan.TEMPLATES * 6:
            w = t.split()
            rng.shuffle(w)
            texts.append("before it\n" + " ".join(w[: rng.randint(len(w) // 2, len(w))]).title() + ".\n\nafter, MIT-License mit mit license")
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = license_scan.scan_licenses(df).collect()
    want = [(r.doc_id, *brute_licenses(r.text)) for r in df.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    if name == "cases":
        assert license_scan.scan_licenses(empty(spark)).count() == 0 and len(got) == len(CASES)


def test_positional_filter_rejects_and_loses_nothing():
    rng = random.Random(4)
    index = license_scan.Index(license_scan.TEMPLATES, {"the": 50, "of": 40, "and": 30, "this": 20, "license": 10}, 0.8)
    words = sorted(index.rank)
    rejected = 0
    for _ in range(3000):
        _, text = rng.choice(license_scan.TEMPLATES)
        block = {w for w in text.split() if rng.random() < 0.85} | set(rng.sample(words, 5))
        passed = set(index.candidates(block))
        for k, (_, tokens, need) in enumerate(index.templates):
            prefix = sorted(tokens, key=index.rank.__getitem__)[: len(tokens) - need + 1]
            assert k in passed or len(tokens & block) < need
            rejected += k not in passed and bool(block & set(prefix)) and len(block) >= need
    assert rejected > 100


def brute_nearest(rows, k=5):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in good:
        if q % 50 == 0:
            s = sorted((-(good[q] @ v) / math.sqrt(good[q] @ good[q]) / math.sqrt(v @ v), i) for i, v in good.items() if i != q)
            out[q] = [(i, -x) for x, i in s[:k]]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {q for q in want if want[q]}
    hits = sum(len({i for _, i, _ in found[q]} & {i for i, _ in w}) for q, w in want.items() if w)
    for rows in found.values():
        rows.sort()
        assert [r for r, *_ in rows] == list(range(1, len(rows) + 1))
        assert all(a[2] > b[2] - 1e-12 for a, b in zip(rows, rows[1:]))
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("leaf_rows, max_leaves", [(200, 8192), (2048, 8192), (100, 4)])
def test_nearest_recall(spark, monkeypatch, leaf_rows, max_leaves):
    monkeypatch.setattr(nearest, "LEAF_ROWS", leaf_rows)
    monkeypatch.setattr(nearest, "MAX_LEAVES", max_leaves)
    df = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    want = brute_nearest([(r.vec_id, r.embedding) for r in df.collect()])
    assert recall(nearest.nearest(df).collect(), want) >= 0.95


def test_nearest_special_rows(spark):
    same = [1.0, 2.0]
    rows = [(0, same), (1, same), (2, same), (50, same), (51, same), (52, same), (53, same), (100, [1.0, -2.0]), (100, [1.0, -2.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, same), (150, [-1.0, 0.5]), (8, [1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = {}
    for r in nearest.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [1, 2, 50, 51, 52] and got[50] == [0, 1, 2, 51, 52]
    assert set(got) == {0, 50, 100, 150} and 100 not in got[100]
    assert nearest.nearest(df.limit(0)).count() == 0
    assert nearest.nearest(spark.createDataFrame([(0, same), (50, [2.0, 1.0])], "vec_id long, embedding array<float>")).count() == 2


def test_search_leaves_out_far_vectors(spark):
    """Clustered vectors: most leaves are not visited, and hardly any vector beyond the cluster is verified."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((120, 64))
    v = centres[rng.integers(0, 120, 12_000)] + 0.15 * rng.standard_normal((12_000, 64))
    df = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>")
    want = brute_nearest(list(enumerate(v.tolist())))
    assert recall(nearest.nearest(df).collect(), want) >= 0.9
    visited, verified = nearest.shares(df)
    assert verified < 0.1 and verified <= visited < 0.9


def test_equal_vectors_tie_to_smaller_ids(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((40, 64)).astype(np.float32)
    rows = [(k, v[k % 40].tolist()) for k in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(i), x) for i, x in rows], "vec_id long, embedding array<float>")
    got = {}
    for r in nearest.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert len(got) == 8
    assert all(got[q] == [i for i in range(q % 40, 400, 40) if i != q][:5] for q in got)


def test_double_vectors_are_not_narrowed(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((100, 8))
    df = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>")
    for r in nearest.nearest(df).collect():
        a, b = v[r.query_id], v[r.vec_id]
        assert abs(r.score - a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)) < 1e-14
