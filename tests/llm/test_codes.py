"""Vector codes against a plain version in Python's integers, and the GNAT against all entries."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import vector_codes as vc


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    size = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == size]
    width = -(-size // parts)
    cs = []
    for _, v, _ in kept:
        c = [math.floor(256 * x) if abs(x) < 1e15 else 256 * int(x) for x in v] + [0] * (width * parts - size)
        cs.append([c[j * width : (j + 1) * width] for j in range(parts)])
    books = [[c[j] for c in cs[:entries]] for j in range(parts)]
    near = lambda book, p: min((sum((a - b) ** 2 for a, b in zip(p, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for j in range(parts):
            groups = {}
            for c in cs:
                groups.setdefault(near(books[j], c[j])[1], []).append(c[j])
            books[j] = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[j])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], {}
    for (i, _, label), c in zip(kept, cs):
        got = [near(b, p) for b, p in zip(books, c)]
        out.append((i, label, bytes(k for _, k in got).hex(), sum(d for d, _ in got)))
        sums[label] = sums.get(label, 0) + out[-1][3]
    fit = lambda x: x if x < 2**63 else None
    return sorted(((i, code, fit(e), fit(sums[label]), digest) for i, label, code, e in out), key=str)


def coded(spark, rows, kind="float", **more):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumn("code", F.lit("clash"))
    return sorted((tuple(r) for r in vc.encode(df, **more).collect()), key=str)


@pytest.mark.parametrize("spread", [3, 40, 5000])
def test_gnat_finds_what_all_entries_give(spread):
    rng = np.random.default_rng(spread)
    for _ in range(20):
        entries = rng.integers(-spread, spread, (int(rng.integers(1, 70)), 4))
        parts = rng.integers(-spread, spread, (300, 4))
        d = ((parts[:, None] - entries[None]) ** 2).sum(2)
        index, best = vc.Gnat(entries).nearest(parts)
        assert (index == d.argmin(1)).all() and (best == d.min(1)).all()  # argmin takes the lowest of equals


def test_gnat_leaves_subtrees_out():
    rng = np.random.default_rng(1)
    entries = rng.integers(-40, 40, (64, 4)) + rng.integers(0, 8, (64, 1)) * 4000
    tree, asked = vc.Gnat(entries), 0
    measure = vc.Gnat._measure

    def counted(self, parts, rows, *rest):
        nonlocal asked
        asked += len(rows)
        return measure(self, parts, rows, *rest)

    vc.Gnat._measure = counted
    try:
        tree.nearest(entries[rng.integers(0, 64, 500)] + rng.integers(-9, 9, (500, 4)))
    finally:
        vc.Gnat._measure = measure
    assert asked < 0.5 * 500 * 64


def test_codes_are_those_of_the_plain_version(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(32)], rng.choice([None, 1, 2])) for i in range(300)]
    rows += [(300, None, 1), (301, [None] + [0.0] * 31, 1), (302, [math.nan] * 32, 2), (303, [math.inf] * 32, 2), (304, [0.5] * 31, 1), (305, [], None)]
    rows += [rows[5], rows[5], (None, rows[7][1], 2), (7, rows[9][1], 1)]
    f32 = [(i, v and [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert coded(spark, f32) == plain(f32)


def test_sizes_that_do_not_divide_few_rows_and_extremes(spark):
    rng = random.Random(4)
    few = [(i, [rng.choice([-0.001, 0.0, 0.25, 1.0]) for _ in range(18)], 1) for i in range(5)]
    assert coded(spark, few) == plain(few)
    wide = [(i, [rng.choice([1e300, -1e300, 1e12, 0.5]) for _ in range(16)], i % 2) for i in range(40)] + [(99, [1.0] * 16, 5)]
    assert coded(spark, wide, "double", entries=4) == plain(wide, entries=4)
    late = [(i, [float(i % 7)] * 16, 0) for i in range(30)] + [(50, [1e9] * 16, 0)]
    assert coded(spark, late, "double", entries=8) == plain(late, entries=8)
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == []
