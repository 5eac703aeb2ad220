"""The cycle guard within a batch against edges taken one by one."""

import random

import pytest

from gridloom.operators import hierarchy


def plain(batch, old, depth):
    taken, out = set(old), []
    for child, parent, seq in sorted(batch, key=lambda r: (r[2] is None, r[2] or 0, r[0], r[1])):
        reach, frontier = set(), {parent}
        for _ in range(depth):
            frontier = {b for a, b in taken if a in frontier} - reach
            reach |= frontier
        if child != parent and child not in reach:
            taken.add((child, parent))
            out.append((child, parent, seq))
    return sorted(out, key=str)


def guarded(spark, batch, old, depth=10):
    c = spark.createDataFrame(batch, "child_id string, parent_id string, seq long")
    e = spark.createDataFrame(old, "child_id string, parent_id string")
    return sorted(map(tuple, hierarchy.without_cycles(c, e, depth).collect()), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_random_batches(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(12)]
    old = list({tuple(sorted(rng.sample(names, 2))) for _ in range(8)})
    batch = [(rng.choice(names), rng.choice(names), rng.choice([None, rng.randint(1, 20)])) for _ in range(30)]
    batch += batch[:2]
    for depth in (2, 10):
        assert guarded(spark, batch, old, depth) == plain(batch, old, depth)


def test_rings_of_two_to_five_and_a_chain_of_waits(spark):
    batch, seq = [], 0
    for n in (2, 3, 4, 5):
        for k in range(n):
            seq += 1
            batch.append((f"r{n}-{k}", f"r{n}-{(k + 1) % n}", seq))
    got = guarded(spark, batch, [])
    assert len(got) == 1 + 2 + 3 + 4 and got == plain(batch, [], 10)  # the last edge of each ring goes
    # each edge closes a cycle with the one before it if that one is taken
    chain = [("a", "b", 1), ("b", "a", 2), ("b", "c", 3), ("c", "a", 4), ("a", "c", 5), ("c", "b", 6), ("b", "a", 7)]
    assert guarded(spark, chain, []) == plain(chain, [], 10)


def test_batches_without_cycles_or_rows(spark):
    assert guarded(spark, [("a", "b", 1), ("b", "c", 2), ("x", "x", 3)], []) == [("a", "b", 1), ("b", "c", 2)]
    assert guarded(spark, [], [("a", "b")]) == []
    assert guarded(spark, [("b", "a", 1), (None, "a", 2), ("c", None, 3)], [("a", "b")]) == []
