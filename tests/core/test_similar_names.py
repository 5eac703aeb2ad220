import difflib
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import resolve


def names(seed, n=90):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 16))) for _ in range(n)]
    base += [b[:k] + rng.choice("abcx") + b[k + 1 :] for b in base[: n // 2] for k in [rng.randrange(len(b))]]
    base += [b[:k] + rng.choice("abcx") + b[k:] for b in base[: n // 2] for k in [rng.randrange(len(b))]]
    return sorted(set(base), key=lambda b: rng.random())


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("threshold", [0.75, 0.88, 0.95])
def test_no_pair_is_lost_at_any_threshold(spark, threshold):
    ns = names(3)
    df = spark.createDataFrame(list(enumerate(ns)) + [(1000, None)], "id long, norm string")
    got = {(r.left_id, r.right_id) for r in resolve.similar_pairs(df, df, threshold).collect()}
    assert got == {(i, j) for i, a in enumerate(ns) for j, b in enumerate(ns) if ratio(a, b) >= threshold}
    with pytest.raises(ValueError):
        resolve.similar_pairs(df, df, 0.5)


def test_duplicates_are_connected_components(spark):
    ns = names(4)
    root = list(range(len(ns)))
    for _ in ns:
        for i, a in enumerate(ns):
            for j, b in enumerate(ns):
                if root[i] != root[j] and ratio(a, b) >= 0.88:
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.id: r.cluster for r in resolve.duplicates(spark.createDataFrame(list(enumerate(ns)), "id long, norm string")).collect()}
    assert got == dict(enumerate(root))
    long = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(90, 91), (91, 90), (7, 7)], "a long, b long")
    assert {r.id: r.cluster for r in resolve.clusters(long).collect()} == {k: 0 for k in range(41)} | {90: 90, 91: 90}


def test_first_of_similar_equals_one_pass_in_order(spark):
    ns = names(5)
    ns += ns[:20]
    kept = []
    for k, n in enumerate(ns):
        if not any(n == o or ratio(n, o) >= 0.88 for _, o in kept):
            kept.append((k, n))
    df = spark.createDataFrame([(k, f"c{k}", n) for k, n in enumerate(ns)] + [(5000, "none", None)], "seq long, id string, norm string")
    assert sorted((r.seq, r.norm) for r in resolve.first_of_similar(df).collect()) == kept
    assert resolve.first_of_similar(df.filter("false")).count() == 0


def test_suggestions_are_the_most_similar(spark):
    ns = names(6)
    known, asked = ns[::2], ns[1::2] + ns[:4:2]
    k = spark.createDataFrame([(n, f"c{i:03d}") for i, n in enumerate(known)], "norm string, concept_id string")
    got = {}
    for r in resolve.suggestions(spark.createDataFrame([(a,) for a in asked] + [(None,)], "norm string"), k).orderBy("norm", "position").collect():
        got.setdefault(r.norm, []).append(r.concept_id)
    want = {}
    for a in set(asked) - set(known):
        near = sorted((-ratio(a, n), f"c{i:03d}") for i, n in enumerate(known) if ratio(a, n) >= 0.75)[:5]
        if near:
            want[a] = [c for _, c in near]
    assert got == want


def test_plan_has_no_cross_join(spark, capsys):
    df = spark.range(5).select("id", F.col("id").cast("string").alias("norm"))
    resolve.similar_pairs(df, df).explain()
    assert "CartesianProduct" not in (out := capsys.readouterr().out) and "NestedLoop" not in out
