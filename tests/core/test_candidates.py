"""Candidate search by sign projections against the exact search."""

import os
import random

from pyspark.sql import functions as F

from gridloom.operators import search

DATA = os.environ.get("TEST_DATA_DIR", "/root/testdata")


def recall(got, want):
    mine = {}
    for r in got:
        mine.setdefault(r.query_id, set()).add(r.id)
    return sum(r.id in mine.get(r.query_id, ()) for r in want) / len(want)


def test_recall_on_the_given_vectors(spark):
    v = spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = v.filter("id % 10 = 0").withColumnRenamed("id", "query_id")
    got, want = search.candidate_knn(q, v).collect(), search.knn(q, v).collect()
    assert recall(got, want) >= 0.9
    exact = {(r.query_id, r.id): r.score for r in want}
    assert all(abs(exact.get((r.query_id, r.id), r.score) - r.score) < 1e-6 for r in got)


def test_clusters_copies_and_unusable_vectors(spark):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(40)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in centres[i % 40]]) for i in range(1200)]
    rows += [(i, rows[3][1]) for i in range(2000, 2400)]  # one vector very often
    rows += [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [float("nan")] * 24), (5004, [1.0] * 3)]
    d = spark.createDataFrame(rows, "id long, v array<double>")
    q = d.filter("id % 20 = 3 OR id >= 5000").withColumnRenamed("id", "query_id")
    got = search.candidate_knn(q, d, 5).collect()
    fine = d.filter("id < 5000")
    want = search.knn(q.filter("query_id < 5000"), fine, 5).collect()
    assert recall(got, want) >= 0.9
    assert [r.id for r in got if r.query_id == 3] == [3, 2000, 2001, 2002, 2003]
    assert {r.query_id for r in got if r.query_id >= 5000} == {5004} and [r.id for r in got if r.query_id == 5004] == [5004]


def test_fewer_pairs_than_all(spark):
    """Structured vectors: a query looks at a small part of the entries."""
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(32)] for _ in range(100)]
    d = spark.createDataFrame([(i, [x + rng.gauss(0, 0.1) for x in centres[i % 100]]) for i in range(4000)], "key long, v array<double>")
    left = search._signed(d.filter("key % 100 = 0"), 24, 6, 3, 7).select(F.col("key").alias("q"), "tab", "bucket")
    met = left.join(search._signed(d, 24, 6, 1, 7), ["tab", "bucket"]).select("q", "key").distinct().count()
    assert met < 0.8 * 40 * 4000
