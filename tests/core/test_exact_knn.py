"""Exact vector search against the SQL of its query, and how its work grows."""

import random
import time

import duckdb
import pytest

from gridloom.operators import search
from gridloom.plans import knowledge_queries  # noqa: F401  (registers the SQL)
from gridloom.plans.registry import QUERIES, SQL


def by_sql(rows):
    c = duckdb.connect()
    c.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    c.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    return c.execute(f"SELECT * FROM ({SQL['sea04_exact_knn']}) ORDER BY query_id, rank").fetchall()


def ours(spark, rows, k=10, **kw):
    v = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    found = search.knn(v.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), v, k, **kw).select("query_id", "id", "rank", "score")
    return sorted(map(tuple, found.collect()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("block", [40, 4096])
def test_odd_vectors_and_ties_as_the_sql(spark, block):
    """Copies, opposite and parallel vectors, holes, other lengths, null, empty, zero, NaN and infinity, also as queries."""
    rng = random.Random(6)
    some = [[rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)] + [1.0] for _ in range(12)]
    odd = [None, [], [0.0] * 4, [None] * 4, [1.0, None, 2.0, 1.0], [1.0, 2.0], [1.0] * 6, [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 0.0, 1.0], [None, None, None, 3.0]]
    rows = [(k, [x * rng.choice([1.0, 3.0]) for x in rng.choice(some)]) for k in range(400)]
    rows = [(k, odd[k // 50 % len(odd)] if k % 100 == 50 else v) for k, v in rows] + [(1000 + 50 * j, x) for j, x in enumerate(odd)] + [(2001 + j, x) for j, x in enumerate(odd[:4])]
    assert str(ours(spark, rows, block_rows=block)) == str([tuple(r) for r in by_sql(rows)])
    # without vectors that rank before all others
    rows = [r for r in rows if r[1] is not None and len(r[1]) == 4 and any(r[1]) and None not in r[1] and max(map(abs, r[1])) < 1e300 and r[1] == r[1] and r[1][0] == r[1][0]]
    assert str(ours(spark, rows, block_rows=block)) == str([tuple(r) for r in by_sql(rows)])


def test_search_of_many_pairs_ends_in_time(spark):
    """40 million pairs of 64 components: some minutes row by row, a few seconds by blocks."""
    made = spark.range(45_000).selectExpr("id", "transform(sequence(1, 64), k -> xxhash64(id, k) / 1e18D) AS v").localCheckpoint()
    began = time.time()
    assert search.knn(made.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), made, 3).filter("rank = 1 AND query_id = id").count() == 900
    assert time.time() - began < 40


def test_fusion_with_odd_vectors_as_the_sql(spark, tmp_path):
    rng = random.Random(2)
    odd = [None, [0.0] * 4, [1.0, None, 2.0, 1.0], [1.0, 2.0]]
    rows = [(k, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(3)] + [1.0], k % 3 if k % 7 else None) for k in range(300)] + [(300 + 25 * j, x, 1) for j, x in enumerate(odd)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, QUERIES["sea05_hybrid_fusion"](spark, str(tmp_path)).collect()))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(c.execute(SQL["sea05_hybrid_fusion"]).fetchall()) and len(got) == 80
