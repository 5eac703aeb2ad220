import random

from pyspark.sql import functions as F

from gridloom.operators import hierarchy, impact
from gridloom.streaming import keyed


def test_order_within_keys_across_batches(spark, tmp_path):
    schema = "id string, key string, ts timestamp"
    batches = [[("1", "a", 10), ("2", "a", 5), ("3", "b", 7)], [("4", "a", 8), ("5", "a", 20)], [("6", "b", 8)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "id string, key string, t int").select("id", "key", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b={n}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = keyed.ordered(stream).writeStream.format("memory").queryName("ordered").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.id: (r.key, r.number, r.late) for r in spark.table("ordered").collect()}
    assert got == {"2": ("a", 1, False), "1": ("a", 2, False), "3": ("b", 1, False), "4": ("a", 3, True), "5": ("a", 4, False), "6": ("b", 2, False)}


def test_ancestors_follow_changed_edges(spark, tmp_path):
    schema = "child_id string, parent_id string, relation string"
    edges = [("b", "a", "SUBCLASS_OF"), ("c", "b", "SUBCLASS_OF"), ("d", "c", "INSTANCE_OF"), ("x", "y", "SUBCLASS_OF")]
    changes = [("c", "x", "SUBCLASS_OF"), ("y", "z", "SUBCLASS_OF")]
    for k, row in enumerate(changes):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"n{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "out")
    keyed.refresh_ancestors(stream, spark.createDataFrame(edges, schema), path, str(tmp_path / "c")).awaitTermination()
    now = [("b", "a", "SUBCLASS_OF"), ("d", "c", "INSTANCE_OF"), ("x", "y", "SUBCLASS_OF"), *changes]
    want = {tuple(r) for r in hierarchy.closure(spark.createDataFrame(now, schema)).collect()}
    got = keyed.ancestors(spark, path)
    assert {tuple(r) for r in got.select("concept_id", "ancestor_id", "relation_path", "depth", "last_relation").collect()} == want
    assert keyed.latest_version(spark, path) == 2


def test_downstream_sketches_follow_changed_edges(spark, tmp_path):
    """Three batches of a random graph with cycles, new nodes and sources that lose edges, against a full rebuild."""
    rng = random.Random(5)
    schema = "src string, dst string, edge_type string, criticality string, mitigated boolean"
    edge = lambda a, b: (a, b, "FEEDS", "LOW", False)
    names = [f"n{k}" for k in range(30)]
    edges = [edge(rng.choice(names), rng.choice(names)) for _ in range(35)]
    now = list(edges)
    for k in range(3):
        sources = rng.sample(names, 2) + [f"new{k}"]
        batch = [edge(s, rng.choice([*names, f"new{k - 1}"])) for s in sources]
        now = [e for e in now if e[0] not in sources] + batch
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"n{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "out")
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    keyed.refresh_downstream(stream, nodes, spark.createDataFrame(edges, schema), path, str(tmp_path / "c"), 4).awaitTermination()
    every = spark.createDataFrame([(n,) for n in {*names, *(x for e in now for x in e[:2])}], "node string")
    want = {tuple(r) for r in impact.downstream_estimates(every, spark.createDataFrame(now, schema), 4).collect()}
    got = {tuple(r) for r in keyed.downstream(spark, path, 4).collect()}
    named = {x for e in now for x in e[:2]} | set(names)
    assert {g for g in got if g[0] in named} == want and keyed.latest_version(spark, path) == 3
