import uuid

from pyspark.sql import functions as F

from gridloom.functions import text as fn
from gridloom.operators import folds, impact, search
from gridloom.plans import lineage
from gridloom.sources import events as store
from tests.core.test_impact import graph, origins


def test_ids_equal_the_library(spark):
    r = spark.range(1).select(fn.term_id(F.lit("abc"), F.lit("en")).alias("t"), fn.class_id(F.lit("Big Class")).alias("c"), fn.asset_id(F.lit("db.x")).alias("a")).first()
    want = [uuid.uuid5(uuid.NAMESPACE_DNS, x) for x in ("abc::en", "class::big class", "db.x")]
    assert [r.t, r.c, r.a] == list(map(str, want))


def test_labels_display_and_quotes(spark):
    df = spark.createDataFrame([("dePARTment", None, "b", "x" * 600), ("thing", "", "b", "y"), (None, "א", "b", None)], "kind string, he string, base string, quote string")
    rows = df.select(fn.node_label(F.col("kind")).alias("l"), fn.display(F.col("he"), F.col("base")).alias("d"), F.length(fn.short_quote(F.col("quote"))).alias("n")).collect()
    assert [tuple(r) for r in rows] == [("Department", "b", 500), ("Facility", "b", 1), ("Facility", "א", None)]


def test_headers_and_abbreviations(spark):
    lines = {"1. Intro": True, "1.2 More": True, "12 apples": False, "א.-ת. x": True, "פרק ראשון": True, "וזה הנספח": True, "ALL CAPS": True, "All Caps": False, "": False, "  ": False, "1." + "x" * 90: False, "title:": False, "X" * 41: False}
    df = spark.createDataFrame([(k,) for k in lines], "x string")
    got = {r.x: r.h for r in df.select("x", fn.is_header(F.col("x")).alias("h")).collect()}
    assert got == lines
    r = spark.createDataFrame([('רמ"ד ו-מפ"ג, a"b',), (None,)], "x string").select(fn.quoted_abbreviations(F.col("x")).alias("a")).collect()
    assert [x.a for x in r] == [['רמ"ד', 'מפ"ג'], []]


def test_dependency_edges_keep_the_first_condition_and_the_last_values(spark):
    rows = [("a", "b", "USES", "LOW", "DIRECT", False, 1, "c1", 1), ("a", "b", "USES", "HIGH", "DELAYED", True, 2, "c2", 2), ("a", "b", "LIKES", "LOW", "DIRECT", False, 1, "c", 3), ("a", "b", None, "LOW", "DIRECT", False, 1, "c", 4)]
    said = spark.createDataFrame(rows, "src string, dst string, edge_type string, criticality string, propagation_mode string, mitigated boolean, recovery_hours int, condition string, seq int")
    kept, rejected = folds.dependency_edges(said, ["USES"])
    assert [tuple(r) for r in kept.select("condition", "criticality", "propagation_mode", "mitigated", "recovery_hours").collect()] == [("c1", "HIGH", "DELAYED", True, 2)]
    assert rejected.count() == 2


def test_downstream_estimates_are_near_the_counts(spark):
    names = [f"n{k}" for k in range(400)]
    nodes, edges = graph(spark, [(n, "SYSTEM", "ACTIVE") for n in names], [(names[k // 3], names[k], "FEEDS", "LOW", False) for k in range(1, 400)])
    exact = {r.origin: r.downstream for r in impact.downstream_counts(origins(spark, *names), edges, 10).collect()}
    guess = {r.node: r.downstream for r in impact.downstream_estimates(nodes, edges, 10).collect()}
    assert exact["n0"] == 399 and set(guess) == set(exact)
    assert all(abs(guess[n] - exact[n]) <= max(1, 0.08 * exact[n]) for n in names)


def test_precedents_and_report_record(spark):
    inc = spark.createDataFrame([(1, "2024-01-01", ["L"], [], ["a", "b", "c"], 5, 0.8, "s1"), (2, None, ["l"], [], ["z"], None, 0.7, "s2"), (3, "2023-01-01", ["L"], [], ["old"], 1, 0.9, "s3"), (4, "2024-02-01", ["L"], [], [], 1, 0.9, "s4")], "incident_id int, incident_date string, location_refs array<string>, entity_refs array<string>, actions array<string>, recovery_hours int, confidence double, source string").withColumn("incident_date", F.to_date("incident_date"))
    got = impact.precedents(spark.createDataFrame([("L",)], "node string"), inc).collect()
    assert [(r.source, r.description) for r in got] == [("s1", "Historical precedent (2024-01-01): a; b")]
    nodes, edges = graph(spark, [("L", "LOCATION", "ACTIVE"), ("D", "DEPARTMENT", "ACTIVE"), ("P", "PROJECT", "PLANNED")], [("L", "D", "HOSTS", "CRITICAL", False), ("D", "P", "RUNS", "LOW", False)])
    at = origins(spark, "L", "nowhere")
    r = {x.location_name: x for x in impact.report_record(at, impact.propagate(at, nodes, edges), reason="down").collect()}
    assert r["L"].critical_immediate == ["D — CRITICAL impact, no mitigation available"] and r["L"].monitor_no_action == ["P — MONITOR level"] and r["L"].named_entities == ["D", "P"]
    assert r["nowhere"].named_entities == [] and "0 entities" in r["nowhere"].situation and r["L"].confidence == "LOW" and r["L"].confidence_reason.endswith("down")


def test_search_modes_and_array_fields(spark):
    docs = spark.createDataFrame([(1, "red apple", ["fruit", "pomme"], [1.0, 0.0]), (2, "green pear", ["fruit"], [0.0, 1.0]), (3, None, None, [0.7, 0.7])], "id int, name string, aliases array<string>, v array<double>")
    asked = spark.createDataFrame([(9, "pomme", [0.0, 1.0])], "query_id int, text string, v array<double>")
    found = {m: [r.id for r in search.find(asked, docs, m, 2).orderBy("rank").collect()] for m in ("lexical", "semantic", "hybrid")}
    assert found == {"lexical": [1], "semantic": [2, 3], "hybrid": [1, 2]}
    hit = search.best_hit(spark.createDataFrame([("apple pear",), ("none",)], "name string"), docs.withColumn("status", F.when(F.col("id") == 1, "DEPRECATED")))
    assert [(r.name, r.id) for r in hit.collect()] == [("apple pear", 2)]


def test_store_is_append_only_and_replays(spark, tmp_path):
    path = str(tmp_path / "store")
    e = spark.range(100).selectExpr("id AS event_id", "timestamp_seconds(id * 3600) AS ts", "'x' AS event_type")
    store.append(e.filter("event_id < 50"), path)
    store.append(e.filter("event_id >= 50"), path)
    assert store.read(spark, path).count() == 100 and store.read(spark, path, "1970-01-03").count() == 52
    counts = []
    for run in range(2):
        q = store.replay(spark, path, store.read(spark, path).schema).writeStream.format("memory").queryName(f"replay{run}").option("checkpointLocation", str(tmp_path / f"c{run}")).trigger(availableNow=True).start()
        q.awaitTermination()
        counts.append(spark.table(f"replay{run}").count())
    assert counts == [100, 100]


def test_stored_tables_are_made_once_for_each_state_of_their_inputs(spark, tmp_path):
    made, source = [], str(tmp_path / "t.parquet")

    def derive():
        made.append(1)
        return spark.read.parquet(source)

    spark.range(3).write.parquet(source)
    assert lineage.stored(spark, "three", [source], derive).count() == lineage.stored(spark, "three", [source], derive).count() == 3 and len(made) == 1
    spark.range(2).write.mode("append").parquet(source)
    assert lineage.stored(spark, "three", [source], derive).count() == 5 and len(made) == 2
    lineage.clear(spark)
    assert lineage.stored(spark, "three", [source], derive).count() == 5 and len(made) == 3
    assert lineage.cut(spark.range(5)).count() == 5
