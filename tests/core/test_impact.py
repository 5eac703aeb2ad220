import random

from pyspark.sql import functions as F

from gridloom.operators import impact

NODES = "node string, entity_type string, status string, criticality string, client_tier string, sla_hours int, region string, backup_location string, remote boolean, has_backup boolean, has_failover boolean, failover_hours int"
EDGES = "src string, dst string, edge_type string, criticality string, mitigated boolean"


def graph(spark, nodes, edges):
    full = [(n, t, s, "MEDIUM", None, None, None, None, False, False, False, None) for n, t, s in nodes]
    return spark.createDataFrame(full, NODES), spark.createDataFrame(edges, EDGES)


def origins(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "origin string")


def test_tiers_of_a_location(spark):
    nodes, edges = graph(
        spark,
        [("L", "LOCATION", "ACTIVE"), ("D", "DEPARTMENT", "ACTIVE"), ("P1", "PROJECT", "ACTIVE"), ("P2", "PROJECT", "PLANNED"), ("C1", "CLIENT", "ACTIVE"), ("C2", "CLIENT", "ACTIVE"), ("C3", "CLIENT", "ACTIVE")],
        [("L", "D", "HOSTS", "CRITICAL", False), ("D", "P1", "RUNS", "HIGH", False), ("D", "P2", "RUNS", "CRITICAL", False), ("P1", "C1", "SERVES", "CRITICAL", False), ("P1", "C2", "SERVES", "CRITICAL", True), ("P2", "C3", "SERVES", "CRITICAL", False)],
    )
    got = {r.node: (r.tier, r.hop) for r in impact.propagate(origins(spark, "L"), nodes, edges).collect()}
    assert got == {"D": ("CRITICAL", 1), "P1": ("HIGH", 2), "P2": ("MONITOR", 2), "C1": ("CRITICAL", 3), "C2": ("HIGH", 3)}
    from_planned = {r.node for r in impact.propagate(origins(spark, "P2", "L"), nodes, edges).filter("origin = 'P2'").collect()}
    assert from_planned == {"C3"}
    both = impact.propagate(origins(spark, "P2", "L"), nodes, edges).filter("origin = 'L' AND node = 'C3'").count()
    assert both == 0


def test_ways_against_brute_force(spark):
    """Every shortest way in plain Python; of them the one that the docstring of hops names."""
    rng = random.Random(8)
    names = [f"n{k}" for k in range(40)]
    edges = [(rng.choice(names), rng.choice(names), rng.choice(["FEEDS", "USES"]), rng.choice(list(impact.RANK)), rng.random() < 0.5) for _ in range(150)]
    n, e = graph(spark, [(x, "SYSTEM", "ACTIVE") for x in names], edges)
    want = {}
    for o in names[:8]:
        best = {o: ((o,), (), None, False)}
        frontier = [o]
        for _ in range(5):
            ways = {}
            for s, d, t, c, m in edges:
                if s in frontier and d not in best:
                    ways.setdefault(d, []).append((impact.RANK[c], m, s, t))
            for d, found in ways.items():
                rank, m, s, t = min(found)
                best[d] = ((*best[s][0], d), (*best[s][1], t), m, best[s][3] or m)
            frontier = list(ways)
        want |= {(o, d): w for d, w in best.items() if d != o}
    got = impact.traverse(origins(spark, *names[:8]), e, n, 5).collect()
    assert {(r.origin, r.node): (tuple(r.path), tuple(r.edge_path), r.edge_mitigated, r.any_mitigated) for r in got} == want
    plain = impact.traverse(origins(spark, *names[:8]), impact.links(e), n, 5, paths=False)
    assert {(r.origin, r.node) for r in plain.collect()} == set(want) and "path" not in plain.columns


def test_names_in_any_case_and_limit(spark):
    nodes, edges = graph(spark, [(x, "SYSTEM", "ACTIVE") for x in ("Base", "b", "c", "d")], [("Base", x, "FEEDS", "LOW", False) for x in "bcd"])
    nodes = nodes.withColumn("name_he", F.when(F.col("node") == "Base", "בסיס"))
    for name in ("base", "BASE", "בסיס"):
        assert {(r.origin, r.node) for r in impact.propagate(origins(spark, name), nodes, edges).collect()} == {(name, x) for x in "bcd"}
    assert [r.node for r in impact.propagate(origins(spark, "base"), nodes, edges, limit=2).orderBy("node").collect()] == ["b", "c"]
    assert impact.propagate(origins(spark, "nothing"), nodes, edges).count() == 0


def test_recovery_hours_and_mode_of_the_last_edge(spark):
    nodes, _ = graph(spark, [(x, "SYSTEM", "ACTIVE") for x in "abc"], [])
    edges = spark.createDataFrame([("a", "b", "FEEDS", "LOW", False, 4, "DELAYED"), ("b", "c", "FEEDS", "HIGH", True, 7, None)], EDGES + ", recovery_hours int, propagation_mode string")
    got = {r.node: (r.recovery_hours, r.propagation_mode) for r in impact.propagate(origins(spark, "a"), nodes, edges).collect()}
    assert got == {"b": (4, "DELAYED"), "c": (7, "DIRECT")}
    plain = impact.propagate(origins(spark, "a"), nodes, edges.drop("recovery_hours", "propagation_mode")).collect()
    assert {(r.recovery_hours, r.propagation_mode) for r in plain} == {(None, "DIRECT")}


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS x", "id % 3 AS y").repartition(4)
    got = impact.numbered(df, F.desc("y"), F.asc("x")).collect()
    want = sorted(got, key=lambda r: (-r.y, r.x))
    assert [r.position for r in want] == list(range(1, 1001))


def test_unknown_trigger_and_depth(spark):
    nodes, edges = graph(spark, [(x, "SYSTEM", "ACTIVE") for x in "abcdefg"], [(a, b, "FEEDS", "LOW", False) for a, b in zip("abcdef", "bcdefg")])
    t = origins(spark, "a", "nowhere")
    up = {r.origin: r for r in impact.roll_up(t, impact.propagate(t, nodes, edges, 3), 3).collect()}
    assert up["a"].total == 3 and not up["a"].complete and up["nowhere"].total == 0 and up["nowhere"].complete


def test_random_graphs_against_brute_force(spark):
    rng = random.Random(5)
    names = [f"n{k}" for k in range(50)]
    nodes = [(n, rng.choice(["PROJECT", "SYSTEM"]), rng.choice(["ACTIVE", "PLANNED"])) for n in names]
    edges = [(rng.choice(names), rng.choice(names), "FEEDS", rng.choice(list(impact.RANK)), rng.random() < 0.5) for _ in range(120)]
    halting = {n for n, t, s in nodes if t == "PROJECT" and s == "PLANNED"}
    want = set()
    for o in names[:10]:
        seen, frontier = {o}, {o}
        for hop in range(1, 6):
            nxt = {d for s, d, *_ in edges if s in frontier and (s not in halting or s == o)} - seen
            want |= {(o, d, hop) for d in nxt}
            seen |= nxt
            frontier = nxt
    n, e = graph(spark, nodes, edges)
    got = impact.traverse(origins(spark, *names[:10]), e, n, 5).collect()
    assert {(r.origin, r.node, r.hop) for r in got} == want
    assert all(len(r.path) == r.hop + 1 and r.path[0] == r.origin and r.path[-1] == r.node for r in got)


def test_mitigated_path_and_history(spark):
    nodes, edges = graph(spark, [(x, "SYSTEM", "ACTIVE") for x in "abc"], [("a", "b", "FEEDS", "CRITICAL", True), ("b", "c", "FEEDS", "CRITICAL", False)])
    assert {r.node: r.tier for r in impact.propagate(origins(spark, "a"), nodes, edges, along_path=True).collect()} == {"b": "HIGH", "c": "HIGH"}
    assert {r.node: r.tier for r in impact.propagate(origins(spark, "a"), nodes, edges).collect()} == {"b": "HIGH", "c": "CRITICAL"}
    inc = spark.createDataFrame([(1, "2024-01-01", ["A"], []), (2, "2024-02-01", ["x"], ["a"]), (3, None, ["a"], [])], "incident_id int, incident_date string, location_refs array<string>, entity_refs array<string>").withColumn("incident_date", F.to_date("incident_date"))
    names = spark.createDataFrame([("A",)], "name string")
    assert [r.incident_id for r in impact.history(inc, names).orderBy("position").collect()] == [2, 1, 3]
    assert [r.incident_id for r in impact.history(inc, names, since="2024-01-15").collect()] == [2]


def test_bitmaps_and_hubs_give_what_the_ways_give(spark, monkeypatch):
    """More origins than a word has bits, an origin that starts elsewhere, halted projects, a hub of half of all edges."""
    rng = random.Random(12)
    names = [f"n{k}" for k in range(90)]
    kinds = [(x, rng.choice(["SYSTEM", "PROJECT"]), rng.choice(["ACTIVE", "PLANNED"])) for x in names]
    edges = [(rng.choice(names), rng.choice(names), rng.choice(["FEEDS", "USES"]), rng.choice(list(impact.RANK)), rng.random() < 0.5) for _ in range(150)]
    edges += [("n0", rng.choice(names), "FEEDS", rng.choice(list(impact.RANK)), False) for _ in range(150)]
    n, e = graph(spark, kinds, edges)
    start = spark.createDataFrame([(x, x) for x in names[:80]] + [("both", "n1"), ("both", "n2")], "origin string, node string")
    shown = ["origin", "node", "hop", "edge_criticality", "edge_mitigated"]
    rows = lambda df: sorted(map(tuple, df.select(*shown).collect()))
    want = rows(impact.traverse(start, e, n, 4, paths=False))
    assert rows(impact.reach(start, e, n, 4)) == want and len(want) > 500
    monkeypatch.setattr(impact, "HUB_EDGES", 20)
    ready = impact.links(e, nodes=n)
    of_hub = ready.filter("src = 'n0'")
    assert of_hub.select("deal").distinct().count() > 4 and of_hub.groupBy("deal").count().agg(F.max("count")).first()[0] < 60
    assert rows(impact.reach(start, ready, n, 4)) == want
    assert rows(impact.traverse(start, ready, n, 4, paths=False)) == want
    back = impact.traverse(start, e, None, 3, halt=False, reverse=True, paths=False)
    assert sorted((r.origin, r.node, r.hop) for r in impact.dependents(start, n, impact.links(e, reverse=True)).collect()) == sorted((r.origin, r.node, r.hop) for r in back.collect())
    counts = {r.origin: r.downstream for r in impact.downstream_counts(start, ready, 4).collect()}
    plain = {r.origin: r["count"] for r in impact.traverse(start, e, None, 4, halt=False, paths=False).groupBy("origin").count().collect()}
    assert counts == {x: plain.get(x, 0) for x in [*names[:80], "both"]}
