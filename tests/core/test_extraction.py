from gridloom.operators import extraction, impact


def test_broken_and_missing_lists_are_empty(spark):
    body = '{"concepts": [{"name": " ", "terms": ["Depot"], "confidence": 1.5}, {"name": " "}, {"name": "Site", "confidence": 0.9, "domain": ["x"]}], "relationships": [{"src": "a", "dst": "b", "type": "feeds into"}]}'
    x = extraction.parsed(spark.createDataFrame([(1, body), (2, "{broken"), (3, None), (4, "{}")], "id long, value string"), "id")
    assert {r.id: (r.n_concepts, r.n_relations, r.n_mappings) for r in extraction.counts(x, "id").collect()} == {1: (2, 1, 0), 2: (0, 0, 0), 3: (0, 0, 0), 4: (0, 0, 0)}
    got = {(r.name, tuple(r.domain), r.review_needed) for r in extraction.concepts(x, "id").collect()}
    assert got == {("Depot", ("General",), True), (None, ("General",), True), ("Site", ("x",), False)}
    assert [(r.id, r.type) for r in extraction.relations(x, "id").collect()] == [(1, "FEEDS_INTO")]


def test_only_the_worst_get_options(spark):
    hit = spark.createDataFrame([("L", f"n{k}", "HIGH" if k < 2 else "CRITICAL" if k < 6 else "MONITOR", 1) for k in range(9)], "origin string, node string, tier string, hop int")
    nodes = spark.createDataFrame([(f"n{k}", "SYSTEM", "ACTIVE", None, False, False, True, 4) for k in range(9)], "node string, entity_type string, status string, backup_location string, remote boolean, has_backup boolean, has_failover boolean, failover_hours int")
    edges = spark.createDataFrame([], "src string, dst string, edge_type string")
    got = {(r.position, r.node) for r in impact.first_mitigations(hit, nodes, edges).collect()}
    assert got == {(1, "n2"), (2, "n3"), (3, "n4"), (4, "n5"), (5, "n0")}
