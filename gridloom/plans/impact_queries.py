"""Impact queries over the graph of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import impact
from gridloom.plans.registry import query
from gridloom.plans.views import EDGES_SQL, NODES_SQL, edges, links, nodes, table

VIEWS = f"WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}"
_RANK = "CASE criticality WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'LOW' THEN 3 WHEN 'NEGLIGIBLE' THEN 4 ELSE 2 END"


def _reach(origins: str, depth: int, halt: bool, reverse: bool = False) -> str:
    """CTE `reach` (origin, node, hop) with the fewest hops."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    types = ", ".join(f"'{t}'" for t in impact.IMPACT_EDGES)
    stop = "AND NOT EXISTS (SELECT 1 FROM halted h WHERE h.node = w.node AND w.hop > 0)" if halt else ""
    return f"""{VIEWS}, halted AS (SELECT node FROM nodes WHERE entity_type = 'PROJECT' AND status IN ('PLANNED', 'SUSPENDED')),
e AS (SELECT {a} AS s, {b} AS d, min({_RANK} * 2 + mitigated::INT) AS r FROM edges WHERE edge_type IN ({types}) GROUP BY ALL),
walk(origin, node, hop) AS ({origins} UNION SELECT w.origin, e.d, w.hop + 1 FROM walk w JOIN e ON e.s = w.node WHERE w.hop < {depth} {stop}),
reach AS (SELECT origin, node, min(hop) AS hop FROM walk WHERE node <> origin GROUP BY ALL)"""


def _of(n, kind, condition="true"):
    return n.filter(f"entity_type = '{kind}' AND ({condition})").select(F.col("node").alias("origin"))


def _from(spark, sf_dir, kind, condition="true"):
    return _of(nodes(spark, sf_dir), kind, condition)


_ALL_LOC = "SELECT node AS origin, node, 0 AS hop FROM nodes WHERE entity_type = 'LOCATION'"
_TIERS = """, won AS (SELECT r.origin, r.node, r.hop, min(e.r) AS r FROM reach r JOIN e ON e.d = r.node
 JOIN (SELECT origin, node, hop FROM reach UNION ALL SELECT DISTINCT origin, origin, 0 FROM walk) p ON p.origin = r.origin AND p.node = e.s AND p.hop = r.hop - 1
 WHERE p.hop = 0 OR NOT EXISTS (SELECT 1 FROM halted h WHERE h.node = p.node) GROUP BY ALL),
tiers AS (SELECT w.origin, w.node, n.entity_type, w.hop, (w.r % 2 = 1) AS mitigated, CASE w.r // 2 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' ELSE 'NEGLIGIBLE' END AS edge_criticality,
 CASE WHEN n.status IN ('PLANNED', 'SUSPENDED') THEN 'MONITOR' WHEN n.client_tier = 'TIER_1' AND n.sla_hours <= 24 THEN CASE WHEN w.r % 2 = 1 THEN 'HIGH' ELSE 'CRITICAL' END
 WHEN w.r // 2 = 0 THEN CASE WHEN w.r % 2 = 1 THEN 'HIGH' ELSE 'CRITICAL' END WHEN w.r // 2 = 1 THEN 'HIGH' ELSE 'MONITOR' END AS tier
 FROM won w LEFT JOIN nodes n ON n.node = w.node)"""


@query("gra01_propagate_location", _reach("SELECT 'LOC-7' AS origin, 'LOC-7' AS node, 0 AS hop", 5, True) + _TIERS + "SELECT origin, node, entity_type, hop, edge_criticality, mitigated, tier FROM tiers")
def propagate_location(spark, sf_dir):
    n = nodes(spark, sf_dir)
    hit = impact.propagate(_of(n, "LOCATION", "key = 7"), n, links(spark, sf_dir), 5, ways=False)
    return hit.select("origin", "node", "entity_type", "hop", "edge_criticality", "mitigated", "tier")


def _ways(origins: str, depth: int) -> str:
    """CTEs h0 .. h<depth>: per hop the nodes first reached there, with the way that `impact.hops` takes."""
    types = ", ".join(f"'{t}'" for t in impact.IMPACT_EDGES)
    out = f"""{VIEWS}, halted AS MATERIALIZED (SELECT node FROM nodes WHERE entity_type = 'PROJECT' AND status IN ('PLANNED', 'SUSPENDED')),
e AS MATERIALIZED (SELECT src AS s, dst AS d, min({{'r': {_RANK} * 2 + mitigated::INT, 't': edge_type}}) AS w FROM edges WHERE edge_type IN ({types}) GROUP BY ALL),
h0 AS (SELECT *, false AS m FROM ({origins}))"""
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT origin, node FROM h{j}" for j in range(k))
        stop = "" if k == 1 else "WHERE f.node NOT IN (SELECT node FROM halted)"
        out += f""",
b{k} AS (SELECT f.origin, e.d AS node, min({{'r': e.w.r, 'p': f.node, 't': e.w.t}}) AS w FROM h{k - 1} f JOIN e ON e.s = f.node {stop} GROUP BY ALL),
h{k} AS MATERIALIZED (SELECT b.origin, b.node, {k} AS hop, b.w.r AS r, p.path || ' > ' || b.node AS path, p.edge_path || CASE WHEN p.edge_path = '' THEN '' ELSE ' > ' END || b.w.t AS edge_path, p.m OR b.w.r % 2 = 1 AS m
 FROM b{k} b JOIN h{k - 1} p ON p.origin = b.origin AND p.node = b.w.p WHERE (b.origin, b.node) NOT IN (SELECT (origin, node) FROM ({seen})))"""
    every = " UNION ALL ".join(f"SELECT * FROM h{k}" for k in range(1, depth + 1))
    return f"{out}, ways AS ({every})"


@query("gra01_propagate_all_locations", _ways("SELECT node AS origin, node, 0 AS hop, NULL::INT AS r, node AS path, '' AS edge_path FROM nodes WHERE entity_type = 'LOCATION'", 5) + """
SELECT w.origin, w.node, n.entity_type, w.hop, w.path, w.edge_path, w.r % 2 = 1 AS mitigated FROM ways w LEFT JOIN nodes n ON n.node = w.node""")
def propagate_locations(spark, sf_dir):
    """Every location as a trigger, with the ways."""
    n = nodes(spark, sf_dir)
    hit = impact.propagate(_of(n, "LOCATION"), n, links(spark, sf_dir), 5)
    return hit.select("origin", "node", "entity_type", "hop", "path", "edge_path", "mitigated")


@query("gra22_mitigated_on_the_way", _ways("SELECT node AS origin, node, 0 AS hop, NULL::INT AS r, node AS path, '' AS edge_path FROM nodes WHERE entity_type = 'LOCATION'", 5) + """
SELECT w.origin, w.node, w.hop, w.m AS mitigated, CASE WHEN n.status IN ('PLANNED', 'SUSPENDED') THEN 'MONITOR' WHEN n.client_tier = 'TIER_1' AND n.sla_hours <= 24 OR w.r // 2 = 0 THEN CASE WHEN w.m THEN 'HIGH' ELSE 'CRITICAL' END WHEN w.r // 2 = 1 THEN 'HIGH' ELSE 'MONITOR' END AS tier
FROM ways w LEFT JOIN nodes n ON n.node = w.node""")
def mitigated_on_the_way(spark, sf_dir):
    """What lies below a mitigated edge counts as mitigated."""
    n = nodes(spark, sf_dir)
    return impact.propagate(_of(n, "LOCATION"), n, links(spark, sf_dir), 5, along_path=True, paths=False).select("origin", "node", "hop", "mitigated", "tier")


@query("gra07_roll_up_all_locations", _reach(_ALL_LOC, 4, True) + _TIERS + """, t AS (SELECT node AS origin FROM nodes WHERE entity_type = 'LOCATION' UNION ALL SELECT 'LOC-unknown')
SELECT t.origin, count(*) FILTER (tier = 'CRITICAL') AS n_critical, count(*) FILTER (tier = 'HIGH') AS n_high, count(*) FILTER (tier = 'MONITOR') AS n_monitor, count(tier) AS total, coalesce(max(hop), 0) AS deepest, coalesce(max(hop), 0) < 4 AS complete
FROM t LEFT JOIN tiers USING (origin) GROUP BY t.origin""")
def roll_up_all_locations(spark, sf_dir):
    n = nodes(spark, sf_dir)
    triggers = _of(n, "LOCATION").union(spark.createDataFrame([("LOC-unknown",)], "origin string"))
    hit = impact.propagate(triggers, n, links(spark, sf_dir), 4, ways=False)
    return impact.roll_up(triggers, hit, 4)


@query("gra09_dependents_of_clients", _reach("SELECT node AS origin, node, 0 AS hop FROM nodes WHERE entity_type = 'CLIENT'", 3, False, True) + "SELECT r.origin, r.node, n.entity_type, r.hop FROM reach r LEFT JOIN nodes n ON n.node = r.node")
def dependents_of_clients(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return impact.dependents(_of(n, "CLIENT"), n, links(spark, sf_dir, reverse=True), 3)


@query("gra10_dependent_kinds", _reach("SELECT node AS origin, node, 0 AS hop FROM nodes WHERE entity_type = 'CLIENT'", 3, False, True) + "SELECT r.origin, count(*) AS n_dependents, count(DISTINCT n.entity_type) > 1 AS spans_types FROM reach r LEFT JOIN nodes n ON n.node = r.node GROUP BY r.origin")
def dependent_kinds(spark, sf_dir):
    return impact.dependent_kinds(dependents_of_clients(spark, sf_dir))


_COMPARE = _reach(_ALL_LOC, 5, False) + """, c AS (SELECT l.node AS origin, count(r.node) AS total_downstream, count(*) FILTER (n.entity_type = 'PROJECT' AND n.criticality = 'CRITICAL') AS critical_projects, count(*) FILTER (n.client_tier = 'TIER_1') AS tier1_clients,
 count(*) FILTER (n.entity_type = 'SYSTEM' AND NOT (n.has_backup OR n.has_failover OR n.backup_location IS NOT NULL)) AS unprotected_systems
 FROM nodes l LEFT JOIN reach r ON r.origin = l.node LEFT JOIN nodes n ON n.node = r.node WHERE l.entity_type = 'LOCATION' GROUP BY l.node)"""


@query("gra11_compare_locations", _COMPARE + "SELECT *, row_number() OVER (ORDER BY critical_projects DESC, origin) AS position FROM c")
def compare_locations(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return impact.compare(_of(n, "LOCATION"), n, links(spark, sf_dir), "critical_project_count")


@query("gra25_heat_map", _COMPARE + "SELECT origin, metric, value FROM (UNPIVOT (SELECT origin, critical_projects, tier1_clients, unprotected_systems FROM c) ON critical_projects, tier1_clients, unprotected_systems INTO NAME metric VALUE value)")
def heat_map(spark, sf_dir):
    n = nodes(spark, sf_dir)
    c = impact.compare(_of(n, "LOCATION"), n, links(spark, sf_dir))
    return c.unpivot(["origin"], ["critical_projects", "tier1_clients", "unprotected_systems"], "metric", "value")


_COUNTS = _reach("SELECT node AS origin, node, 0 AS hop FROM nodes WHERE entity_type IN ('LOCATION', 'DEPARTMENT')", 4, False) + """, d AS (SELECT l.node, l.entity_type, count(r.node) AS downstream, count(r.node) > 0 AND NOT (l.has_backup OR l.has_failover OR l.backup_location IS NOT NULL) AS is_spof
 FROM nodes l LEFT JOIN reach r ON r.origin = l.node WHERE l.entity_type IN ('LOCATION', 'DEPARTMENT') GROUP BY l.node, l.entity_type, l.has_backup, l.has_failover, l.backup_location)"""


def _spof(spark, sf_dir):
    n = nodes(spark, sf_dir)
    at = n.filter("entity_type IN ('LOCATION', 'DEPARTMENT')").select(F.col("node").alias("origin"))
    return impact.single_points(n, impact.downstream_counts(at, links(spark, sf_dir), 4))


@query("gra14_single_points_of_failure", _COUNTS + "SELECT node, entity_type, downstream, is_spof FROM d")
def single_points(spark, sf_dir):
    return _spof(spark, sf_dir)


@query("gra26_critical_bridges", _COUNTS + "SELECT node, downstream FROM d WHERE is_spof ORDER BY downstream DESC, node LIMIT 10")
def critical_bridges(spark, sf_dir):
    return _spof(spark, sf_dir).filter("is_spof").orderBy(F.desc("downstream"), "node").limit(10).select("node", "downstream")


@query("gra15_coverage", VIEWS + """, a AS (SELECT count(*) AS locations, count(*) FILTER (node IN (SELECT src FROM edges WHERE edge_type = 'HOSTS')) AS covered FROM nodes WHERE entity_type = 'LOCATION')
SELECT locations, covered, round(100.0 * covered / locations, 1)::DOUBLE AS percent, covered / locations >= 0.85 AS ready FROM a""")
def coverage(spark, sf_dir):
    return impact.coverage(nodes(spark, sf_dir), edges(spark, sf_dir))


_OPTIONS = VIEWS + """, alt AS (SELECT node AS dept FROM nodes WHERE entity_type = 'DEPARTMENT' AND remote AND status = 'ACTIVE' ORDER BY node LIMIT 4),
o AS (SELECT dst AS node, 'redundant_asset' AS option_type, src AS source, NULL::INT AS recovery_hours, 0.95::DOUBLE AS confidence FROM edges WHERE edge_type = 'BACKUP_FOR'
 UNION ALL SELECT node, 'backup_location', backup_location, NULL, 0.9 FROM nodes WHERE backup_location IN (SELECT node FROM nodes)
 UNION ALL SELECT node, 'documented_fallback', 'documented_failover', failover_hours, 0.9 FROM nodes WHERE has_failover
 UNION ALL SELECT node, 'documented_fallback', 'remote_capability', NULL, 0.85 FROM nodes WHERE remote
 UNION ALL SELECT node, 'alternative_dept', dept, NULL, 0.7 FROM (SELECT node, dept, row_number() OVER (PARTITION BY node ORDER BY dept) AS k FROM nodes, alt WHERE node <> dept) WHERE k <= 3)"""
_NOT_ORDERS = "entity_type IN ('LOCATION', 'DEPARTMENT', 'SYSTEM')"


def _options(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return impact.mitigations(n.filter(_NOT_ORDERS), n, edges(spark, sf_dir))


@query("gra16_mitigations", _OPTIONS + f"SELECT o.* FROM o JOIN nodes USING (node) WHERE {_NOT_ORDERS}")
def mitigations(spark, sf_dir):
    return _options(spark, sf_dir)


@query("gra18_has_backup", _OPTIONS + f"SELECT node, bool_or(option_type IN ('redundant_asset', 'backup_location')) AS has_backup, count(*) AS n_options FROM o JOIN nodes USING (node) WHERE {_NOT_ORDERS} GROUP BY node")
def has_backup(spark, sf_dir):
    return impact.has_backup(_options(spark, sf_dir))


def incidents(spark, sf_dir, condition="true"):
    """One per error event that meets the condition."""
    e = table(spark, sf_dir, "events").filter(f"event_type = 'error' AND ({condition})")
    return e.select(F.col("event_id").alias("incident_id"), F.to_date("ts").alias("incident_date"), F.array(F.concat(F.lit("Loc-"), F.col("user_id") % 25)).alias("location_refs"), F.array(F.concat(F.lit("SYS-"), F.col("event_id") % 200)).alias("entity_refs"))


@query("gra19_history", """WITH i AS (SELECT event_id AS incident_id, ts::DATE AS incident_date, lower('Loc-' || (user_id % 25)) AS a, lower('SYS-' || (event_id % 200)) AS b FROM events WHERE event_type = 'error'),
n AS (SELECT 'LOC-' || n_nationkey AS name FROM nation),
h AS (SELECT name, incident_id, incident_date, row_number() OVER (PARTITION BY name ORDER BY incident_date DESC NULLS LAST, incident_id) AS position FROM n JOIN i ON lower(name) IN (a, b) WHERE incident_date >= DATE '2024-01-05')
SELECT * FROM h WHERE position <= 10""")
def history(spark, sf_dir):
    names = _from(spark, sf_dir, "LOCATION").withColumnRenamed("origin", "name")
    return impact.history(incidents(spark, sf_dir), names, "2024-01-05")


@query("gra19_history_all_events")
def history_of_all(spark, sf_dir):
    """gra19_history under the name that round 1 gave it."""
    names = _from(spark, sf_dir, "LOCATION").withColumnRenamed("origin", "name")
    return impact.history(incidents(spark, sf_dir), names, "2024-01-05")


_MULTI = _reach(_ALL_LOC, 5, True)


@query("gra21_combined_scenario", _MULTI + "SELECT count(*) AS sum_of_parts, count(DISTINCT node) AS total, true AS simulation FROM reach")
def combined_scenario(spark, sf_dir):
    n = nodes(spark, sf_dir)
    hit = impact.propagate(_of(n, "LOCATION"), n, links(spark, sf_dir), 5, simulation=True, ways=False)
    return hit.agg(F.count(F.lit(1)).alias("sum_of_parts"), F.count_distinct("node").alias("total"), F.bool_and("simulation").alias("simulation"))


@query("gra24_layers", _MULTI + "SELECT origin, hop, entity_type, count(*) AS n FROM reach LEFT JOIN nodes USING (node) GROUP BY ALL")
def layers(spark, sf_dir):
    n = nodes(spark, sf_dir)
    hit = impact.propagate(_of(n, "LOCATION"), n, links(spark, sf_dir), 5, ways=False)
    return hit.groupBy("origin", "hop", "entity_type").agg(F.count(F.lit(1)).alias("n"))


@query("gra23_shortest_paths", _reach("SELECT node AS origin, node, 0 AS hop FROM nodes WHERE entity_type = 'DEPARTMENT'", 3, False) + "SELECT origin, node, hop FROM reach WHERE node LIKE 'CLIENT-%'")
def shortest_paths(spark, sf_dir):
    hit = impact.traverse(_from(spark, sf_dir, "DEPARTMENT"), links(spark, sf_dir), None, 3, halt=False).filter("node LIKE 'CLIENT-%'")
    return hit.filter(F.size("path") == F.col("hop") + 1).select("origin", "node", "hop")


@query("gra27_visible_subgraph", VIEWS + "SELECT src, dst, edge_type FROM edges WHERE src IN (SELECT node FROM nodes WHERE entity_type IN ('PROJECT', 'CLIENT') AND criticality <> 'LOW') AND dst IN (SELECT node FROM nodes WHERE entity_type IN ('PROJECT', 'CLIENT') AND criticality <> 'LOW')")
def visible_subgraph(spark, sf_dir):
    return impact.visible(nodes(spark, sf_dir), edges(spark, sf_dir), F.expr("entity_type IN ('PROJECT', 'CLIENT') AND criticality <> 'LOW'")).select("src", "dst", "edge_type")


@query("gra28_location_filter", VIEWS + "SELECT node, region FROM nodes WHERE entity_type = 'LOCATION' AND contains(lower(region), 'a') AND criticality = 'MEDIUM' AND status = 'ACTIVE'")
def location_filter(spark, sf_dir):
    return impact.locations(nodes(spark, sf_dir), "a", "MEDIUM", "ACTIVE").select("node", "region")


@query("gra31_grounding", VIEWS + "SELECT conv_id::VARCHAR AS report, m AS name, lower(m) IN (SELECT lower(node) FROM nodes) AS grounded FROM (SELECT conv_id, unnest(['Loc-' || (conv_id % 40), 'DEPT-' || turn]) AS m FROM conversations)")
def grounding(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("report"), F.explode(F.array(F.concat(F.lit("Loc-"), F.col("conv_id") % 40), F.concat(F.lit("DEPT-"), F.col("turn")))).alias("name"))
    return impact.grounding(said, nodes(spark, sf_dir))


@query("gra29_report_lines")
def report_lines(spark, sf_dir):
    return impact.report_lines(impact.propagate(_from(spark, sf_dir, "LOCATION", "key IN (3, 7)"), nodes(spark, sf_dir), links(spark, sf_dir), 2))
