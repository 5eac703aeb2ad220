"""Graph, terms and hierarchy derived from the given tables, as DataFrames and as the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import impact
from gridloom.plans.lineage import stored

# Order priority to edge criticality.
PRIORITY = {"1-URGENT": "CRITICAL", "2-HIGH": "HIGH", "3-MEDIUM": "MEDIUM", "5-LOW": "LOW", "4-NOT SPECIFIED": "NEGLIGIBLE"}
_CRIT = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITY.items()) + " END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, entity_type, key, status, criticality, client_tier, sla_hours, region, backup_location, remote, has_backup, has_failover, failover_hours"""
    t = lambda n: table(spark, sf_dir, n)
    loc = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).selectExpr(
        "concat('LOC-', n_nationkey) node", "'LOCATION' entity_type", "cast(n_nationkey as bigint) key", "r_name region",
        "CASE WHEN n_nationkey % 3 = 0 THEN concat('LOC-', (n_nationkey + 1) % 25) END backup_location")
    dept = t("supplier").selectExpr("concat('DEPT-', s_suppkey) node", "'DEPARTMENT' entity_type", "s_suppkey key", "s_suppkey % 4 = 0 remote")
    proj = t("orders").selectExpr(
        "concat('PROJ-', o_orderkey) node", "'PROJECT' entity_type", "o_orderkey key",
        "CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'F' THEN 'CLOSED' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'PLANNED' ELSE 'SUSPENDED' END END status", f"{_CRIT} criticality")
    client = t("customer").selectExpr(
        "concat('CLIENT-', c_custkey) node", "'CLIENT' entity_type", "c_custkey key", "CASE c_mktsegment WHEN 'BUILDING' THEN 'TIER_1' WHEN 'AUTOMOBILE' THEN 'TIER_2' WHEN 'MACHINERY' THEN 'TIER_2' ELSE 'TIER_3' END client_tier",
        "cast(12 * (1 + c_custkey % 6) as int) sla_hours")
    system = t("part").selectExpr("concat('SYS-', p_partkey) node", "'SYSTEM' entity_type", "p_partkey key", "p_partkey % 5 = 0 has_backup", "p_partkey % 7 = 0 has_failover", "p_size failover_hours")
    parts = [loc, dept, proj, client, system]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("remote", "has_backup", "has_failover")}
    return out.withColumns({"status": F.coalesce("status", F.lit("ACTIVE")), "criticality": F.coalesce("criticality", F.lit("MEDIUM"))} | flags)


def lead_lines(lineitem: DataFrame) -> DataFrame:
    """The first line of each order; line numbers repeat, so the whole line decides."""
    return lineitem.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_quantity")).alias("lead")).select("l_orderkey", "lead.*")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, edge_type, criticality, mitigated, recovery_hours"""
    t = lambda n: table(spark, sf_dir, n)
    supplier, orders, line, part = t("supplier"), t("orders"), t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_quantity"), t("part")
    led = orders.join(lead_lines(line), F.col("o_orderkey") == F.col("l_orderkey")).selectExpr("o_orderkey", "o_custkey", "l_suppkey", f"{_CRIT} criticality", "l_returnflag = 'R' mitigated", "cast(l_quantity as int) recovery_hours")
    hosts = supplier.selectExpr("concat('LOC-', s_nationkey) src", "concat('DEPT-', s_suppkey) dst", "'HOSTS' edge_type", "'CRITICAL' criticality", "false mitigated", "cast(null as int) recovery_hours")
    runs = led.selectExpr("concat('DEPT-', l_suppkey) src", "concat('PROJ-', o_orderkey) dst", "'RUNS' edge_type", "criticality", "mitigated", "recovery_hours")
    serves = led.selectExpr("concat('PROJ-', o_orderkey) src", "concat('CLIENT-', o_custkey) dst", "'SERVES' edge_type", "criticality", "mitigated", "recovery_hours")
    used = line.select("l_orderkey", "l_partkey").distinct().join(led, F.col("l_orderkey") == F.col("o_orderkey"))
    uses = used.selectExpr("concat('PROJ-', o_orderkey) src", "concat('SYS-', l_partkey) dst", "'USES' edge_type", "criticality", "mitigated", "recovery_hours")
    count = part.count()
    feeds = part.selectExpr("concat('SYS-', p_partkey) src", f"concat('SYS-', (7 * p_partkey + 3) % {max(1, count)}) dst", "'FEEDS' edge_type", "'MEDIUM' criticality", "false mitigated", "cast(null as int) recovery_hours")
    backup = part.filter("p_partkey % 10 = 1").selectExpr("concat('SYS-', p_partkey) src", "concat('SYS-', p_partkey - 1) dst", "'BACKUP_FOR' edge_type", "'LOW' criticality", "true mitigated", "cast(null as int) recovery_hours")
    return hosts.unionByName(runs).unionByName(serves).unionByName(uses).unionByName(feeds).unionByName(backup)


GRAPH_TABLES = ["nation", "region", "supplier", "customer", "part", "orders", "lineitem"]


def links(spark: SparkSession, sf_dir: str, reverse: bool = False) -> DataFrame:
    """The edges that carry impact, prepared for traversals once a session and state of the tables: the graph as it is kept."""
    derive = lambda: impact.links(edges(spark, sf_dir), nodes=nodes(spark, sf_dir), reverse=reverse)
    return stored(spark, f"links {reverse}", [f"{sf_dir}/{t}.parquet" for t in GRAPH_TABLES], derive)


NODES_SQL = f"""nodes AS (
 SELECT 'LOC-' || n_nationkey AS node, 'LOCATION' AS entity_type, n_nationkey::BIGINT AS key, 'ACTIVE' AS status, 'MEDIUM' AS criticality, NULL::VARCHAR AS client_tier, NULL::INT AS sla_hours, r_name AS region,
  CASE WHEN n_nationkey % 3 = 0 THEN 'LOC-' || ((n_nationkey + 1) % 25) END AS backup_location, false AS remote, false AS has_backup, false AS has_failover, NULL::INT AS failover_hours FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT 'DEPT-' || s_suppkey, 'DEPARTMENT', s_suppkey, 'ACTIVE', 'MEDIUM', NULL, NULL, NULL, NULL, s_suppkey % 4 = 0, false, false, NULL FROM supplier
 UNION ALL SELECT 'PROJ-' || o_orderkey, 'PROJECT', o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'F' THEN 'CLOSED' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'PLANNED' ELSE 'SUSPENDED' END END, {_CRIT}, NULL, NULL, NULL, NULL, false, false, false, NULL FROM orders
 UNION ALL SELECT 'CLIENT-' || c_custkey, 'CLIENT', c_custkey, 'ACTIVE', 'MEDIUM', CASE c_mktsegment WHEN 'BUILDING' THEN 'TIER_1' WHEN 'AUTOMOBILE' THEN 'TIER_2' WHEN 'MACHINERY' THEN 'TIER_2' ELSE 'TIER_3' END, 12 * (1 + c_custkey % 6), NULL, NULL, false, false, false, NULL FROM customer
 UNION ALL SELECT 'SYS-' || p_partkey, 'SYSTEM', p_partkey, 'ACTIVE', 'MEDIUM', NULL, NULL, NULL, NULL, false, p_partkey % 5 = 0, p_partkey % 7 = 0, p_size FROM part)"""

EDGES_SQL = f"""led AS (
 SELECT o_orderkey, o_custkey, lead.l_suppkey AS l_suppkey, {_CRIT} AS criticality, lead.l_returnflag = 'R' AS mitigated, lead.l_quantity::INT AS recovery_hours FROM orders
 JOIN (SELECT l_orderkey, min({{'l_linenumber': l_linenumber, 'l_suppkey': l_suppkey, 'l_partkey': l_partkey, 'l_returnflag': l_returnflag, 'l_quantity': l_quantity}}) AS lead FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey),
edges AS (
 SELECT 'LOC-' || s_nationkey AS src, 'DEPT-' || s_suppkey AS dst, 'HOSTS' AS edge_type, 'CRITICAL' AS criticality, false AS mitigated, NULL::INT AS recovery_hours FROM supplier
 UNION ALL SELECT 'DEPT-' || l_suppkey, 'PROJ-' || o_orderkey, 'RUNS', criticality, mitigated, recovery_hours FROM led
 UNION ALL SELECT 'PROJ-' || o_orderkey, 'CLIENT-' || o_custkey, 'SERVES', criticality, mitigated, recovery_hours FROM led
 UNION ALL SELECT 'PROJ-' || o_orderkey, 'SYS-' || l_partkey, 'USES', criticality, mitigated, recovery_hours FROM led JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey
 UNION ALL SELECT 'SYS-' || p_partkey, 'SYS-' || ((7 * p_partkey + 3) % (SELECT count(*) FROM part)), 'FEEDS', 'MEDIUM', false, NULL FROM part
 UNION ALL SELECT 'SYS-' || p_partkey, 'SYS-' || (p_partkey - 1), 'BACKUP_FOR', 'LOW', true, NULL FROM part WHERE p_partkey % 10 = 1)"""
