"""Schema detection over customers laid out as a wide facility table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.plans.registry import query
from gridloom.plans.views import table
from gridloom.sources import schema

#: Columns of the layout as SQL, which Spark and DuckDB both read.
LAYOUT = {
    "Site-Name": "c_name",
    "redundency_details": "CASE WHEN c_custkey % 3 = 0 THEN c_name END",
    "ID": "cast(c_custkey AS VARCHAR(20))",
    "project type": "c_mktsegment",
    "x1": "c_mktsegment",
    "remark": "concat(c_name, ' ', c_mktsegment)",
    "story": "concat(c_name, ' ', c_name, ' ', c_name, ' ', c_mktsegment)",
    "Geo": "concat(cast(c_custkey AS VARCHAR(20)), ',1')",
}
OVERRIDES = {"remark": "COMPONENT_ID"}


def _sql() -> str:
    """The same rules as relations: sampled cells, keys of each header, smallest priority."""
    rules = ", ".join(f"('{kind}', '{key}', {priority}, '{role}')" for kind, key, priority, role in schema.rules())
    names = ", ".join(f"({k}, '{n}')" for k, n in enumerate(LAYOUT))
    cells = " UNION ALL ".join(f"SELECT c_custkey AS o, '{n}' AS column_name, {x} AS value FROM s" for n, x in LAYOUT.items())
    given = ", ".join(f"('{k}', '{v}')" for k, v in OVERRIDES.items())
    return f"""WITH s AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 20), u AS ({cells}), n(position, column_name) AS (VALUES {names}), r(kind, key, priority, role) AS (VALUES {rules}), g(column_name, given) AS (VALUES {given}),
c AS (SELECT column_name, list(value ORDER BY o) FILTER (value IS NOT NULL) AS vals, count(*) FILTER (value IS NULL) * 2 > count(*) AS sparse FROM u GROUP BY column_name),
k AS (SELECT position, 'name' AS kind, lower(trim(column_name)) AS key FROM n UNION SELECT position, 'word', unnest(string_split(translate(lower(trim(column_name)), '-_', '  '), ' ')) FROM n),
b AS (SELECT position, arg_min(role, priority) AS role, min(priority) AS priority FROM k JOIN r USING (kind, key) GROUP BY position),
m AS (SELECT n.position, n.column_name, list_slice(coalesce(vals, []), 1, 5) AS samples, sparse, b.role, b.priority, list_avg(list_transform(list_slice(vals, 1, 5), lambda v: length(v))) AS mean FROM n LEFT JOIN b USING (position) LEFT JOIN c USING (column_name)),
f AS (SELECT *, coalesce(role, CASE WHEN mean > 60 THEN 'FREE_TEXT' WHEN mean < 20 THEN 'META' ELSE 'UNKNOWN' END) AS found FROM m),
roles AS (SELECT position, f.column_name, coalesce(given, CASE WHEN position = 0 AND found = 'UNKNOWN' THEN 'LOCATION_ID' ELSE found END) AS role,
 CASE WHEN given IS NOT NULL THEN 1.0 WHEN priority = 0 THEN 0.98 WHEN position = 0 AND found = 'UNKNOWN' THEN 0.6 WHEN found <> 'UNKNOWN' THEN 0.85 ELSE 0.4 END::DOUBLE AS confidence, array_to_string(samples, '|') AS samples, sparse, given IS NOT NULL AS overridden FROM f LEFT JOIN g USING (column_name))"""


def layout(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_row"), *[F.expr(x).alias(n) for n, x in LAYOUT.items()])


@query("src11_column_roles", _sql().replace(f"VALUES ('{next(iter(OVERRIDES))}', '{OVERRIDES['remark']}')", "VALUES ('', '')") + " SELECT position, column_name, role, confidence, samples, sparse FROM roles")
def column_roles(spark, sf_dir):
    return schema.column_roles(layout(spark, sf_dir), "_row").select("position", "column_name", "role", "confidence", F.array_join("samples", "|").alias("samples"), "sparse")


@query("src16_overridden_roles", _sql() + " SELECT column_name, role, confidence, overridden FROM roles")
def overridden_roles(spark, sf_dir):
    return schema.column_roles(layout(spark, sf_dir), "_row", overrides=OVERRIDES).select("column_name", "role", "confidence", "overridden")


@query("src15_schema_summary", _sql() + """ SELECT coalesce(min({'p': position, 'c': column_name}) FILTER (role = 'LOCATION_ID'), min({'p': position, 'c': column_name})).c AS location_column,
 (min({'p': position, 'c': column_name}) FILTER (role = 'COMPONENT_ID')).c AS component_column,
 array_to_string(list_concat(coalesce(list(column_name ORDER BY position) FILTER (role = 'DEPENDENCY'), []), coalesce(list(column_name ORDER BY position) FILTER (role = 'FREE_TEXT'), [])), ',') AS dependency_columns,
 array_to_string(list_concat(list_concat(coalesce(list(column_name ORDER BY position) FILTER (role = 'META'), []), coalesce(list(column_name ORDER BY position) FILTER (role = 'CATEGORICAL'), [])), coalesce(list(column_name ORDER BY position) FILTER (role = 'GEO'), [])), ',') AS meta_columns,
 min(confidence) AS confidence, count(*) FILTER (sparse) AS n_warnings FROM roles""")
def schema_summary(spark, sf_dir):
    s = schema.schema_summary(schema.column_roles(layout(spark, sf_dir), "_row", overrides=OVERRIDES))
    return s.select("location_column", "component_column", F.array_join("dependency_columns", ",").alias("dependency_columns"), F.array_join("meta_columns", ",").alias("meta_columns"), "confidence", F.size("warnings").cast("long").alias("n_warnings"))


@query("src03_stacked_sheets", "SELECT c_name AS name, c_mktsegment AS col_1 FROM customer UNION ALL SELECT s_name, NULL FROM supplier")
def stacked_sheets(spark, sf_dir):
    first = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias(""))
    return schema.stacked([first, table(spark, sf_dir, "supplier").select("s_name")])
