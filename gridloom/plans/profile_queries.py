"""Catalog records, profiles of concepts, and similar names over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import folds, profiles, resolve
from gridloom.plans.knowledge_queries import _CLOSED, HIERARCHY, hierarchy_edges
from gridloom.plans.registry import query
from gridloom.plans.views import table
from gridloom.sources import catalog


@query("src04_catalog_tables", """SELECT 'T' || p_partkey AS id, lower(p_type) || '.' || p_name AS fqn, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS tags, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS owner, 2 AS n_columns, p_size % 2 > 0 AS key_nullable FROM part""")
def catalog_tables(spark, sf_dir):
    tag = F.array(F.struct(F.col("p_brand").alias("tagFQN")))
    columns = F.array(F.struct(F.lit("key").alias("name"), F.lit("BIGINT").alias("dataType"), F.when(F.col("p_size") % 2 == 0, "NOT_NULL").alias("constraint")), F.struct(F.lit("note").alias("name"), F.lit("TEXT").alias("dataType"), F.lit(None).cast("string").alias("constraint")))
    raw = table(spark, sf_dir, "part").select(F.to_json(F.struct(
        F.concat(F.lit("T"), F.col("p_partkey")).alias("id"), F.col("p_name").alias("name"), F.concat_ws(".", F.lower("p_type"), "p_name").alias("fullyQualifiedName"), F.when(F.col("p_partkey") % 2 == 0, tag).alias("tags"),
        F.when(F.col("p_partkey") % 3 == 0, F.struct(F.col("p_brand").alias("name"))).alias("owner"), columns.alias("columns"))).alias("value"))
    return catalog.catalog_tables(raw).select("id", "fqn", F.array_join("tags", ",").alias("tags"), "owner", F.size("columns").alias("n_columns"), F.col("columns")[0]["is_nullable"].alias("key_nullable"))


@query("src05_glossary_terms", """SELECT 'G' || p_partkey AS id, p_name AS surface, 'OFFICIAL' AS form FROM part UNION ALL SELECT DISTINCT 'G' || p_partkey, unnest([replace(p_name, ' ', '-'), upper(p_name)]), 'ALIAS' FROM part WHERE p_partkey % 4 > 0""")
def glossary_terms(spark, sf_dir):
    synonyms = F.array(F.translate("p_name", " ", "-"), F.upper("p_name"), F.col("p_name"), F.upper("p_name"))
    raw = table(spark, sf_dir, "part").select(F.to_json(F.struct(F.concat(F.lit("G"), F.col("p_partkey")).alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 4 > 0, synonyms).alias("synonyms"))).alias("value"))
    return catalog.surface_forms(catalog.glossary_terms(raw))


@query("src17_totals_by_source", "SELECT CASE WHEN grouping(source) = 1 THEN '(all)' ELSE source END AS source, count(*) AS n, count(*) FILTER (coalesce(text, '') = '') AS n_empty, coalesce(sum(n_chars), 0)::BIGINT AS chars FROM documents GROUP BY ROLLUP(source)")
def totals_by_source(spark, sf_dir):
    out = table(spark, sf_dir, "documents").rollup("source").agg(F.grouping("source").alias("g"), F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("n_empty"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))
    return out.select(F.when(F.col("g") == 1, "(all)").otherwise(F.col("source")).alias("source"), "n", "n_empty", "chars")


@query("fn14_statement_values", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN upper(event_type) ELSE event_type END AS value FROM events")
def statement_values(spark, sf_dir):
    kind = F.when(F.col("event_id") % 3 == 0, "concept_ref").when(F.col("event_id") % 3 == 1, "multilingual").otherwise("string")
    return table(spark, sf_dir, "events").select("event_id", profiles.statement_value(kind, F.col("user_id").cast("string"), F.upper("event_type"), F.col("event_type")).alias("value"))


@query("txt08_table_lines", "SELECT o_custkey, string_agg(o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority, chr(10) ORDER BY o_orderkey) AS lines FROM orders GROUP BY o_custkey")
def table_lines(spark, sf_dir):
    each = table(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderkey", profiles.piped(["o_orderkey", "o_orderstatus", "o_orderpriority"]).alias("line")).alias("x"))
    return each.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("lines"))


@query("ups06_provenance_links", "SELECT DISTINCT l_partkey AS concept_id, l_orderkey AS doc_id FROM lineitem")
def provenance_links(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("concept_id"), F.col("l_orderkey").alias("doc_id")).distinct()


@query("ups09_statements", "SELECT o_custkey AS concept_id, o_orderpriority AS property, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS value FROM orders GROUP BY ALL")
def statements(spark, sf_dir):
    said = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("concept_id"), F.col("o_orderpriority").alias("property"), F.struct("o_orderdate", "o_orderkey").alias("seq"), F.col("o_orderstatus").alias("value"))
    return folds.fold(said, ["concept_id", "property"], last=["value"])


@query("ups19_incidents", "SELECT user_id AS incident_id, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS reported, max(value) AS confidence FROM events WHERE event_type = 'error' GROUP BY user_id")
def incidents(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("user_id").alias("incident_id"), F.struct("ts", "event_id").alias("seq"), "event_id", F.col("ts").alias("reported"), F.col("value").alias("confidence"))
    return folds.fold(e, ["incident_id"], first=["event_id"], highest=["confidence"], earliest=["reported"])


@query("ups21_impact_properties", "SELECT s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS criticality, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 48 ELSE 24 END AS sla_hours FROM supplier")
def impact_properties(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    given = s.filter("s_suppkey % 3 = 0").select(F.upper("s_name").alias("name"), F.lit("HIGH").alias("criticality"), (F.col("s_suppkey") % 48).alias("sla_hours"))
    return profiles.with_properties(s.select(F.col("s_name").alias("name")), given, {"criticality": "MEDIUM", "sla_hours": 24})


@query("lkp04_aliases", "SELECT p_brand AS concept_id, string_agg(DISTINCT a, ',' ORDER BY a) AS aliases FROM (SELECT p_brand, unnest([replace(p_name, ' ', '-'), upper(p_name)]) AS a FROM part) GROUP BY p_brand")
def aliases(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    forms = F.array(F.struct(F.col("p_name").alias("surface"), F.lit("OFFICIAL").alias("form")), F.struct(F.translate("p_name", " ", "-").alias("surface"), F.lit("ALIAS").alias("form")), F.struct(F.upper("p_name").alias("surface"), F.lit("ABBREVIATION").alias("form")))
    return profiles.aliases(p.select(F.col("p_brand").alias("concept_id"), F.inline(forms))).select("concept_id", F.array_join("aliases", ",").alias("aliases"))


@query("lkp08_provenance", "SELECT l_partkey AS concept_id, arg_min(l_suppkey, (l_shipdate, l_orderkey, l_linenumber, l_suppkey)) AS first_source, count(DISTINCT l_suppkey) AS n_sources, max(l_shipdate) AS last_update FROM lineitem GROUP BY l_partkey")
def provenance(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("concept_id"), F.col("l_suppkey").alias("source"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("seq"), F.col("l_shipdate").alias("ts"))
    return profiles.provenance(facts)


@query("lkp03_suggestions")
def suggestions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    known = p.select(F.lower("p_name").alias("norm"), F.col("p_name").alias("concept_id")).distinct()
    asked = p.select(F.when(F.col("p_partkey") % 3 == 0, F.expr("concat(substring(lower(p_name), 3), 'x')")).otherwise(F.lower("p_name")).alias("norm"))
    return resolve.suggestions(asked, known)


@query("hie04_labels", "SELECT user_id AS concept_id, string_agg(event_type || '=' || e, ',' ORDER BY event_type) AS labels FROM (SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS e FROM events GROUP BY ALL) GROUP BY user_id")
def labels(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("seq"), "event_id")
    last = folds.fold(e, ["user_id", "event_type"], last=["event_id"])
    return profiles.pairs_text(last.withColumnRenamed("user_id", "concept_id"), "concept_id", "event_type", "event_id", "labels")


@query("hie05_statements", "SELECT o_custkey AS concept_id, string_agg(o_orderpriority || '=' || s, ',' ORDER BY o_orderpriority) AS statements FROM (SELECT o_custkey, o_orderpriority, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s FROM orders GROUP BY ALL) GROUP BY o_custkey")
def statements_of_concepts(spark, sf_dir):
    return profiles.pairs_text(statements(spark, sf_dir), "concept_id", "property", "value", "statements")


@query("hie09_direct_parent", f"WITH {HIERARCHY} SELECT child_id, min(parent_id) AS parent_id FROM h GROUP BY child_id")
def direct_parent(spark, sf_dir):
    return profiles.direct_parent(hierarchy_edges(spark, sf_dir))


@query("hie11_records", _CLOSED + """, i AS (SELECT child_id AS concept_id FROM h UNION SELECT parent_id FROM h), a AS (SELECT concept_id, string_agg(ancestor_id, ',' ORDER BY depth, ancestor_id) AS ancestor_ids, max(depth) AS hierarchy_depth FROM c GROUP BY concept_id),
s AS (SELECT child_id AS concept_id, least(20, count(DISTINCT sibling_id)) AS n_siblings FROM (SELECT a.child_id, b.child_id AS sibling_id FROM h a JOIN h b ON a.parent_id = b.parent_id AND a.child_id <> b.child_id) GROUP BY child_id),
k AS (SELECT parent_id AS concept_id, count(DISTINCT child_id) AS n_children FROM h GROUP BY parent_id), p AS (SELECT child_id AS concept_id, min(parent_id) AS parent_id FROM h GROUP BY child_id)
SELECT i.concept_id, parent_id, coalesce(ancestor_ids, '') AS ancestor_ids, coalesce(hierarchy_depth, 0) AS hierarchy_depth, coalesce(n_children, 0) AS n_children, coalesce(n_siblings, 0) AS n_siblings FROM i LEFT JOIN p USING (concept_id) LEFT JOIN a USING (concept_id) LEFT JOIN k USING (concept_id) LEFT JOIN s USING (concept_id)""")
def hierarchy_records(spark, sf_dir):
    r = profiles.hierarchy_records(hierarchy_edges(spark, sf_dir))
    return r.select("concept_id", "parent_id", F.coalesce(F.array_join("ancestor_ids", ","), F.lit("")).alias("ancestor_ids"), "hierarchy_depth", "n_children", "n_siblings")


def _said_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.expr("substring(p_name, 2)")).otherwise(F.col("p_name")).alias("norm"))


@query("res04_duplicate_clusters")
def duplicate_clusters(spark, sf_dir):
    names = _said_names(spark, sf_dir).groupBy("norm").agg(F.min("p_partkey").alias("id"))
    return resolve.duplicates(names).select("id", "norm", "cluster")


@query("res05_first_of_similar")
def first_of_similar(spark, sf_dir):
    return resolve.first_of_similar(_said_names(spark, sf_dir).select(F.col("p_partkey").alias("seq"), F.col("p_partkey").alias("id"), "norm"))
