"""Records, search documents, wide-row edges, review decisions, sections and quality figures over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import text as fn
from gridloom.operators import folds, hierarchy, impact, metrics, records, search
from gridloom.plans.knowledge_queries import _CLOSED, _HEADER, hierarchy_edges
from gridloom.plans.registry import query
from gridloom.plans.views import table
from gridloom.sources import rows
from gridloom.streaming import messages


@query("src06_row_hashes", """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}') AS row_hash FROM customer""")
def row_hashes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", rows.row_hash(["c_name", "c_custkey", "c_mktsegment"]).alias("row_hash"))


@query("fn10_named_concepts", """WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_name END AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS canonical, [p_type] AS terms FROM part),
n AS (SELECT *, coalesce(CASE WHEN trim(name) <> '' THEN name END, canonical, terms[1]) AS n FROM c)
SELECT p_partkey, n AS name, CASE WHEN list_contains(terms, n) THEN array_to_string(terms, '|') ELSE n || '|' || array_to_string(terms, '|') END AS terms, 'General' AS domain FROM n""")
def named_concepts(spark, sf_dir):
    none = F.lit(None).cast("string")
    p = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.col("p_name")).alias("name"), none.alias("name_he"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("canonical_name"),
        none.alias("description"), none.alias("description_he"), F.array("p_type").alias("terms"), F.array().cast("array<string>").alias("domain"))
    return records.named(p).select("p_partkey", "name", F.array_join("terms", "|").alias("terms"), F.array_join("domain", "|").alias("domain"))


@query("fn20_coordinates", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 < 2 THEN (s_nationkey + 0.5)::DOUBLE END AS lon, CASE WHEN s_suppkey % 3 < 2 THEN (-s_suppkey % 90)::DOUBLE END AS lat FROM supplier")
def coordinates(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("lat", -F.col("s_suppkey") % 90)
    point = F.when(F.col("s_suppkey") % 3 == 0, F.format_string("POINT (%d.5 %d)", "s_nationkey", "lat")).when(F.col("s_suppkey") % 3 == 1, F.format_string("%d.5, %d", "s_nationkey", "lat")).otherwise("unknown")
    lon, lat = records.coordinates(F.col("point"))
    return s.select("s_suppkey", point.alias("point")).select("s_suppkey", lon.alias("lon"), lat.alias("lat"))


@query("fn21_effort_edges", """WITH f AS (SELECT p_partkey AS src, 'support_a' AS dst, p_size / 25.0 AS weight FROM part UNION ALL SELECT p_partkey, 'support_b', CASE p_partkey % 4 WHEN 0 THEN 0.2 WHEN 1 THEN 0.9 END FROM part)
SELECT src, dst, weight::DOUBLE AS weight FROM f WHERE weight BETWEEN 0 AND 1""")
def effort_edges(spark, sf_dir):
    level = F.when(F.col("p_partkey") % 4 == 0, "Low ").when(F.col("p_partkey") % 4 == 1, "high").when(F.col("p_partkey") % 4 == 2, "n/a")
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 25.0).alias("support_a"), level.alias("support_b"))
    return records.effort_edges(p, "p_partkey", ["support_a", "support_b"], {"low": 0.2, "high": 0.9})


_STRIP = r"regexp_replace({}, '^[\x09-\x0D\x1C-\x20\x{{85}}\pZ]+|[\x09-\x0D\x1C-\x20\x{{85}}\pZ]+$', '', 'g')"
_SECTIONS = rf"""WITH RECURSIVE p AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS page, unnest(x) AS page_text FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
y AS (SELECT doc_id, page, generate_subscripts(z, 1) AS i, unnest(z) AS line FROM (SELECT doc_id, page, string_split(page_text, chr(10)) AS z FROM p)),
l AS MATERIALIZED (SELECT doc_id, page, line, row_number() OVER w AS k, coalesce(lead(page) OVER w <> page, false) AS ends, ({_HEADER}) AS header
 FROM (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM y) WINDOW w AS (PARTITION BY doc_id ORDER BY page, i)),
f AS (SELECT doc_id, 0::BIGINT AS k, ''::VARCHAR AS buffer, 0::BIGINT AS waiting, NULL::VARCHAR AS title, 0::BIGINT AS first, 0::BIGINT AS page, []::STRUCT(title VARCHAR, first BIGINT, page BIGINT, text VARCHAR)[] AS out, false AS open FROM (SELECT DISTINCT doc_id FROM l)
 UNION ALL
 SELECT doc_id, k, CASE WHEN full_ THEN right(b2, 200) ELSE b2 END, CASE WHEN full_ THEN 200 ELSE w2 END, title2, CASE WHEN full_ THEN page2 ELSE first2 END, page2,
  CASE WHEN flush THEN [{{'title': title, 'first': first, 'page': page, 'text': buffer}}] ELSE [] END || CASE WHEN full_ THEN [{{'title': title2, 'first': first2, 'page': page2, 'text': b2}}] ELSE [] END, true
 FROM (SELECT *, ends AND w2 >= 1500 AS full_ FROM (SELECT f.doc_id, l.k, f.buffer, f.title, f.first, f.page, l.ends, l.header AND f.waiting > 50 AS flush, l.page AS page2,
   CASE WHEN (l.header AND f.waiting > 50) OR NOT f.open THEN l.line ELSE f.buffer || chr(10) || l.line END AS b2, CASE WHEN l.header AND f.waiting > 50 THEN 0 ELSE f.waiting END + length(l.line) + 1 AS w2,
   CASE WHEN l.header THEN {_STRIP.format("l.line")} ELSE f.title END AS title2, CASE WHEN (l.header AND f.waiting > 50) OR NOT f.open THEN l.page ELSE f.first END AS first2
  FROM f JOIN l ON l.doc_id = f.doc_id AND l.k = f.k + 1))),
c AS (SELECT doc_id, k, o.title, o.first, o.page, o.text, j FROM (SELECT doc_id, k, unnest(out) AS o, generate_subscripts(out, 1) AS j FROM f WHERE len(out) > 0)
 UNION ALL SELECT doc_id, k + 1, title, first, page, buffer, 1 FROM f WHERE k = (SELECT max(k) FROM l WHERE l.doc_id = f.doc_id)),
s AS (SELECT *, {_STRIP.format("text")} AS body FROM c)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1)::INT AS n, title, first::INT AS first_page, page::INT AS last_page, md5(body) AS chunk_md5 FROM s WHERE length(body) >= 30"""


@query("txt05_sections", _SECTIONS)
def sections(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = records.sections(docs, "doc_id", F.split("text", "\n\n"))
    return found.select("doc_id", "n", "title", "first_page", "last_page", F.md5(F.col("text").cast("binary")).alias("chunk_md5"))


@query("txt09_alternative_text", """WITH e AS (SELECT conv_id, sum(length(text)) FILTER (role = 'user') AS a, sum(length(text)) FILTER (role <> 'user') AS b FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN coalesce(a, 0) < 100 AND coalesce(b, 0) > coalesce(a, 0) THEN 'other' ELSE 'user' END AS taken, CASE WHEN coalesce(a, 0) < 100 AND coalesce(b, 0) > coalesce(a, 0) THEN b ELSE coalesce(a, 0) END::BIGINT AS chars FROM e""")
def alternative_text(spark, sf_dir):
    size = lambda own: F.coalesce(F.sum(F.when((F.col("role") == "user") == F.lit(own), F.length("text"))), F.lit(0))
    e = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(size(True).alias("a"), size(False).alias("b"))
    other = (F.col("a") < 100) & (F.col("b") > F.col("a"))
    return e.select("conv_id", F.when(other, "other").otherwise("user").alias("taken"), F.when(other, F.col("b")).otherwise(F.col("a")).alias("chars"))


@query("ups08_labels_last_write", "SELECT user_id AS concept_id, event_type AS language, arg_max(value, (ts, event_id)) AS label, max(ts) AS written FROM events GROUP BY ALL")
def labels_last_write(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("concept_id"), F.col("event_type").alias("language"), F.struct("ts", "event_id").alias("seq"), F.col("value").alias("label"), F.col("ts").alias("written"))
    return folds.fold(e, ["concept_id", "language"], last=["label"], highest=["written"])


@query("ups11_hierarchy_edges", "SELECT p_type || '/' || p_brand AS child_id, p_type AS parent_id, 'SUBCLASS_OF' AS relation, max((p_size % 10) / 10.0)::DOUBLE AS confidence FROM part GROUP BY ALL")
def hierarchy_edge_upsert(spark, sf_dir):
    said = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_type", "p_brand").alias("child_id"), F.col("p_type").alias("parent_id"), F.lit("SUBCLASS_OF").alias("relation"), (F.col("p_size") % 10 / 10.0).alias("confidence"))
    return folds.fold(said, ["child_id", "parent_id", "relation"], highest=["confidence"])


@query("ups13_contains_edges", """WITH w AS (SELECT r_name AS region, n_name AS nation, s_name AS site FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT DISTINCT region AS src, region || '/' || nation AS dst, 'nation' AS level FROM w UNION SELECT region || '/' || nation, region || '/' || nation || '/' || site, 'site' FROM w""")
def contains_edges(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    wide = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("s_name").alias("site"))
    return records.contains_edges(wide, ["region", "nation", "site"])


@query("ups14_reference_edges", """SELECT DISTINCT o_orderkey AS src, unnest(['client ' || o_custkey, o_orderpriority]) AS dst, 'SERVES' AS edge_type, 'clients' AS source_column FROM orders UNION SELECT o_orderkey, 'status ' || o_orderstatus, 'DEPENDS_ON', 'status' FROM orders WHERE o_orderkey % 2 = 0""")
def reference_edges(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit(" client "), F.col("o_custkey"), F.lit(",\n, "), F.col("o_orderpriority")).alias("clients"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("status "), F.col("o_orderstatus"))).alias("status"))
    return records.reference_edges(o, "o_orderkey", {"clients": "SERVES", "status": "DEPENDS_ON"})


@query("ups20_incident_links", """WITH i AS (SELECT event_id, unnest(['SUPPLIER#' || lpad((user_id % 40)::VARCHAR, 9, '0'), 'supplier#' || lpad((event_id % 30)::VARCHAR, 9, '0')]) AS ref FROM events WHERE event_type = 'error')
SELECT DISTINCT event_id, s_suppkey AS concept_id FROM i JOIN supplier ON lower(ref) = lower(s_name)""")
def incident_links(spark, sf_dir):
    ref = lambda prefix, n: F.concat(F.lit(prefix), F.lpad(n.cast("string"), 9, "0"))
    said = table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", F.explode(F.array(ref("SUPPLIER#", F.col("user_id") % 40), ref("supplier#", F.col("event_id") % 30))).alias("ref"))
    names = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit(None).cast("string").alias("alt_name"), F.col("s_suppkey").alias("concept_id"))
    return folds.by_either_name(said, names, "ref").select("event_id", "concept_id").distinct()


_DOCS = _CLOSED + """, t AS (SELECT concept_id, string_agg(alias, ',' ORDER BY alias) AS aliases FROM (SELECT DISTINCT 'DEPT-' || l_suppkey AS concept_id, l_returnflag || l_linestatus AS alias FROM lineitem) GROUP BY concept_id),
x AS (SELECT concept_id, string_agg(ancestor_id, ',' ORDER BY depth, ancestor_id) AS ancestor_ids, max(depth) AS hierarchy_depth FROM c GROUP BY concept_id),
docs AS (SELECT 'DEPT-' || s_suppkey AS concept_id, s_name AS name, coalesce(aliases, '') AS aliases, coalesce(ancestor_ids, '') AS ancestor_ids, coalesce(hierarchy_depth, 0) AS hierarchy_depth FROM supplier LEFT JOIN t ON t.concept_id = 'DEPT-' || s_suppkey LEFT JOIN x ON x.concept_id = 'DEPT-' || s_suppkey)"""


def _search_documents(spark, sf_dir):
    key = lambda c: F.concat(F.lit("DEPT-"), F.col(c)).alias("concept_id")
    terms = table(spark, sf_dir, "lineitem").select(key("l_suppkey"), F.concat("l_returnflag", "l_linestatus").alias("alias"))
    docs = records.search_documents(table(spark, sf_dir, "supplier").select(key("s_suppkey"), F.col("s_name").alias("name")), terms, hierarchy.closure(hierarchy_edges(spark, sf_dir)))
    return docs.select("concept_id", "name", F.array_join("aliases", ",").alias("aliases"), F.array_join("ancestor_ids", ",").alias("ancestor_ids"), "hierarchy_depth")


@query("snk02_search_documents", _DOCS + " SELECT * FROM docs")
def search_documents(spark, sf_dir):
    return _search_documents(spark, sf_dir)


@query("snk03_partial_update", _DOCS + """, u AS (SELECT 'DEPT-' || s_suppkey AS concept_id, CASE WHEN s_suppkey % 2 = 0 THEN 'moved' END AS ancestor_ids, 1 AS hierarchy_depth FROM supplier WHERE s_suppkey % 3 = 0)
SELECT d.concept_id, d.name, coalesce(u.ancestor_ids, d.ancestor_ids) AS ancestor_ids, coalesce(u.hierarchy_depth, d.hierarchy_depth) AS hierarchy_depth FROM docs d LEFT JOIN u ON d.concept_id = u.concept_id""")
def partial_update(spark, sf_dir):
    new = table(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0").select(F.concat(F.lit("DEPT-"), F.col("s_suppkey")).alias("concept_id"), F.when(F.col("s_suppkey") % 2 == 0, "moved").alias("ancestor_ids"), F.lit(1).alias("hierarchy_depth"))
    return records.update_fields(_search_documents(spark, sf_dir).drop("aliases"), new, "concept_id", ["ancestor_ids", "hierarchy_depth"])


@query("snk04_deleted_documents", "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def deleted_documents(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").join(gone, "p_partkey", "left_anti")


@query("lkp06_data_assets", "WITH a AS (SELECT DISTINCT l_partkey AS concept_id, l_suppkey AS asset_id FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY asset_id) AS position FROM a) SELECT * FROM r WHERE position <= 20")
def data_assets(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("concept_id"), F.col("l_suppkey").alias("asset_id")).distinct()
    return records.top_per(links, "concept_id", ["asset_id"], 20)


@query("lkp10_schema_context", """WITH a AS (SELECT DISTINCT p_brand AS concept, p_type AS tab FROM part), t AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY concept ORDER BY tab) <= 5),
k AS (SELECT * FROM (SELECT DISTINCT p_type AS tab, p_name AS col FROM part) QUALIFY row_number() OVER (PARTITION BY tab ORDER BY col) <= 50)
SELECT concept, tab, count(*) AS n_columns, string_agg(col, ',' ORDER BY col) AS columns FROM t JOIN k USING (tab) GROUP BY concept, tab""")
def schema_context(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    tables = records.top_per(p.select(F.col("p_brand").alias("concept"), F.col("p_type").alias("tab")).distinct(), "concept", ["tab"], 5)
    columns = records.top_per(p.select(F.col("p_type").alias("tab"), F.col("p_name").alias("col")).distinct(), "tab", ["col"], 50)
    each = columns.groupBy("tab").agg(F.count(F.lit(1)).alias("n_columns"), F.array_join(F.array_sort(F.collect_list("col")), ",").alias("columns"))
    return tables.join(each, "tab").select("concept", "tab", "n_columns", "columns")


@query("lkp09_composite_lookup", """WITH a AS (SELECT l_suppkey AS k, count(DISTINCT l_partkey) AS n_assets, count(DISTINCT l_returnflag) FILTER (l_returnflag <> 'N') AS n_aliases FROM lineitem GROUP BY l_suppkey)
SELECT s_suppkey AS concept_id, s_name AS name, coalesce(n_assets, 0) AS n_assets, coalesce(n_aliases, 0) AS n_aliases, (s_suppkey % 100) / 100.0 < 0.6 AS low_confidence FROM supplier LEFT JOIN a ON k = s_suppkey""")
def composite_lookup(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("concept_id"), "l_partkey", "l_returnflag")
    assets = line.select("concept_id", "l_partkey").distinct().groupBy("concept_id").agg(F.count(F.lit(1)).alias("n_assets"))
    aliases = line.filter("l_returnflag <> 'N'").select("concept_id", "l_returnflag").distinct().groupBy("concept_id").agg(F.count(F.lit(1)).alias("n_aliases"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("concept_id"), F.col("s_name").alias("name"))
    out = s.join(assets, "concept_id", "left").join(aliases, "concept_id", "left").na.fill(0, ["n_assets", "n_aliases"])
    return out.withColumn("low_confidence", fn.low_confidence(F.col("concept_id") % 100 / 100.0))


@query("sea08_page", "SELECT o_orderkey, o_totalprice AS score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def page(spark, sf_dir):
    return search.page(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("score")), "o_orderkey", 40, 20)


@query("sea09_missing_vectors", "SELECT DISTINCT sha256(coalesce(text, '')) AS text_hash FROM documents WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id % 2 = 0)")
def missing_vectors(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))
    return rows.unseen(d.select("text_hash").distinct(), d.filter("doc_id % 2 = 0"), ("text_hash",))


@query("agg03_stage_health", """WITH s AS (SELECT event_type AS stage, count(*) AS n, count(*) FILTER ((props->>'$.k')::INT % 5 >= 3) AS dead, greatest(1, date_diff('minute', min(ts), max(ts))) AS minutes FROM events GROUP BY event_type)
SELECT stage, n, dead, round(n / minutes, 6) AS per_minute, CASE WHEN dead > 0.5 * n THEN 'DOWN' WHEN dead > 0.1 * n THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM s""")
def stage_health(spark, sf_dir):
    return metrics.stage_health(table(spark, sf_dir, "events"), "event_type", "ts", F.get_json_object("props", "$.k").cast("int") % 5 >= 3)


@query("agg06_resolution_rate", "WITH k AS (SELECT p_name AS norm FROM part WHERE p_partkey % 3 = 0 GROUP BY p_name) SELECT p_type, count(*) AS extracted, round(count(norm) / count(*), 6) AS rate FROM part LEFT JOIN k ON p_name = norm GROUP BY p_type")
def resolution_rate(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    known = p.filter("p_partkey % 3 = 0").select("p_name").distinct().withColumn("known", F.lit(True))
    return p.join(known, "p_name", "left").groupBy("p_type").agg(F.count(F.lit(1)).alias("extracted"), F.round(metrics.rate(F.col("known"), F.lit(True)), 6).alias("rate"))


@query("agg08_match_rate", "SELECT e.event_type, round(avg((o.o_orderkey IS NOT NULL)::INT), 6) AS match_rate FROM events e LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') o ON e.event_id = o.o_orderkey GROUP BY e.event_type")
def match_rate(spark, sf_dir):
    known = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    return metrics.match_rate(table(spark, sf_dir, "events"), known, "event_id", "event_type")


@query("agg12_judge_score", "SELECT l_returnflag, round(avg(0.6 * l_discount + 0.4 * l_tax), 6) AS score FROM lineitem GROUP BY l_returnflag")
def judge_score(spark, sf_dir):
    return metrics.judge_score(table(spark, sf_dir, "lineitem"), "l_returnflag", {"l_discount": 0.6, "l_tax": 0.4})


_DECIDED = """WITH d AS (SELECT s_suppkey AS id, CASE s_suppkey % 10 WHEN 1 THEN 'REJECT' WHEN 7 THEN 'MERGE' WHEN 8 THEN 'MERGE' WHEN 3 THEN 'APPROVE' END AS resolution, s_suppkey + 1 AS target_id FROM supplier WHERE s_suppkey % 10 IN (1, 3, 7, 8)),
m AS (SELECT id, id + CASE id % 10 WHEN 7 THEN 2 ELSE 1 END AS final_id FROM d WHERE resolution = 'MERGE')"""


def _decisions(spark, sf_dir):
    last = F.col("s_suppkey") % 10
    kind = F.when(last == 1, "REJECT").when(last.isin(7, 8), "MERGE").when(last == 3, "APPROVE")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), kind.alias("resolution"), (F.col("s_suppkey") + 1).alias("target_id")).filter("resolution IS NOT NULL")


@query("evt06_decided_nodes", _DECIDED + " SELECT s_suppkey AS id, s_name AS name, CASE WHEN resolution = 'APPROVE' THEN 'APPROVED' ELSE 'PENDING' END AS status FROM supplier LEFT JOIN d ON id = s_suppkey WHERE coalesce(resolution, '') NOT IN ('REJECT', 'MERGE')")
def decided_nodes(spark, sf_dir):
    return records.decided_nodes(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), _decisions(spark, sf_dir))


@query("evt06_decided_edges", _DECIDED + """, e AS (SELECT coalesce(a.final_id, l_suppkey) AS src, coalesce(b.final_id, l_partkey) AS dst, l_discount FROM lineitem LEFT JOIN m a ON a.id = l_suppkey LEFT JOIN m b ON b.id = l_partkey)
SELECT src, dst, max(l_discount) AS confidence FROM e WHERE src <> dst AND src NOT IN (SELECT id FROM d WHERE resolution = 'REJECT') AND dst NOT IN (SELECT id FROM d WHERE resolution = 'REJECT') GROUP BY src, dst""")
def decided_edges(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_discount").alias("confidence"))
    return records.decided_edges(e, _decisions(spark, sf_dir))


@query("str01_envelopes", "SELECT event_type AS kind, count(*) AS n, count(*) FILTER (event_id % 7 = 0 OR event_id % 11 = 0) AS n_bad FROM events GROUP BY event_type")
def envelopes(spark, sf_dir):
    body = F.to_json(F.struct(F.when(F.col("event_id") % 7 != 0, F.col("event_id").cast("string")).alias("id"), F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("kind"), "ts"))
    raw = table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 11 == 0, F.concat(body, F.lit("}{"))).otherwise(body).alias("body"))
    # an envelope whose JSON is cut keeps its raw text only, so the kind is read from there
    kind = F.regexp_extract(F.col("raw"), '"kind":"([^"]*)"', 1)
    broken = raw.withColumn("value", F.when(F.col("body").endswith("}{"), F.expr("substring(body, 1, length(body) - 3)")).otherwise(F.col("body")))
    return messages.parse(broken).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"))


@query("str03_dead_letters", "SELECT event_id::VARCHAR AS id, (props->>'$.k')::INT % 5 AS retries, 'failed' AS topic FROM events WHERE event_type = 'error' AND (props->>'$.k')::INT % 5 >= 3")
def dead_letters(spark, sf_dir):
    m = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("key"), F.when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type")).alias("kind"),
                                              (F.get_json_object("props", "$.k").cast("int") % 5).alias("retry_count"), F.from_json("props", "map<string,string>").alias("payload"), F.lit("failed").alias("topic"), F.lit("timeout").alias("error"))
    return messages.dead_letters(m).select("id", F.col("payload")["_retries"].cast("int").alias("retries"), F.col("payload")["_topic"].alias("topic"))


@query("str04_keyed_order", """SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number, coalesce(ts < max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM events""")
def keyed_order(spark, sf_dir):
    m = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"))
    return messages.out_of_order(m).select("event_id", "number", "late")


_MOVED = _CLOSED.replace("h AS (", "h0 AS (", 1).replace("), up(", "), h AS (SELECT child_id, CASE WHEN child_id = 'LOC-1' THEN 'REG-0' WHEN child_id LIKE 'DEPT-%' AND parent_id = 'LOC-2' THEN 'LOC-3' ELSE parent_id END AS parent_id, relation FROM h0), up(", 1)


def _moved(spark, sf_dir):
    """The hierarchy before and after some moves, and the concepts that moved."""
    old = hierarchy_edges(spark, sf_dir)
    moved = F.when(F.col("child_id") == "LOC-1", "REG-0").when(F.col("child_id").startswith("DEPT-") & (F.col("parent_id") == "LOC-2"), "LOC-3")
    return old, old.withColumn("parent_id", F.coalesce(moved, F.col("parent_id"))), old.filter(moved.isNotNull()).select(F.col("child_id").alias("concept_id")).distinct()


@query("str10_refreshed_ancestors", _MOVED + " SELECT concept_id, ancestor_id, depth, relation_path FROM c")
def refreshed_ancestors(spark, sf_dir):
    old, new, changed = _moved(spark, sf_dir)
    return hierarchy.refreshed(hierarchy.closure(old), new, changed).select("concept_id", "ancestor_id", "depth", "relation_path")


@query("str10_refreshed_downstream", _MOVED + ", n AS (SELECT child_id AS node FROM h UNION SELECT parent_id FROM h) SELECT node, count(c.ancestor_id) AS downstream FROM n LEFT JOIN c ON c.concept_id = node GROUP BY node")
def refreshed_downstream(spark, sf_dir):
    """Counts of what concepts lead to; sketches of so few nodes are exact."""
    old, new, changed = _moved(spark, sf_dir)
    graph = lambda e: e.select(F.col("child_id").alias("src"), F.col("parent_id").alias("dst"), F.lit("FEEDS").alias("edge_type"), F.lit("LOW").alias("criticality"), F.lit(False).alias("mitigated"))
    n = new.select(F.col("child_id").alias("node")).unionByName(new.select(F.col("parent_id").alias("node"))).distinct()
    made = impact.refreshed_sketches(impact.downstream_sketches(n, graph(old), 6), n, graph(new), changed.select(F.col("concept_id").alias("node")), 6)
    return impact.estimates(made, 6).select("node", F.col("downstream").cast("long").alias("downstream"))
