"""Upserts, stores, text rules, full-text lookups, downstream counts and reports over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.functions import text as fn
from gridloom.operators import folds, impact, profiles, search
from gridloom.plans import lineage
from gridloom.plans.impact_queries import VIEWS, _from, _reach, _ways, incidents
from gridloom.plans.knowledge_queries import _CLOSED, hierarchy_edges
from gridloom.plans.registry import query
from gridloom.plans.views import links, nodes, table
from gridloom.sources import events as store
from gridloom.sources import rows


# -- sources and stores ------------------------------------------------------------------------------------------

@query("src01_binary_documents")
def binary_documents(spark, sf_dir):
    """The files of the given tables themselves, with size and hash of each."""
    return rows.binary_documents(spark, sf_dir, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "size", "content_hash")


@query("src02_documents_since")
def documents_since(spark, sf_dir):
    return rows.binary_documents(spark, sf_dir, "*.parquet", since="1971-01-01", hashed=False).select(F.element_at(F.split("path", "/"), -1).alias("name"), "size")


@query("snk01_provenance_rows", """SELECT user_id || '::' || event_type AS doc_id, arg_min(event_id::VARCHAR, (ts, event_id)) AS title, min(ts) AS created, max(ts) AS updated FROM events GROUP BY user_id, event_type""")
def provenance_rows(spark, sf_dir):
    said = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("chunk"), F.col("event_id").cast("string").alias("title"), F.lit("events").alias("connector"), F.struct("ts", "event_id").alias("seq"))
    return folds.document_rows(said).select("doc_id", "title", F.col("created.ts").alias("created"), F.col("updated.ts").alias("updated"))


@query("evt01_event_store", "SELECT ts::DATE AS day, event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events WHERE ts >= TIMESTAMP '2024-01-03' GROUP BY ALL")
def event_store(spark, sf_dir):
    path = f"{lineage.folder(spark)}/events-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events")
    late = F.col("event_type") == "error"
    store.append(e.filter(~late), path)
    store.append(e.filter(late), path)
    return store.read(spark, path, "2024-01-03").groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("str08_replay", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type")
def replay(spark, sf_dir):
    """Two streams over one store, the second with a checkpoint of its own: it sees all events again."""
    base = f"{lineage.folder(spark)}/replay-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    store.append(e, f"{base}/store")
    for run in ("first", "again"):
        stream = store.replay(spark, f"{base}/store", store.read(spark, f"{base}/store").schema)
        stream.writeStream.format("parquet").option("path", f"{base}/{run}").option("checkpointLocation", f"{base}/{run}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/again").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


# -- functions ---------------------------------------------------------------------------------------------------

_UUID = "h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || CASE (strpos('0123456789abcdef', h[17:17]) - 1) % 4 WHEN 0 THEN '8' WHEN 1 THEN '9' WHEN 2 THEN 'a' ELSE 'b' END || h[18:20] || '-' || h[21:32]"
_DNS = "sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode({}))"


@query("fn06_ids", f"""WITH k AS (SELECT p_partkey, unnest([lower(p_name) || '::en', 'db.' || p_brand, 'class::' || lower(p_type)]) AS name, unnest(['term', 'asset', 'class']) AS kind FROM part), x AS (SELECT p_partkey, kind, {_DNS.format('name')} AS h FROM k)
SELECT p_partkey, kind, {_UUID} AS id FROM x""")
def ids(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", fn.term_id(F.lower("p_name"), F.lit("en")).alias("term"), fn.asset_id(F.concat(F.lit("db."), "p_brand")).alias("asset"), fn.class_id(F.col("p_type")).alias("class"))
    return p.unpivot(["p_partkey"], ["term", "asset", "class"], "kind", "id")


@query("fn09_node_labels", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Site' WHEN 1 THEN 'System' ELSE 'Facility' END AS label, CASE WHEN o_orderkey % 3 = 0 THEN o_clerk ELSE 'שם' END AS shown, substring(repeat(o_clerk, 40), 1, 500) AS quote FROM orders""".replace("o_clerk", "o_orderpriority"))
def node_labels(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("SITE", "sysTem", "unknown", "facility"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    hebrew = F.when(F.col("o_orderkey") % 3 == 1, "שם").when(F.col("o_orderkey") % 3 == 0, "").otherwise("שם")
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.node_label(kind).alias("label"), fn.display(hebrew, F.col("o_orderpriority")).alias("shown"), fn.short_quote(F.repeat("o_orderpriority", 40)).alias("quote"))


@query("txt03_abbreviations", """SELECT conv_id, turn, len(regexp_extract_all(text || ' מפ"ג ' || turn || ' ר"מ א"', '([א-ת]+"[א-ת]+)')) AS n, array_to_string(regexp_extract_all(text || ' מפ"ג ' || turn || ' ר"מ א"', '([א-ת]+"[א-ת]+)'), ' ') AS found FROM conversations""")
def abbreviations(spark, sf_dir):
    found = fn.quoted_abbreviations(F.concat("text", F.lit(' מפ"ג '), F.col("turn").cast("string"), F.lit(' ר"מ א"')))
    return table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", F.size(found).cast("long").alias("n"), F.array_join(found, " ").alias("found"))


# -- upserts -----------------------------------------------------------------------------------------------------

@query("ups04_relations_by_name", """SELECT s_suppkey AS src, l_partkey AS dst, l_returnflag AS type, max(l_discount) AS confidence, arg_min(l_linenumber, (l_orderkey, l_linenumber, l_quantity)) AS quote FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey % 5 > 0 GROUP BY ALL""")
def relations_by_name(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey")).alias("concept_id"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("name"))
    p = table(spark, sf_dir, "part").filter("p_partkey % 5 > 0").select(F.col("p_partkey").alias("concept_id"), F.concat(F.lit("p"), F.col("p_partkey")).alias("name"))
    said = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("from_name"), F.concat(F.lit("p"), F.col("l_partkey")).alias("to_name"), F.col("l_returnflag").alias("type"), F.col("l_discount").alias("confidence"), F.col("l_linenumber").alias("quote"), F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("seq"))
    return folds.relations_by_name(said, s.unionByName(p))


@query("ups05_asset_links", """WITH n AS (SELECT lower(s_name) AS k, s_suppkey AS concept_id FROM supplier UNION SELECT 'alt-' || s_suppkey, s_suppkey FROM supplier WHERE s_suppkey % 2 = 0),
a AS (SELECT 'alt-' || (o_custkey % 60) AS k, o_orderpriority AS qualified_name, o_orderstatus AS mapping_type, o_totalprice AS confidence, o_orderkey FROM orders)
SELECT concept_id, qualified_name, arg_min(mapping_type, o_orderkey) AS mapping_type, arg_min(confidence, o_orderkey) AS confidence FROM a JOIN n USING (k) GROUP BY ALL""")
def asset_links(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("ALT-"), F.col("s_suppkey"))).alias("alt_name"), F.col("s_suppkey").alias("concept_id"))
    said = table(spark, sf_dir, "orders").select(F.concat(F.lit("Alt-"), F.col("o_custkey") % 60).alias("concept_name"), F.col("o_orderpriority").alias("qualified_name"), F.col("o_orderstatus").alias("mapping_type"), F.col("o_totalprice").alias("confidence"), F.lit(None).cast("string").alias("notes"), F.col("o_orderkey").alias("seq"))
    return folds.asset_links(said, names).select("concept_id", "qualified_name", "mapping_type", "confidence")


@query("ups05_assets", "SELECT o_orderpriority AS qualified_name, arg_min(o_orderstatus, o_orderkey) AS name, min(o_orderkey) AS created, max(o_orderkey) AS updated FROM orders GROUP BY o_orderpriority")
def assets(spark, sf_dir):
    said = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("qualified_name"), F.col("o_orderstatus").alias("name"), F.lit("TABLE").alias("asset_type"), F.col("o_orderkey").alias("seq"))
    return folds.assets(said).select("qualified_name", "name", "created", "updated")


@query("ups07_class_flags", "SELECT user_id AS concept_id, arg_max(event_type = 'view', (ts, event_id)) AS is_class, arg_max(event_type = 'error', (ts, event_id)) AS is_deprecated, arg_max(event_id, (ts, event_id)) AS superseded_by FROM events GROUP BY user_id")
def class_flags(spark, sf_dir):
    said = table(spark, sf_dir, "events").select(F.col("user_id").alias("concept_id"), (F.col("event_type") == "view").alias("is_class"), (F.col("event_type") == "error").alias("is_deprecated"), F.col("event_id").alias("superseded_by"), F.struct("ts", "event_id").alias("seq"))
    return folds.class_flags(said)


@query("ups16_mentions", "SELECT DISTINCT o_custkey AS src, unnest([o_orderpriority, o_orderstatus]) AS dst, 'MENTIONS_CONCEPT' AS edge_type FROM orders")
def mentions(spark, sf_dir):
    said = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.array("o_orderpriority", "o_orderstatus").alias("nodes"))
    return folds.mentions(said, F.col("name"))


def _dependencies(spark, sf_dir):
    said = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("src"), (F.col("event_id") % 20).alias("dst"), F.upper("event_type").alias("edge_type"), F.col("value").alias("criticality"), F.lit("DIRECT").alias("propagation_mode"), (F.col("event_id") % 2 == 0).alias("mitigated"),
        F.col("event_id").alias("recovery_hours"), F.col("event_id").alias("condition"), F.struct("ts", "event_id").alias("seq"))
    return folds.dependency_edges(said, ["VIEW", "CLICK"])


@query("ups22_dependency_edges", """SELECT user_id AS src, event_id % 20 AS dst, upper(event_type) AS edge_type, arg_min(event_id, (ts, event_id)) AS condition, arg_max(event_id % 2 = 0, (ts, event_id)) AS mitigated, arg_max(event_id, (ts, event_id)) AS recovery_hours
FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL""")
def dependency_edges(spark, sf_dir):
    return _dependencies(spark, sf_dir)[0].select("src", "dst", "edge_type", "condition", "mitigated", "recovery_hours")


@query("ups22_rejected_edges", "SELECT event_id AS condition, 'edge_type' AS review_reason FROM events WHERE event_type NOT IN ('view', 'click')")
def rejected_edges(spark, sf_dir):
    return _dependencies(spark, sf_dir)[1].select("condition", "review_reason")


# -- lookups and search ------------------------------------------------------------------------------------------

_TOKENS = r"list_filter(string_split(trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), ' '), lambda x: length(x) >= 1)"


def _scores(fields: dict[str, tuple[str, float]], docs: str, queries: str) -> str:
    """CTE r (query_id, id, score, rank). fields: name -> (SQL text, boost)."""
    each = " UNION ALL ".join(f"SELECT id, '{f}' AS field, {w}::DOUBLE AS boost, {_TOKENS.format(x)} AS t FROM ({docs})" for f, (x, w) in fields.items())
    return f"""WITH q AS (SELECT query_id, unnest(list_distinct({_TOKENS.format('text')})) AS term FROM ({queries})), a AS (SELECT * FROM ({each}) WHERE len(t) > 0),
s AS (SELECT field, count(*) AS n, avg(len(t)) AS a FROM a GROUP BY field), p AS (SELECT field, boost, term, id, count(*) AS tf, any_value(len) AS len FROM (SELECT field, boost, id, len(t) AS len, unnest(t) AS term FROM a) GROUP BY ALL),
d AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL),
z AS (SELECT query_id, id, round(sum(round(1e9 * (boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a)))))::BIGINT) / 1e9, 6) AS score FROM q JOIN p USING (term) JOIN d USING (field, term) JOIN s USING (field) GROUP BY query_id, id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM z)"""


_FIVE = {"name_he": ("name_he", 4), "name": ("name", 3), "aliases": ("aliases", 2), "description": ("description", 1), "description_he": ("description_he", 1)}
_CONCEPTS = "SELECT p_partkey AS id, p_name AS name, 'שם ' || p_brand AS name_he, p_brand || ' ' || p_type AS aliases, p_type || ' ' || p_name AS description, 'תיאור ' || p_type AS description_he FROM part"
_ASKED = "SELECT p_type AS query_id, p_type || ' שם' AS text FROM part GROUP BY p_type"


def concepts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("שם "), "p_brand").alias("name_he"), F.array("p_brand", "p_type").alias("aliases"), F.concat_ws(" ", "p_type", "p_name").alias("description"), F.concat(F.lit("תיאור "), "p_type").alias("description_he"),
        F.when(F.col("p_partkey") % 9 == 0, "DEPRECATED").otherwise("ACTIVE").alias("status"))


@query("sea01_five_fields", _scores(_FIVE, _CONCEPTS, _ASKED) + " SELECT query_id, id, round(score, 4) AS score FROM r WHERE rank <= 10")
def five_fields(spark, sf_dir):
    asked = table(spark, sf_dir, "part").select(F.col("p_type").alias("query_id"), F.concat("p_type", F.lit(" שם")).alias("text")).distinct()
    return search.bm25(asked, concepts(spark, sf_dir), search.CONCEPT_FIELDS, 10).select("query_id", "id", F.round("score", 4).alias("score"))


_VECTORS = "SELECT vec_id AS id, text, embedding FROM embeddings JOIN documents ON doc_id = vec_id"
_MODES = _scores({"text": ("coalesce(text, '')", 1)}, _VECTORS, "SELECT item_id AS query_id, text FROM benchmark JOIN embeddings ON vec_id = item_id") + f""", dots AS (SELECT a.vec_id AS query_id, b.id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS dot
 FROM embeddings a JOIN benchmark ON item_id = a.vec_id, ({_VECTORS}) b), k AS (SELECT query_id, id, round(dot, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(dot, 6) DESC, id) AS rank FROM dots),
u AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (20 + rank)), 6) AS score FROM (SELECT query_id, id, rank FROM r WHERE rank <= 10 UNION ALL SELECT query_id, id, rank FROM k WHERE rank <= 10) GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM u)
SELECT 'lexical' AS mode, query_id, id, rank FROM r WHERE rank <= 5 UNION ALL SELECT 'semantic', query_id, id, rank FROM k WHERE rank <= 5 UNION ALL SELECT 'hybrid', query_id, id, rank FROM f WHERE rank <= 5"""


@query("sea07_modes", _MODES)
def modes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    docs = e.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(e.withColumnRenamed("id", "query_id"), "query_id")
    out = None
    for mode in ("lexical", "semantic", "hybrid"):
        found = search.find(asked, docs, mode, 5, {"text": 1.0}).select(F.lit(mode).alias("mode"), "query_id", "id", "rank")
        out = found if out is None else out.unionByName(found)
    return out


_EQUAL = {"name": ("name", 1), "description": ("description", 1), "name_he": ("name_he", 1), "description_he": ("description_he", 1)}


@query("lkp02_fulltext_fallback", _scores(_EQUAL, _CONCEPTS + " WHERE p_partkey % 9 > 0", "SELECT DISTINCT p_brand || ' ' || p_type AS query_id, p_brand || ' ' || p_type AS text FROM part") + " SELECT query_id AS name, id, round(score, 4) AS score FROM r WHERE rank = 1")
def fulltext_fallback(spark, sf_dir):
    asked = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("name")).distinct()
    return search.best_hit(asked, concepts(spark, sf_dir)).select("name", "id", F.round("score", 4).alias("score"))


@query("sea10_term_fulltext", _scores({"surface_form": ("p_name", 1), "normalized_form": ("lower(p_name)", 1)}, "SELECT p_partkey AS id, p_name FROM part", "SELECT DISTINCT p_type AS query_id, p_type || ' ' || p_type AS text FROM part UNION SELECT p_name, p_name FROM part WHERE p_size = 1") + " SELECT query_id, id, round(score, 4) AS score FROM r WHERE rank <= 3")
def term_fulltext(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    terms = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("surface_form"), F.lower("p_name").alias("normalized_form"))
    asked = p.select(F.col("p_type").alias("query_id"), F.concat_ws(" ", "p_type", "p_type").alias("text")).union(p.filter("p_size = 1").select("p_name", "p_name")).distinct()
    return search.bm25(asked, terms, search.TERM_FULLTEXT, 3).select("query_id", "id", F.round("score", 4).alias("score"))


@query("lkp14_names_in_any_case", VIEWS + " SELECT 'Loc-' || n_nationkey AS name, 'LOC-' || n_nationkey AS node FROM nation UNION ALL SELECT 'dept-' || s_suppkey, 'DEPT-' || s_suppkey FROM supplier")
def names_in_any_case(spark, sf_dir):
    said = table(spark, sf_dir, "nation").select(F.concat(F.lit("Loc-"), F.col("n_nationkey")).alias("name")).union(table(spark, sf_dir, "supplier").select(F.concat(F.lit("dept-"), F.col("s_suppkey")))).union(table(spark, sf_dir, "nation").select(F.concat(F.lit("none-"), F.col("n_nationkey"))))
    return impact.entity_ids(said, nodes(spark, sf_dir))


_FULL = _CLOSED + """, k AS (SELECT DISTINCT child_id AS concept_id FROM h UNION SELECT parent_id FROM h),
a AS (SELECT concept_id, string_agg(ancestor_id || ':' || list_extract(string_split(relation_path, '>'), -1), ',' ORDER BY depth, ancestor_id) AS ancestors, string_agg('About ' || ancestor_id, chr(10) ORDER BY depth, ancestor_id) AS context FROM c GROUP BY concept_id),
b AS (SELECT parent_id AS concept_id, string_agg(child_id, ',' ORDER BY child_id) FILTER (relation = 'SUBCLASS_OF') AS subclasses, string_agg(child_id, ',' ORDER BY child_id) FILTER (relation <> 'SUBCLASS_OF') AS instances FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY child_id) AS n FROM h) WHERE n <= 50 GROUP BY parent_id),
s AS (SELECT child_id AS concept_id, string_agg(sibling_id, ',' ORDER BY sibling_id) AS siblings FROM (SELECT *, row_number() OVER (PARTITION BY child_id ORDER BY sibling_id) AS n FROM (SELECT DISTINCT x.child_id, y.child_id AS sibling_id FROM h x JOIN h y ON x.parent_id = y.parent_id AND x.child_id <> y.child_id)) WHERE n <= 20 GROUP BY child_id)
SELECT k.concept_id, coalesce(ancestors, '') AS ancestors, coalesce(subclasses, '') AS subclasses, coalesce(instances, '') AS instances, coalesce(siblings, '') AS siblings, 'en=' || lower(k.concept_id) || ',he=' || k.concept_id AS labels, coalesce(context, '') AS context FROM k LEFT JOIN a USING (concept_id) LEFT JOIN b USING (concept_id) LEFT JOIN s USING (concept_id)"""


@query("hie11_full_records", _FULL)
def full_records(spark, sf_dir):
    h = hierarchy_edges(spark, sf_dir)
    known = h.select(F.col("child_id").alias("concept_id")).union(h.select("parent_id")).distinct()
    about = known.select("concept_id", F.col("concept_id").alias("name"), F.concat(F.lit("About "), "concept_id").alias("description"))
    labels = known.select("concept_id", F.lit("he").alias("language"), F.col("concept_id").alias("label")).union(known.select("concept_id", F.lit("en"), F.lower("concept_id")))
    none = known.select("concept_id", F.lit("p").alias("property"), F.lit("v").alias("value")).filter("false")
    r = profiles.full_records(h, about, labels, none)
    join = lambda c, f: F.array_join(F.transform(c, f), ",").alias(c)
    return r.select("concept_id", join("ancestors", lambda x: F.concat_ws(":", x["concept_id"], x["relation"])), *[F.array_join(c, ",").alias(c) for c in ("subclasses", "instances", "siblings")], join("labels", lambda x: F.concat_ws("=", x["language"], x["label"])), "context")


@query("lkp09_answers", """WITH asked AS (SELECT DISTINCT 'SUPPLIER#' || lpad((o_orderkey % 150)::VARCHAR, 9, '0') AS term FROM orders UNION SELECT 'also ' || n_nationkey FROM nation), n AS (SELECT lower(s_name) AS k, s_suppkey AS concept_id FROM supplier UNION ALL SELECT 'also ' || s_suppkey, s_suppkey FROM supplier WHERE s_suppkey % 2 = 0),
m AS (SELECT k, min(concept_id) AS concept_id FROM n GROUP BY k), p AS (SELECT l_suppkey AS concept_id, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS data_assets, count(DISTINCT l_orderkey) AS n_sources FROM lineitem GROUP BY l_suppkey),
r AS (SELECT s_suppkey AS concept_id, 'LOC-' || s_nationkey AS related FROM supplier)
SELECT term, m.concept_id IS NOT NULL AS found, m.concept_id, s_name AS name, CASE WHEN m.concept_id % 2 = 0 THEN 'also ' || m.concept_id ELSE '' END AS aliases, coalesce(related, '') AS related, coalesce(data_assets, '') AS data_assets, coalesce(n_sources, 0) AS sources_count,
 CASE WHEN m.concept_id IS NOT NULL THEN coalesce(CASE WHEN m.concept_id % 4 > 0 THEN (m.concept_id % 100) / 100.0::DOUBLE END, 0.7) END AS confidence, CASE WHEN m.concept_id IS NOT NULL THEN 'CANDIDATE' END AS status, coalesce(coalesce(CASE WHEN m.concept_id % 4 > 0 THEN (m.concept_id % 100) / 100.0 END, 0.7) < 0.6 AND m.concept_id IS NOT NULL, false) AS low_confidence
FROM asked LEFT JOIN m ON lower(term) = m.k LEFT JOIN supplier ON s_suppkey = m.concept_id LEFT JOIN p ON p.concept_id = m.concept_id LEFT JOIN r ON r.concept_id = m.concept_id""")
def answers(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    asked = table(spark, sf_dir, "orders").select(F.concat(F.lit("SUPPLIER#"), F.lpad((F.col("o_orderkey") % 150).cast("string"), 9, "0")).alias("term")).union(table(spark, sf_dir, "nation").select(F.concat(F.lit("also "), F.col("n_nationkey"))))
    surfaces = s.select(F.col("s_suppkey").alias("concept_id"), F.col("s_name").alias("surface"), F.lit("OFFICIAL").alias("form")).union(s.filter("s_suppkey % 2 = 0").select("s_suppkey", F.concat(F.lit("also "), F.col("s_suppkey")), F.lit("ALIAS")))
    none = F.lit(None).cast("string")
    known = s.select(F.col("s_suppkey").alias("concept_id"), F.col("s_name").alias("name"), none.alias("name_he"), none.alias("description"), none.alias("description_he"), F.when(F.col("s_suppkey") % 4 > 0, F.col("s_suppkey") % 100 / 100.0).alias("confidence"), none.alias("status"))
    line = table(spark, sf_dir, "lineitem")
    sources = profiles.provenance(line.select(F.col("l_suppkey").alias("concept_id"), F.col("l_orderkey").cast("string").alias("source"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("ts")))
    out = profiles.lookup_answers(asked, surfaces, known, s.select(F.col("s_suppkey").alias("concept_id"), F.concat(F.lit("LOC-"), F.col("s_nationkey")).alias("other")), line.select(F.col("l_suppkey").alias("concept_id"), F.col("l_partkey").cast("string").alias("other")), sources)
    return out.select("term", "found", "concept_id", "name", *[F.array_join(c, ",").alias(c) for c in ("aliases", "related", "data_assets")], "sources_count", "confidence", "status", "low_confidence")


# -- impact ------------------------------------------------------------------------------------------------------

@query("gra13_downstream_counts", _reach("SELECT node AS origin, node, 0 AS hop FROM nodes", 10, False) + ", d AS (SELECT origin, count(*) AS downstream FROM reach GROUP BY origin) SELECT node, coalesce(downstream, 0) AS downstream FROM nodes LEFT JOIN d ON origin = node")
def downstream_counts(spark, sf_dir):
    """Exact, for every node, as far as ten hops."""
    every = nodes(spark, sf_dir).select(F.col("node").alias("origin"))
    return impact.downstream_counts(every, links(spark, sf_dir), 10).withColumnRenamed("origin", "node")


@query("gra13_downstream_estimates")
def downstream_estimates(spark, sf_dir):
    """By sketches; tests compare them with the exact counts."""
    return impact.downstream_estimates(nodes(spark, sf_dir), links(spark, sf_dir), 10)


def _told(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("event_id").alias("incident_id"), F.when(F.col("event_id") % 2 == 0, F.array(F.lit("call"), F.lit("restart"), F.lit("wait"))).otherwise(F.array().cast("array<string>")).alias("actions"), (F.col("event_id") % 48).alias("recovery_hours"), F.lit(0.8).alias("confidence"), F.concat(F.lit("report-"), F.col("event_id")).alias("source"))
    return incidents(spark, sf_dir).join(e, "incident_id")


@query("gra16_precedents", """WITH i AS (SELECT event_id, ts::DATE AS d, lower('Loc-' || (user_id % 25)) AS a, lower('SYS-' || (event_id % 200)) AS b FROM events WHERE event_type = 'error'), n AS (SELECT 'LOC-' || n_nationkey AS node FROM nation),
h AS (SELECT node, event_id, d, row_number() OVER (PARTITION BY node ORDER BY d DESC NULLS LAST, event_id) AS k FROM n JOIN i ON lower(node) IN (a, b))
SELECT node, 'historical_precedent' AS option_type, 'report-' || event_id AS source, (event_id % 48)::INT AS recovery_hours, 0.8::DOUBLE AS confidence, 'Historical precedent (' || d || '): call; restart' AS description FROM h WHERE k <= 2 AND event_id % 2 = 0""")
def precedents(spark, sf_dir):
    return impact.precedents(_from(spark, sf_dir, "LOCATION").withColumnRenamed("origin", "node"), _told(spark, sf_dir))


@query("gra29_report_context", """WITH i AS (SELECT event_id, ts::DATE AS d, lower('Loc-' || (user_id % 25)) AS a, lower('SYS-' || (event_id % 200)) AS b FROM events WHERE event_type = 'error'), n AS (SELECT 'LOC-' || n_nationkey AS node FROM nation),
h AS (SELECT node, event_id, d, row_number() OVER (PARTITION BY node ORDER BY d DESC NULLS LAST, event_id) AS k FROM n JOIN i ON lower(node) IN (a, b))
SELECT n.node AS origin, '=== HISTORICAL CONTEXT ===' || chr(10) || CASE WHEN event_id IS NULL THEN '  No closely matching historical incidents found in knowledge base.' ELSE '  Most recent: error ' || event_id || ' | ' || d || chr(10) || '  Outcome: not recorded' END || chr(10) || chr(10) || 'COVERAGE_CONFIDENCE: 0.9' || chr(10) || 'LOW_COVERAGE_ENTITIES: ' || n.node AS text
FROM n LEFT JOIN h ON h.node = n.node AND k = 1""")
def report_context(spark, sf_dir):
    at = _from(spark, sf_dir, "LOCATION")
    past = impact.history(incidents(spark, sf_dir), at.withColumnRenamed("origin", "name"), limit=1).withColumns({"title": F.concat(F.lit("error "), F.col("incident_id")), "outcome": F.lit(None).cast("string")})
    return impact.report_context(at, past, F.lit("0.9"), F.array("origin"))


_RECORD = _ways("SELECT node AS origin, node, 0 AS hop, NULL::INT AS r, node AS path, '' AS edge_path FROM nodes WHERE entity_type = 'LOCATION'", 5) + """, t AS (SELECT w.origin, w.hop, w.node, w.path, n.entity_type, w.r % 2 = 1 AS mitigated,
 CASE WHEN n.status IN ('PLANNED', 'SUSPENDED') THEN 'MONITOR' WHEN n.client_tier = 'TIER_1' AND n.sla_hours <= 24 THEN CASE WHEN w.r % 2 = 1 THEN 'HIGH' ELSE 'CRITICAL' END WHEN w.r // 2 = 0 THEN CASE WHEN w.r % 2 = 1 THEN 'HIGH' ELSE 'CRITICAL' END WHEN w.r // 2 = 1 THEN 'HIGH' ELSE 'MONITOR' END AS tier FROM ways w LEFT JOIN nodes n ON n.node = w.node)"""


@query("gra30_report_record", _RECORD + """, g AS (SELECT origin, count(*) AS total, string_agg(node, ',' ORDER BY hop, node) FILTER (tier = 'CRITICAL') AS c, string_agg(node, ',' ORDER BY hop, node) FILTER (tier = 'HIGH') AS h, string_agg(node, ',' ORDER BY hop, node) FILTER (tier = 'MONITOR') AS m FROM t GROUP BY origin)
SELECT n.node AS location_name, n.node || ' is unavailable (disruption: UNAVAILABLE). ' || coalesce(total, 0) || ' entities affected. Report generated from structured data — LLM unavailable.' AS situation, concat_ws(',', c, h, m) AS named_entities, 'LOW' AS confidence
FROM nodes n LEFT JOIN g ON g.origin = n.node WHERE n.entity_type = 'LOCATION'""")
def report_record(spark, sf_dir):
    at = _from(spark, sf_dir, "LOCATION")
    hit = impact.propagate(at, nodes(spark, sf_dir), links(spark, sf_dir), 5, ways=False)
    return impact.report_record(at, hit).select("location_name", "situation", F.array_join("named_entities", ",").alias("named_entities"), "confidence")


@query("gra29_all_report_lines", _RECORD + """ SELECT origin, tier, count(*) AS n, string_agg('- ' || node || ' (' || entity_type || ') via ' || array_to_string(string_split(path, ' > ')[greatest(len(string_split(path, ' > ')) - 2, 1):], ' > ') || CASE WHEN mitigated THEN ' [mitigated]' ELSE '' END, chr(10) ORDER BY hop, node) AS text FROM t GROUP BY ALL""")
def all_report_lines(spark, sf_dir):
    return impact.report_lines(impact.propagate(_from(spark, sf_dir, "LOCATION"), nodes(spark, sf_dir), links(spark, sf_dir), 5, tail=True))
