"""Terms, concepts, hierarchy, search and upserts over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.functions import text as fn
from gridloom.operators import folds, hierarchy, resolve, search
from gridloom.plans.registry import query
from gridloom.plans.views import table


# -- functions ---------------------------------------------------------------------------------------------------

@query("fn02_normal_terms", "SELECT p_partkey, translate(trim(lower('  ' || p_name || '-X_y ')), '-_', '  ') AS term FROM part")
def normal_terms(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fn.normal_term(F.concat(F.lit("  "), F.col("p_name"), F.lit("-X_y "))).alias("term"))


_SPELT = """t AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN ' צַהַ"ל - F-35   ' || s_name || ' ' WHEN 1 THEN ' Fuel-Depot_' || s_name || '  x ' ELSE 'Cafe' || chr(769) || ' שָׁלוֹם-״א״ ' || s_name END AS term FROM supplier)"""


@query("fn03_dispatched_terms", f"""WITH {_SPELT} SELECT s_suppkey, CASE WHEN regexp_matches(term, '[א-ת]') THEN trim(regexp_replace(lower(nfc_normalize(regexp_replace(regexp_replace(term, '[\\x{{05B0}}-\\x{{05C7}}]', '', 'g'), '[״"]', '', 'g'))), '\\s+', ' ', 'g'))
 ELSE translate(trim(lower(term)), '-_', '  ') END AS norm FROM t""")
def dispatched_terms(spark, sf_dir):
    """Names spelt in Hebrew with marks, in English, and in both."""
    n, key = F.col("s_name"), F.col("s_suppkey") % 3
    spelt = F.when(key == 0, F.concat(F.lit(' צַהַ"ל - F-35   '), n, F.lit(" "))).when(key == 1, F.concat(F.lit(" Fuel-Depot_"), n, F.lit("  x "))).otherwise(F.concat(F.lit("Cafe\u0301 שָׁלוֹם-״א״ "), n))
    return table(spark, sf_dir, "supplier").select("s_suppkey", fn.normal_term(spelt).alias("norm"))


@query("fn05_concept_ids", """WITH h AS (SELECT p_partkey, sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(lower(p_name) || p_partkey)) AS h FROM part)
SELECT p_partkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || CASE (strpos('0123456789abcdef', h[17:17]) - 1) % 4 WHEN 0 THEN '8' WHEN 1 THEN '9' WHEN 2 THEN 'a' ELSE 'b' END || h[18:20] || '-' || h[21:32] AS concept_id FROM h""")
def concept_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fn.uuid5(F.concat(F.lower("p_name"), F.col("p_partkey").cast("string"))).alias("concept_id"))


@query("fn07_names_and_defaults", """SELECT s_suppkey, list_extract(string_split('db.public.' || lower(s_name), '.'), -1) AS asset, upper(replace('depends on', ' ', '_')) AS edge_type, CASE WHEN s_suppkey % 3 = 0 THEN 'INTERNAL' ELSE 'CONFIDENTIAL' END AS sensitivity,
 coalesce(CASE WHEN s_suppkey % 4 > 0 THEN (s_suppkey % 100) / 100.0 END, 0.7) < 0.6 AS low_confidence FROM supplier""")
def names_and_defaults(spark, sf_dir):
    kind = F.when(F.col("s_suppkey") % 3 == 0, "ROLE").otherwise("SYSTEM")
    confidence = F.when(F.col("s_suppkey") % 4 > 0, (F.col("s_suppkey") % 100) / 100.0)
    return table(spark, sf_dir, "supplier").select("s_suppkey", fn.asset_name(F.concat(F.lit("db.public."), F.lower("s_name"))).alias("asset"), fn.edge_type(F.lit("depends on")).alias("edge_type"), fn.default_sensitivity(kind).alias("sensitivity"), fn.low_confidence(confidence).alias("low_confidence"))


@query("fn17_token_estimates", r"SELECT doc_id, length(coalesce(text, '')) // 4 AS tokens, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 0 ELSE len(regexp_split_to_array(trim(coalesce(text, ''), ' '), '\s+')) END AS words FROM documents")
def token_estimates(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", fn.token_estimate(t).alias("tokens"), fn.word_count(t).alias("words"))


# -- texts -------------------------------------------------------------------------------------------------------

@query("txt01_clean_text", r"""WITH c AS (SELECT doc_id, regexp_replace(nfc_normalize(regexp_replace(text, '[\x{05B0}-\x{05C7}]', '', 'g')), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS t FROM documents)
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS clean_sha256 FROM c""")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(fn.clean_text(F.col("text")), 256).alias("clean_sha256"))


_HEADER = r"""length(t) > 0 AND length(t) <= 80 AND (regexp_matches(t, '^(\p{Nd}+\.|א\.-ת\.)') OR (length(t) <= 40 AND t = upper(t) AND regexp_matches(t, '\p{L}')) OR """ + " OR ".join(f"starts_with(t, '{w}') OR ends_with(t, '{w}')" for w in fn.HEADER_WORDS) + ")"


@query("txt04_section_headers", rf"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents), t AS (SELECT doc_id, trim(x, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER ({_HEADER}) AS n_headers FROM t GROUP BY doc_id""")
def section_headers(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("x"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(fn.is_header(F.col("x")).cast("long")).alias("n_headers"))


@query("txt06_fixed_windows", r"""WITH w AS (SELECT doc_id, text, unnest(range(0, length(text), 1300)) AS start FROM documents)
SELECT doc_id, start::INT AS start, md5(substring(text, start + 1, 1500)) AS chunk_md5 FROM w WHERE length(trim(substring(text, start + 1, 1500), ' ' || chr(9) || chr(10) || chr(13))) >= 20""")
def fixed_windows(spark, sf_dir):
    parts = table(spark, sf_dir, "documents").select("doc_id", F.explode(fn.windows(F.col("text"))).alias("w"))
    return parts.select("doc_id", F.col("w.start").alias("start"), F.md5(F.col("w.text").cast("binary")).alias("chunk_md5"))


@query("txt07_chunk_rows", r"""WITH w AS (SELECT doc_id, text, unnest(range(0, length(text), 1300)) AS start FROM documents), c AS (SELECT doc_id, start, substring(text, start + 1, 1500) AS t FROM w)
SELECT doc_id || '::' || (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1) AS chunk_id, length(t) AS n_chars, regexp_matches(t, '[\x{0590}-\x{05FF}\x{FB1D}-\x{FB4F}]') AS has_hebrew FROM c WHERE length(trim(t, ' ' || chr(9) || chr(10) || chr(13))) >= 30""")
def chunk_rows(spark, sf_dir):
    parts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(fn.windows(F.col("text"), least=30)).alias("n", "w"))
    return parts.select(F.concat_ws("::", F.col("doc_id").cast("string"), F.col("n").cast("string")).alias("chunk_id"), F.length("w.text").alias("n_chars"), F.col("w.text").rlike(fn.HEBREW).alias("has_hebrew"))


@query("txt10_model_routing", "SELECT doc_id, source = 'src1' OR (contains(lower(text), 'the')::INT + contains(lower(text), 'und')::INT + contains(lower(text), 'les ')::INT) >= 2 AS hierarchical FROM documents")
def model_routing(spark, sf_dir):
    kind = F.when(F.col("source") == "src1", "catalog").otherwise("text")
    return table(spark, sf_dir, "documents").select("doc_id", fn.is_hierarchical(kind, F.col("text"), ["the", "und", "les "]).alias("hierarchical"))


# -- upserts -----------------------------------------------------------------------------------------------------

@query("ups01_concept_fold", """SELECT user_id AS concept_id, arg_min(event_type, (ts, event_id)) AS name, max(value) AS confidence, count(*) AS frequency, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(event_type, (ts, event_id)) AS last_label FROM events GROUP BY user_id""")
def concept_fold(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("concept_id"), F.struct("ts", "event_id").alias("seq"), F.col("event_type").alias("name"), F.col("event_type").alias("last_label"), F.col("value").alias("confidence"), F.lit(1).cast("long").alias("frequency"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"))
    return folds.fold(e, ["concept_id"], first=["name"], last=["last_label"], highest=["confidence", "last_seen"], total=["frequency"], earliest=["first_seen"])


@query("ups02_term_fold", "SELECT p_name AS norm, count(*) AS frequency, min(p_partkey) AS first_part, arg_min(p_brand, p_partkey) AS surface FROM part GROUP BY p_name")
def term_fold(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("norm"), F.col("p_partkey").alias("seq"), F.col("p_partkey").alias("first_part"), F.col("p_brand").alias("surface"), F.lit(1).cast("long").alias("frequency"))
    return folds.fold(p, ["norm"], first=["surface"], total=["frequency"], earliest=["first_part"])


@query("ups03_relations_by_either_name", """WITH n AS (SELECT lower(s_name) AS k, s_suppkey AS concept_id FROM supplier UNION SELECT 'alt-' || s_suppkey, s_suppkey FROM supplier WHERE s_suppkey % 2 = 0),
m AS (SELECT o_orderkey, 'Alt-' || (o_orderkey % 50) AS name FROM orders)
SELECT m.o_orderkey, n.concept_id FROM m JOIN n ON lower(m.name) = n.k""")
def relations_by_either_name(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("ALT-"), F.col("s_suppkey"))).alias("alt_name"), F.col("s_suppkey").alias("concept_id"))
    said = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Alt-"), F.col("o_orderkey") % 50).alias("said"))
    return folds.by_either_name(said, names, "said").select("o_orderkey", "concept_id")


@query("ups10_candidate_classes", "SELECT DISTINCT p_type || '/' || p_brand AS concept_id, 0.6::DOUBLE AS confidence, true AS is_class FROM part WHERE p_type || '/' || p_brand NOT IN (SELECT p_type || '/' || p_brand FROM part WHERE p_partkey % 7 = 0)")
def candidate_classes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_type", "p_brand").alias("parent_id"))
    return folds.missing_parents(p, p.filter("p_partkey % 7 = 0").select(F.col("parent_id").alias("concept_id")).distinct())


@query("ups17_merge_non_empty", """WITH o AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 3 > 0), n AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE upper(c_name) END AS c_name, CASE WHEN c_custkey % 5 = 0 THEN 'NEW' END AS c_mktsegment FROM customer WHERE c_custkey % 4 > 0)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(CASE WHEN trim(n.c_name) <> '' THEN n.c_name END, o.c_name) AS c_name, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""")
def merge_non_empty(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = c.filter("c_custkey % 4 > 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, " ").otherwise(F.upper("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 5 == 0, "NEW").alias("c_mktsegment"))
    return folds.merge_non_empty(c.filter("c_custkey % 3 > 0"), new, "c_custkey", ["c_name", "c_mktsegment"])


@query("ups22_validated_edges", "SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'edge_type' WHEN NOT coalesce(value BETWEEN 0 AND 100, false) THEN 'confidence' END AS review_reason FROM events")
def validated_edges(spark, sf_dir):
    checks = {"edge_type": F.col("event_type").isin("view", "click", "purchase"), "confidence": F.col("value").between(0, 100)}
    return folds.validated(table(spark, sf_dir, "events"), checks).select("event_id", "review_reason")


# -- hierarchy ---------------------------------------------------------------------------------------------------

HIERARCHY = """h AS (SELECT 'SYS-' || p_partkey AS child_id, p_type || '/' || p_brand AS parent_id, 'INSTANCE_OF' AS relation FROM part UNION SELECT p_type || '/' || p_brand, p_type, 'SUBCLASS_OF' FROM part UNION SELECT p_type, 'PART', 'SUBCLASS_OF' FROM part
 UNION SELECT 'DEPT-' || s_suppkey, 'LOC-' || s_nationkey, 'PART_OF_HIERARCHY' FROM supplier UNION SELECT 'LOC-' || n_nationkey, 'REG-' || n_regionkey, 'PART_OF_HIERARCHY' FROM nation)"""
_CLOSED = f"""WITH RECURSIVE {HIERARCHY}, up(concept_id, ancestor_id, depth, path) AS (SELECT child_id, parent_id, 1, relation FROM h UNION SELECT concept_id, parent_id, depth + 1, path || '>' || relation FROM up JOIN h ON child_id = ancestor_id WHERE depth < 10),
c AS (SELECT concept_id, ancestor_id, min(depth) AS depth, arg_min(path, (depth, path)) AS relation_path FROM up GROUP BY ALL)"""


def hierarchy_edges(spark, sf_dir):
    p, s, n = (table(spark, sf_dir, t) for t in ("part", "supplier", "nation"))
    kind = F.concat_ws("/", "p_type", "p_brand")
    rows = [p.select(F.concat(F.lit("SYS-"), F.col("p_partkey")), kind, F.lit("INSTANCE_OF")), p.select(kind, "p_type", F.lit("SUBCLASS_OF")), p.select("p_type", F.lit("PART"), F.lit("SUBCLASS_OF")),
            s.select(F.concat(F.lit("DEPT-"), F.col("s_suppkey")), F.concat(F.lit("LOC-"), F.col("s_nationkey")), F.lit("PART_OF_HIERARCHY")), n.select(F.concat(F.lit("LOC-"), F.col("n_nationkey")), F.concat(F.lit("REG-"), F.col("n_regionkey")), F.lit("PART_OF_HIERARCHY"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.toDF("child_id", "parent_id", "relation").distinct()


@query("hie01_ancestors", _CLOSED + "SELECT concept_id, ancestor_id, depth, relation_path, list_extract(string_split(relation_path, '>'), -1) AS last_relation FROM c")
def ancestors(spark, sf_dir):
    return hierarchy.closure(hierarchy_edges(spark, sf_dir)).select("concept_id", "ancestor_id", "depth", "relation_path", "last_relation")


@query("hie02_children", f"WITH {HIERARCHY}, r AS (SELECT parent_id, child_id, CASE WHEN relation = 'SUBCLASS_OF' THEN 'subclass' ELSE 'instance' END AS kind, row_number() OVER (PARTITION BY parent_id ORDER BY child_id) AS position FROM h) SELECT * FROM r WHERE position <= 50")
def children(spark, sf_dir):
    return hierarchy.children(hierarchy_edges(spark, sf_dir))


@query("hie03_siblings", f"WITH {HIERARCHY}, s AS (SELECT DISTINCT a.child_id, b.child_id AS sibling_id FROM h a JOIN h b ON a.parent_id = b.parent_id AND a.child_id <> b.child_id), r AS (SELECT *, row_number() OVER (PARTITION BY child_id ORDER BY sibling_id) AS position FROM s) SELECT * FROM r WHERE position <= 20")
def siblings(spark, sf_dir):
    return hierarchy.siblings(hierarchy_edges(spark, sf_dir))


@query("hie06_inherited_context", _CLOSED + """, d AS (SELECT concept_id, depth, ancestor_id, 'About ' || ancestor_id || ' at depth' AS description FROM c), w AS (SELECT *, sum(len(string_split(description, ' '))) OVER (PARTITION BY concept_id ORDER BY depth, ancestor_id ROWS UNBOUNDED PRECEDING) AS words FROM d)
SELECT concept_id, string_agg(description, chr(10) ORDER BY depth, ancestor_id) AS context, max(words)::BIGINT AS words FROM w WHERE words <= 9 GROUP BY concept_id""")
def inherited_context(spark, sf_dir):
    edges = hierarchy_edges(spark, sf_dir)
    names = edges.select(F.col("parent_id").alias("concept_id")).distinct().withColumn("description", F.concat(F.lit("About "), F.col("concept_id"), F.lit(" at depth")))
    return hierarchy.inherited_context(hierarchy.closure(edges), names, 9)


@query("hie08_search_fields", _CLOSED + "SELECT concept_id, string_agg(ancestor_id, ',' ORDER BY depth, ancestor_id) AS ancestor_ids, max(depth) AS hierarchy_depth FROM c GROUP BY concept_id")
def search_fields(spark, sf_dir):
    return hierarchy.search_fields(hierarchy.closure(hierarchy_edges(spark, sf_dir))).withColumn("ancestor_ids", F.array_join("ancestor_ids", ","))


@query("hie10_class_search", _CLOSED + "SELECT concept_id, (split_part(concept_id, '-', 2)::BIGINT % 100) / 100.0::DOUBLE AS confidence FROM c WHERE ancestor_id = 'PART' AND concept_id LIKE 'SYS-%' AND split_part(concept_id, '-', 2)::BIGINT % 100 >= 50 ORDER BY confidence DESC, concept_id LIMIT 20")
def class_search(spark, sf_dir):
    found = hierarchy.closure(hierarchy_edges(spark, sf_dir)).filter("ancestor_id = 'PART' AND concept_id LIKE 'SYS-%'")
    return found.select("concept_id", F.expr("cast(substring(concept_id, 5) as bigint) % 100 / 100D").alias("confidence")).filter("confidence >= 0.5").orderBy(F.desc("confidence"), "concept_id").limit(20)


@query("ups12_cycle_guard", _CLOSED + """, k AS (SELECT parent_id AS child_id, child_id AS parent_id FROM h WHERE relation = 'SUBCLASS_OF' UNION ALL SELECT child_id, 'LOC-1' FROM h WHERE relation = 'INSTANCE_OF')
SELECT child_id, parent_id FROM k WHERE child_id <> parent_id AND NOT EXISTS (SELECT 1 FROM c WHERE c.concept_id = k.parent_id AND c.ancestor_id = k.child_id)""")
def cycle_guard(spark, sf_dir):
    h = hierarchy_edges(spark, sf_dir)
    k = h.filter("relation = 'SUBCLASS_OF'").select(F.col("parent_id").alias("child_id"), F.col("child_id").alias("parent_id")).union(h.filter("relation = 'INSTANCE_OF'").select("child_id", F.lit("LOC-1")))
    return hierarchy.without_cycles(k, h).select("child_id", "parent_id")


_BATCH = """WITH RECURSIVE c AS (SELECT o_custkey AS g, o_orderkey AS seq, o_orderkey % 5 AS a, (o_orderkey // 5 + o_custkey) % 5 AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
-- per customer: for each of its five nodes, a bitmap of those that it reaches
w(g, k, seq, a, b, taken, reach) AS (
 SELECT g, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, false, CASE WHEN g % 3 = 0 THEN [6, 4, 0, 0, 0]::BIGINT[] ELSE [0, 0, 0, 0, 0]::BIGINT[] END FROM (SELECT DISTINCT g FROM c)
 UNION ALL
 SELECT w.g, c.k, c.seq, c.a, c.b, c.a <> c.b AND (w.reach[c.b + 1] >> c.a::INT) & 1 = 0,
  CASE WHEN c.a <> c.b AND (w.reach[c.b + 1] >> c.a::INT) & 1 = 0 THEN [CASE WHEN x = c.a OR (w.reach[x + 1] >> c.a::INT) & 1 = 1 THEN w.reach[x + 1] | w.reach[c.b + 1] | (1::BIGINT << c.b::INT) ELSE w.reach[x + 1] END for x in range(5)] ELSE w.reach END
 FROM w JOIN c ON c.g = w.g AND c.k = w.k + 1)
SELECT 'N-' || g || '-' || a AS child_id, 'N-' || g || '-' || b AS parent_id, seq FROM w WHERE taken"""


@query("ups12_cycles_within_batch", _BATCH)
def cycles_within_batch(spark, sf_dir):
    """Five nodes for each customer, an edge for each of its orders, in the order of their keys; some have old edges."""
    name = lambda g, x: F.concat_ws("-", F.lit("N"), g, x)
    o = table(spark, sf_dir, "orders")
    g, key = F.col("o_custkey"), F.col("o_orderkey")
    batch = o.select(name(g, key % 5).alias("child_id"), name(g, (F.floor(key / 5) + g) % 5).alias("parent_id"), key.alias("seq"))
    old = o.filter(g % 3 == 0).select(g.alias("g")).distinct().select("g", F.explode(F.array(F.lit(0), F.lit(1))).alias("x"))
    return hierarchy.without_cycles(batch, old.select(name(F.col("g"), F.col("x")).alias("child_id"), name(F.col("g"), F.col("x") + 1).alias("parent_id")))


@query("evt07_replacements", """WITH RECURSIVE c AS (SELECT p_partkey AS id, p_partkey - 1 AS next_id FROM part WHERE p_partkey % 16 > 0),
w(id, last) AS (SELECT id, next_id FROM c UNION SELECT w.id, c.next_id FROM w JOIN c ON c.id = w.last) SELECT id, last AS final_id FROM w WHERE last NOT IN (SELECT id FROM c)""")
def replacements(spark, sf_dir):
    chain = table(spark, sf_dir, "part").filter("p_partkey % 16 > 0").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") - 1).alias("next_id"))
    return hierarchy.replacements(chain)


# -- lookup ------------------------------------------------------------------------------------------------------

@query("lkp05_related_concepts", """WITH r AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem), o AS (SELECT a AS id, b AS other, 'outbound' AS direction FROM r UNION SELECT b, a, 'inbound' FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY id, direction ORDER BY other) AS position FROM o) SELECT * FROM k WHERE position <= 20""")
def related_concepts(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    both = r.select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("other"), F.lit("outbound").alias("direction")).union(r.select("l_partkey", "l_suppkey", F.lit("inbound")))
    return both.withColumn("position", F.row_number().over(W.partitionBy("id", "direction").orderBy("other"))).filter("position <= 20")


@query("lkp01_terms_to_concepts", """WITH asked AS (SELECT DISTINCT 'Supplier#' || lpad((o_orderkey % 150)::VARCHAR, 9, '0') AS term FROM orders), k AS (SELECT lower(s_name) AS k, s_suppkey FROM supplier WHERE s_suppkey % 10 > 0)
SELECT term, s_suppkey IS NOT NULL AS found, s_suppkey AS concept_id FROM asked LEFT JOIN k ON lower(term) = k""")
def terms_to_concepts(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.concat(F.lit("Supplier#"), F.lpad((F.col("o_orderkey") % 150).cast("string"), 9, "0")).alias("term")).distinct()
    names = table(spark, sf_dir, "supplier").filter("s_suppkey % 10 > 0").select(F.lower("s_name").alias("k"), F.col("s_suppkey").alias("concept_id"))
    best = names.groupBy("k").agg(F.min("concept_id").alias("concept_id"))
    return asked.join(best, F.lower("term") == F.col("k"), "left").select("term", F.col("concept_id").isNotNull().alias("found"), "concept_id")


@query("lkp07_usage_counts", "SELECT user_id AS concept_id, count(*) AS usage_count, max(ts) AS last_used FROM events WHERE event_type = 'view' GROUP BY user_id")
def usage_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_type = 'view'").groupBy(F.col("user_id").alias("concept_id")).agg(F.count(F.lit(1)).alias("usage_count"), F.max("ts").alias("last_used"))


@query("lkp11_unmapped_concepts", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def unmapped_concepts(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return table(spark, sf_dir, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@query("lkp12_enrichment_budget", """WITH r AS (SELECT conv_id, turn, text, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations)
SELECT conv_id, count(*) AS entries, max(used)::BIGINT AS used FROM r WHERE used <= 4 * 150 AND k <= 20 GROUP BY conv_id""")
def enrichment_budget(spark, sf_dir):
    w = W.partitionBy("conv_id").orderBy("turn", "text")
    r = table(spark, sf_dir, "conversations").withColumns({"used": F.sum(F.length("text")).over(w.rowsBetween(W.unboundedPreceding, 0)), "k": F.row_number().over(w)})
    return r.filter("used <= 4 * 150 AND k <= 20").groupBy("conv_id").agg(F.count(F.lit(1)).alias("entries"), F.max("used").alias("used"))


@query("lkp13_clearance", "SELECT p_partkey, ['PUBLIC', 'INTERNAL', 'CONFIDENTIAL', 'SECRET'][p_size % 4 + 1] AS sensitivity FROM part WHERE p_size % 4 <= 1")
def clearance(spark, sf_dir):
    levels = F.array(*map(F.lit, ("PUBLIC", "INTERNAL", "CONFIDENTIAL", "SECRET")))
    p = table(spark, sf_dir, "part").withColumn("sensitivity", F.element_at(levels, F.col("p_size") % 4 + 1))
    return p.filter(F.array_position(levels, F.col("sensitivity")) <= F.array_position(levels, F.lit("INTERNAL"))).select("p_partkey", "sensitivity")


# -- resolution --------------------------------------------------------------------------------------------------

@query("res03_registry", "SELECT p_name AS norm, arg_max(p_brand, p_partkey) AS concept_id, min(p_partkey) AS reg_seq FROM part GROUP BY p_name")
def registry(spark, sf_dir):
    return resolve.registry(table(spark, sf_dir, "part").select(F.col("p_name").alias("norm"), F.col("p_brand").alias("concept_id"), F.col("p_partkey").alias("seq")))


@query("res02_resolve_names")
def resolve_names(spark, sf_dir):
    known = registry(spark, sf_dir)
    said = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.expr("substring(p_name, 2)")).otherwise(F.col("p_name")).alias("norm"))
    return resolve.resolve(said, known)


# -- search ------------------------------------------------------------------------------------------------------

_BM25 = r"""WITH q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), ' '), lambda x: length(x) >= 1))) AS term FROM benchmark),
t AS (SELECT doc_id AS id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), ' '), lambda x: length(x) >= 1) AS t FROM documents),
f AS (SELECT id, len(t) AS len, unnest(t) AS term FROM t), p AS (SELECT term, id, count(*) AS tf, any_value(len) AS len FROM f GROUP BY term, id),
s AS (SELECT count(*) AS n, avg(len) AS a FROM (SELECT id, any_value(len) AS len FROM p GROUP BY id)), d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
z AS (SELECT query_id, id, round(sum(round(1e9 * (4 * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a)))))::BIGINT) / 1e9, 6) AS score FROM q JOIN p USING (term) JOIN d USING (term), s GROUP BY query_id, id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM z)"""


@query("sea01_bm25", _BM25 + " SELECT query_id, id, round(score, 4) AS score FROM r WHERE rank <= 10")
def bm25(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.bm25(asked, docs, {"text": 4.0}).select("query_id", "id", F.round("score", 4).alias("score"))


@query("sea03_prefixes", "SELECT prefix, count(*) AS n FROM (SELECT unnest(list_transform(range(2, least(20, length(w)) + 1), lambda k: w[1:k])) AS prefix FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part)) GROUP BY prefix")
def prefixes(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w"))
    return words.select(F.explode(search.prefixes(F.col("w"))).alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))


_KNN = """n AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS score
 FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM n)"""


@query("sea04_exact_knn", f"WITH {_KNN} SELECT query_id, id, rank, score FROM k WHERE rank <= 10")
def exact_knn(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return search.knn(v.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), v, 10).select("query_id", "id", "rank", "score")


@query("sea04_candidate_knn")
def candidate_knn(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return search.candidate_knn(v.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), v, 10).select("query_id", "id", "rank", "score")


@query("sea05_hybrid_fusion", f"""WITH {_KNN}, l AS (SELECT a.vec_id AS query_id, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id) AS rank FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 50 = 0),
u AS (SELECT query_id, id, round(sum(1.0 / (20 + rank)), 6)::DOUBLE AS score FROM (SELECT query_id, id, rank FROM k WHERE rank <= 20 UNION ALL SELECT * FROM l WHERE rank <= 20) GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM u)
SELECT query_id, id, score FROM f WHERE rank <= 10""")
def hybrid_fusion(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    q = e.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "v", F.col("label").alias("asked"))
    near = search.knn(q.select("query_id", "v"), e.select("id", "v"), 20)
    # the second list: the first rows with the query's label, cut to 20 a label before the join
    of_label = e.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy("id"))).filter("rank <= 20").select("label", "id", "rank")
    by_label = q.select("query_id", F.col("asked").alias("label")).join(of_label, "label").select("query_id", "id", "rank")
    return search.fuse([near, by_label], 10).select("query_id", "id", "score")


@query("sea06_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderstatus IN ('O', 'F') AND o_orderpriority IN ('1-URGENT') AND o_totalprice >= 100000")
def filters(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "DEPRECATED").otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("concept_type"), F.array("o_orderstatus").alias("domain"), F.col("o_totalprice").alias("confidence"))
    return search.allowed(docs, ["1-URGENT"], ["O", "F"], ["O", "F"], 100000).select("o_orderkey")
