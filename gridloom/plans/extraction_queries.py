"""Extraction records, index terms and mitigations of the worst hit over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import extraction, grounding, impact, metrics, resolve, search
from gridloom.plans.impact_queries import _ALL_LOC, _OPTIONS, _TIERS, VIEWS, _of, _reach
from gridloom.plans.registry import query
from gridloom.plans.views import edges, links, nodes, table


def _extractions(spark, sf_dir):
    """Orders as extraction records: two concepts, the second without a name in every third; a relation in every second."""
    key = F.col("o_orderkey")
    first = F.struct(F.col("o_orderpriority").alias("name"), F.lit(None).cast("string").alias("canonical_name"), F.array(F.lit("orders")).alias("domain"), (key % 10 / 8.0).alias("confidence"))
    second = F.struct(F.lit(None).cast("string").alias("name"), F.when(key % 3 > 0, F.concat(F.lit("status "), F.col("o_orderstatus"))).alias("canonical_name"), F.array().cast("array<string>").alias("domain"), F.lit(0.5).alias("confidence"))
    link = F.array(F.struct(F.col("o_orderpriority").alias("src"), F.col("o_orderstatus").alias("dst"), F.lit("depends on").alias("type")))
    body = F.to_json(F.struct(F.array(first, second).alias("concepts"), F.when(key % 2 == 0, link).alias("relationships")))
    raw = table(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 11 == 0, "{broken").otherwise(body).alias("value"))
    return extraction.parsed(raw, "o_orderkey")


@query("ups18_extraction_counts", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 0 WHEN o_orderkey % 3 > 0 THEN 2 ELSE 1 END AS n_concepts, CASE WHEN o_orderkey % 11 > 0 AND o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS n_relations, 0 AS n_mappings FROM orders")
def extraction_counts(spark, sf_dir):
    return extraction.counts(_extractions(spark, sf_dir), "o_orderkey")


@query("fn13_reviewed_concepts", """WITH c AS (SELECT o_orderkey, o_orderpriority AS name, 'orders' AS domain, o_orderkey % 10 / 8.0 > 1 AS review_needed FROM orders WHERE o_orderkey % 11 > 0
 UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 'status ' || o_orderstatus END, 'General', o_orderkey % 3 = 0 FROM orders WHERE o_orderkey % 11 > 0) SELECT * FROM c""")
def reviewed_concepts(spark, sf_dir):
    return extraction.concepts(_extractions(spark, sf_dir), "o_orderkey").select("o_orderkey", "name", F.array_join("domain", ",").alias("domain"), "review_needed")


@query("ups15_extracted_relations", "SELECT o_orderpriority AS src, o_orderstatus AS dst, 'DEPENDS_ON' AS type, count(*) AS n FROM orders WHERE o_orderkey % 11 > 0 AND o_orderkey % 2 = 0 GROUP BY ALL")
def extracted_relations(spark, sf_dir):
    return extraction.relations(_extractions(spark, sf_dir), "o_orderkey").groupBy("src", "dst", "type").agg(F.count(F.lit(1)).alias("n"))


@query("sea02_index_terms", r"""WITH t AS (SELECT doc_id, unnest(list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), ' '), lambda x: length(x) >= 1)) AS term FROM documents)
SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS n_docs FROM t GROUP BY term""")
def index_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.index_terms(docs, ["text"])


@query("gra17_mitigations_of_worst", _reach(_ALL_LOC, 5, True) + _TIERS + _OPTIONS.removeprefix(VIEWS) + """, five AS (SELECT origin, node, row_number() OVER (PARTITION BY origin ORDER BY (tier <> 'CRITICAL')::INT, hop, node) AS position FROM tiers WHERE tier IN ('CRITICAL', 'HIGH') QUALIFY position <= 5)
SELECT origin, node, position, option_type, source, recovery_hours, confidence FROM five JOIN o USING (node)""")
def mitigations_of_worst(spark, sf_dir):
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    return impact.first_mitigations(impact.propagate(_of(n, "LOCATION"), n, links(spark, sf_dir), 5, ways=False), n, e)


_NAMES = "SELECT DISTINCT lower(p_name) AS name FROM part UNION SELECT DISTINCT lower(p_type) FROM part"
_REPORTS = """r AS (SELECT conv_id || '/' || turn AS report, text || ' [' || p.p_name || '] and ' || upper(q.p_name) || ', ' || lower(p.p_type) || ' or ' || q.p_type || 'x; ' || q.p_type AS text, p.p_name AS held_a, p.p_type AS held_b, conv_id
 FROM conversations JOIN part p ON p.p_partkey = conv_id % 100 JOIN part q ON q.p_partkey = (conv_id + 7 * turn + 1) % 100)"""


@query("gra31_stripped_reports", f"""WITH {_REPORTS}, n AS ({_NAMES}), p AS (SELECT '(?i)\\b(' || string_agg(name, '|' ORDER BY length(name) DESC, name) || ')\\b' AS pattern FROM n),
m AS (SELECT report, text, held_a, held_b, conv_id, regexp_split_to_array(text, pattern) AS between_, regexp_extract_all(text, pattern) AS found FROM r, p),
x AS (SELECT report, i, between_[i] AS piece, lower(found[i]) AS name, found[i] AS said, lower(found[i]) = lower(held_a) OR (conv_id % 2 = 0 AND lower(found[i]) = lower(held_b)) AS held FROM m, unnest(range(1, len(between_) + 1)) u(i))
SELECT report, string_agg(piece || CASE WHEN held THEN said ELSE '' END, '' ORDER BY i) AS text, count(name) AS n_mentions, coalesce(string_agg(CASE WHEN NOT held THEN name END, ',' ORDER BY i), '') AS ungrounded FROM x GROUP BY report""")
def stripped_reports(spark, sf_dir):
    """Turns of conversations as reports that name two parts and their types; a report's result holds one part, in every
    other conversation with its type."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    c = table(spark, sf_dir, "conversations").withColumns({"a": F.col("conv_id") % 100, "b": (F.col("conv_id") + 7 * F.col("turn") + 1) % 100})
    p, q = (part.select(*[F.col(x).alias(f"{k}_{x[2:]}") for x in part.columns]) for k in ("p", "q"))
    r = c.join(p, F.col("a") == F.col("p_partkey")).join(q, F.col("b") == F.col("q_partkey")).withColumn("report", F.concat_ws("/", "conv_id", "turn"))
    said = F.concat("text", F.lit(" ["), F.col("p_name"), F.lit("] and "), F.upper("q_name"), F.lit(", "), F.lower("p_type"), F.lit(" or "), F.col("q_type"), F.lit("x; "), F.col("q_type"))
    held = F.explode(F.when(F.col("conv_id") % 2 == 0, F.array("p_name", "p_type")).otherwise(F.array("p_name")))
    names = part.select(F.explode(F.array("p_name", "p_type")).alias("name")).distinct()
    out = grounding.stripped(r.select("report", said.alias("text")), names, r.select("report", held.alias("name")))
    return out.withColumn("ungrounded", F.array_join("ungrounded", ","))


def _fanned_out(spark, sf_dir):
    """Orders as extraction records with two concepts and their terms, relations and mappings."""
    key = F.col("o_orderkey")
    term = lambda *parts: F.concat_ws(" ", *parts)
    first = F.struct(F.col("o_orderpriority").alias("name"), F.array(term(F.lit("prio"), F.col("o_orderpriority")), F.col("o_orderpriority")).alias("terms"), (key % 10 / 8.0).alias("confidence"))
    second = F.struct(F.when(key % 3 > 0, F.concat(F.lit("status "), F.col("o_orderstatus"))).alias("name"), F.array().cast("array<string>").alias("terms"), F.lit(0.5).alias("confidence"))
    link = F.array(F.struct(F.col("o_orderpriority").alias("src"), F.col("o_orderstatus").alias("dst"), F.lit("depends on").alias("type"), F.lit(0.75).alias("confidence")))
    mapping = F.array(F.struct(F.col("o_orderpriority").alias("concept"), F.concat(F.lit("dw.sales.t"), key % 5).alias("qualified_name")))
    body = F.to_json(F.struct(F.array(first, second).alias("concepts"), F.when(key % 2 == 0, link).alias("relationships"), F.when(key % 4 == 1, mapping).alias("data_mappings")))
    raw = table(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 11 == 0, "{broken").otherwise(body).alias("value"))
    return extraction.fan_out(raw, "o_orderkey")


_LIVE = "orders WHERE o_orderkey % 11 > 0"


@query("ups18_concepts", f"""SELECT o_orderkey, o_orderpriority AS name, o_orderkey % 10 / 8.0::DOUBLE AS confidence FROM {_LIVE}
 UNION ALL SELECT o_orderkey, 'status ' || o_orderstatus, 0.5 FROM {_LIVE} AND o_orderkey % 3 > 0""")
def extracted_concepts(spark, sf_dir):
    return _fanned_out(spark, sf_dir)[0]["concepts"].select("o_orderkey", "name", "confidence")


@query("ups18_terms", f"""WITH t AS (SELECT o_orderkey, o_orderpriority AS concept, unnest([o_orderpriority, 'prio ' || o_orderpriority]) AS surface_form FROM {_LIVE}
 UNION ALL SELECT o_orderkey, 'status ' || o_orderstatus, 'status ' || o_orderstatus FROM {_LIVE} AND o_orderkey % 3 > 0) SELECT *, surface_form = concept AS official FROM t""")
def extracted_terms(spark, sf_dir):
    return _fanned_out(spark, sf_dir)[0]["terms"].select("o_orderkey", "concept", "surface_form", "official")


@query("ups18_mappings", f"SELECT o_orderkey, o_orderpriority AS concept, 'dw.sales.t' || (o_orderkey % 5) AS qualified_name, 't' || (o_orderkey % 5) AS asset_name FROM {_LIVE} AND o_orderkey % 4 = 1")
def extracted_mappings(spark, sf_dir):
    return _fanned_out(spark, sf_dir)[0]["mappings"].select("o_orderkey", "concept", "qualified_name", "asset_name")


@query("ups18_relations", f"SELECT o_orderkey, o_orderpriority AS src, o_orderstatus AS dst, 'DEPENDS_ON' AS type, 0.75::DOUBLE AS confidence FROM {_LIVE} AND o_orderkey % 2 = 0")
def extracted_relation_rows(spark, sf_dir):
    return _fanned_out(spark, sf_dir)[0]["relations"].select("o_orderkey", "src", "dst", "type", "confidence")


@query("ups18_counters", f"""SELECT 'records' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'broken', count(*) FROM orders WHERE o_orderkey % 11 = 0
 UNION ALL SELECT 'concepts', sum(CASE WHEN o_orderkey % 3 > 0 THEN 2 ELSE 1 END)::BIGINT FROM {_LIVE} UNION ALL SELECT 'terms', sum(CASE WHEN o_orderkey % 3 > 0 THEN 3 ELSE 2 END)::BIGINT FROM {_LIVE}
 UNION ALL SELECT 'relations', count(*) FROM {_LIVE} AND o_orderkey % 2 = 0 UNION ALL SELECT 'mappings', count(*) FROM {_LIVE} AND o_orderkey % 4 = 1""")
def extraction_counters(spark, sf_dir):
    counters = _fanned_out(spark, sf_dir)[1]
    return spark.createDataFrame(sorted(counters.items()), "kind string, n long")


_SAID = "m AS (SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 THEN 'no such part' ELSE p_name END AS norm FROM documents JOIN part ON p_partkey = doc_id % 97)"
_KNOWN = "k AS (SELECT p_name AS norm, count(DISTINCT p_brand) AS n FROM part WHERE p_partkey % 20 = 0 GROUP BY p_name)"
_OUTCOMES = f"WITH {_SAID}, {_KNOWN}, o AS (SELECT doc_id, source, coalesce(n, 0) AS n_candidates, CASE WHEN n IS NULL THEN 'new' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS outcome FROM m LEFT JOIN k USING (norm))"


def _outcomes(spark, sf_dir):
    """Documents that mention a part by name, against one part in twenty as registry, whose names repeat."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    said = d.join(part, F.col("p_partkey") == F.col("doc_id") % 97).select(F.col("doc_id").alias("id"), "source", F.when(F.col("doc_id") % 5 == 0, "no such part").otherwise(F.col("p_name")).alias("norm"))
    known = part.filter("p_partkey % 20 = 0").select(F.col("p_name").alias("norm"), F.col("p_brand").alias("concept_id"))
    return said, resolve.outcomes(said.select("id", "norm"), known, threshold=None)


@query("res06_outcomes", _OUTCOMES + "SELECT doc_id AS id, n_candidates, outcome FROM o")
def resolution_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir)[1].select("id", "n_candidates", "outcome")


@query("src18_ingestion_result", _OUTCOMES + """SELECT source, count(*) AS total, count(*) FILTER (outcome <> 'ambiguous') AS committed, count(*) FILTER (outcome = 'ambiguous') AS review, count(*) FILTER (outcome = 'matched') AS matched, count(*) FILTER (outcome = 'new') AS new,
 count(*) FILTER (outcome = 'ambiguous') AS ambiguous, count(DISTINCT norm) FILTER (outcome = 'new') AS new_nodes, count(*) FILTER (outcome <> 'ambiguous') AS new_edges FROM o JOIN m USING (doc_id, source) GROUP BY source""")
def ingestion_result(spark, sf_dir):
    said, found = _outcomes(spark, sf_dir)
    return metrics.ingestion_result(said.join(found.select("id", "outcome"), "id"), "source", "norm")
