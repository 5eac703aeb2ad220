"""Metrics, history, sources and message queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import metrics
from gridloom.plans.registry import query
from gridloom.plans.views import NODES_SQL, nodes, table
from gridloom.sources import rows
from gridloom.streaming import messages


@query("agg01_graph_statistics", f"WITH {NODES_SQL} SELECT entity_type, status, count(*) AS n, count(*) FILTER ((key % 100) / 100.0 < 0.6) AS low_confidence FROM nodes GROUP BY GROUPING SETS ((entity_type), (status), ())")
def graph_statistics(spark, sf_dir):
    return metrics.graph_statistics(nodes(spark, sf_dir), (F.col("key") % 100) / 100.0)


@query("agg02_job_statistics", "SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 4)::DOUBLE AS progress FROM events GROUP BY user_id")
def job_statistics(spark, sf_dir):
    return metrics.job_statistics(table(spark, sf_dir, "events"), "user_id", F.col("event_type") == "error")


@query("agg04_consumer_lag", "SELECT l_returnflag AS topic, l_linestatus AS part, sum(e - c)::BIGINT AS lag FROM (SELECT l_returnflag, l_linestatus, max(l_orderkey) AS e, min(l_orderkey) AS c FROM lineitem GROUP BY ALL) GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def consumer_lag(spark, sf_dir):
    ends = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("topic"), F.col("l_linestatus").alias("part")).agg(F.max("l_orderkey").alias("end"), F.min("l_orderkey").alias("committed"))
    return metrics.consumer_lag(ends)


@query("agg07_burn_rate", """WITH n AS (SELECT ts::DATE AS day, count(*) AS n_new FROM events WHERE event_type = 'error' GROUP BY 1), d AS (SELECT ts::DATE AS day, count(*) AS n_done FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT coalesce(n.day, d.day) AS day, coalesce(n_new, 0) AS n_new, coalesce(n_done, 0) AS n_done, round(coalesce(n_done, 0) / nullif(coalesce(n_new, 0), 0), 6) AS burn_rate FROM n FULL JOIN d ON n.day = d.day""")
def burn_rate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type")
    return metrics.burn_rate(e.filter("event_type = 'error'"), e.filter("event_type = 'purchase'"))


@query("agg09_feedback_score", "SELECT user_id AS concept_id, ts::DATE AS day, count(*) FILTER (event_type = 'purchase') AS positive, count(*) FILTER (event_type = 'error') AS negative, round(count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type = 'error'), 0), 6) AS score FROM events GROUP BY ALL")
def feedback_score(spark, sf_dir):
    up, down = F.col("event_type") == "purchase", F.col("event_type") == "error"
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("concept_id"), F.to_date("ts").alias("day")).agg(F.count_if(up).alias("positive"), F.count_if(down).alias("negative"), F.round(metrics.rate(up, down), 6).alias("score"))


@query("agg10_review_queue", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ALL")
def review_queue(spark, sf_dir):
    return metrics.counts_by(table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderstatus": "status", "o_orderpriority": "priority"}), "status", "priority")


@query("agg11_extraction_quality", "WITH p AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 25), t AS (SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 150000), b AS (SELECT count(*) AS b FROM p JOIN t USING (k)) SELECT round(b / (SELECT count(*) FROM p), 6) AS precision, round(b / (SELECT count(*) FROM t), 6) AS recall FROM b")
def extraction_quality(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("k"))
    return metrics.precision_recall(p, table(spark, sf_dir, "orders").filter("o_totalprice > 150000").select(F.col("o_orderkey").alias("k")), ["k"])


@query("evt02_state_at", "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY user_id")
def state_at(spark, sf_dir):
    return metrics.state_at(table(spark, sf_dir, "events"), "user_id", "2024-01-15 00:00:00", ["ts", "event_id"], ["event_type"])


@query("evt03_unapplied", "SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = e.event_id AND o_orderstatus = 'O')")
def unapplied(spark, sf_dir):
    applied = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("event_id"))
    return metrics.unapplied(table(spark, sf_dir, "events").select("event_id"), applied, "event_id")


@query("evt04_change_log", """SELECT user_id, ts, event_id, event_type, lag(event_type) OVER w AS event_type_before, concat_ws(',', CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 'event_type' END) AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def change_log(spark, sf_dir):
    return metrics.changes(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type"])


@query("evt05_jobs_by_status", "SELECT o_orderpriority AS connector, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def jobs_by_status(spark, sf_dir):
    return metrics.counts_by(table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderpriority": "connector", "o_orderstatus": "status"}), "connector", "status")


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("key"), F.when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type")).alias("kind"), (F.get_json_object("props", "$.k").cast("int") % 5).alias("retry_count"), "ts")


@query("str02_retry_routing", """WITH m AS (SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS key, ((props->>'$.k')::INT % 5) AS r, ts FROM events WHERE event_type = 'error')
SELECT id, key, CASE WHEN r < 3 THEN 'retry' ELSE 'dead_letter' END AS target, CASE WHEN r < 3 THEN r + 1 ELSE r END AS retry_count, CASE WHEN r < 3 THEN ts + to_seconds([5, 30, 120][r + 1]) END AS not_before FROM m""")
def retry_routing(spark, sf_dir):
    return messages.route(_messages(spark, sf_dir))


@query("str05_throughput", "SELECT time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS window_start, CASE WHEN event_type = 'error' THEN 'failed' ELSE event_type END AS kind, count(*) AS n FROM events GROUP BY ALL")
def throughput(spark, sf_dir):
    return messages.throughput(_messages(spark, sf_dir))


@query("str06_counters", "SELECT user_id::VARCHAR AS key, CASE WHEN event_type = 'error' THEN 'failed' ELSE event_type END AS kind, count(*) AS n FROM events GROUP BY ALL")
def counters(spark, sf_dir):
    return messages.counters(_messages(spark, sf_dir))


@query("str09_retention", "WITH n AS (SELECT max(ts) AS now FROM events) SELECT event_id::VARCHAR AS id FROM events, n WHERE event_type NOT IN ('click', 'view') OR ts >= now - to_days(CASE event_type WHEN 'click' THEN 3 ELSE 7 END)")
def retention(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return messages.retained(m.crossJoin(F.broadcast(m.agg(F.max("ts").alias("now")))), {"click": 3, "view": 7, "signup": None}, F.col("now")).select("id")  # one row is broadcast


@query("src07_unseen_sources", "SELECT doc_id, md5(coalesce(text, '')) AS content_hash FROM documents WHERE (doc_id, md5(coalesce(text, ''))) NOT IN (SELECT doc_id, md5(coalesce(text, '')) FROM documents WHERE doc_id % 3 = 0)")
def unseen_sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content_hash"))
    return rows.unseen(d, d.filter("doc_id % 3 = 0"), ("doc_id", "content_hash"))


@query("src09_review_routing", "SELECT o_orderkey, concat_ws(',', CASE WHEN o_custkey % 7 = 0 THEN 'no site' END, CASE WHEN o_orderkey % 11 = 0 THEN 'no dependency' END) <> '' AS review_needed, nullif(concat_ws(',', CASE WHEN o_custkey % 7 = 0 THEN 'no site' END, CASE WHEN o_orderkey % 11 = 0 THEN 'no dependency' END), '') AS review_reason FROM orders")
def review_routing(spark, sf_dir):
    return rows.reviewed(table(spark, sf_dir, "orders"), {"no site": F.col("o_custkey") % 7 == 0, "no dependency": F.col("o_orderkey") % 11 == 0}).select("o_orderkey", "review_needed", "review_reason")


@query("src10_dependency_text", "SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END, 'nation ' || s_nationkey], lambda x: x <> ''), ' | ') AS text FROM supplier")
def dependency_text(spark, sf_dir):
    shaped = rows.shape(table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")).alias("a"), F.concat(F.lit("nation "), F.col("s_nationkey")).alias("b")), {"refs": ["a", "b"]})
    return shaped.select("s_suppkey", F.concat_ws(" | ", F.map_values("refs")).alias("text"))


@query("src13_schema_report", """WITH s AS (SELECT * FROM documents ORDER BY doc_id LIMIT 20), u AS (SELECT 'text' AS c, text AS v FROM s UNION ALL SELECT 'lang', lang FROM s UNION ALL SELECT 'source', source FROM s UNION ALL SELECT 'n_chars', n_chars::VARCHAR FROM s),
m AS (SELECT c, avg(length(v)) AS mean, avg((v IS NULL)::INT) > 0.5 AS sparse FROM u GROUP BY c), r AS (SELECT *, CASE WHEN c = 'source' THEN 'LOCATION_ID' WHEN contains(c, 'lang') OR contains(c, 'chars') THEN 'META' WHEN mean > 60 THEN 'FREE_TEXT' WHEN mean < 20 THEN 'META' END AS role FROM m)
SELECT c AS "column", coalesce(role, 'UNKNOWN') AS role, CASE WHEN c = 'source' THEN 0.98 WHEN role IS NOT NULL THEN 0.85 ELSE 0.4 END::DOUBLE AS confidence, sparse FROM r""")
def schema_report(spark, sf_dir):
    return rows.schema_report(table(spark, sf_dir, "documents"), {"source": "LOCATION_ID"}, {"lang": "META", "chars": "META"}, order="doc_id")


@query("src18_ingestion_summary", "SELECT source, count(*) AS total, count(*) FILTER (length(coalesce(text, '')) >= 200) AS committed, count(*) FILTER (length(coalesce(text, '')) < 200) AS review FROM documents GROUP BY ROLLUP (source)")
def ingestion_summary(spark, sf_dir):
    return metrics.ingestion_summary(table(spark, sf_dir, "documents"), "source", F.length(F.coalesce("text", F.lit(""))) >= 200)
