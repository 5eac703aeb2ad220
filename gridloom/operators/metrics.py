"""Statistics, quality metrics, event log and change history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def rate(part: Column, whole: Column) -> Column:
    """Share of rows, null where there are none."""
    return F.try_divide(F.count_if(part).cast("double"), F.count_if(whole))


def state_at(events: DataFrame, entity: str, at: str, order: list[str], payload: list[str]) -> DataFrame:
    """Last event of each entity at or before a time."""
    last = events.filter(F.col(order[0]) <= F.lit(at).cast("timestamp")).groupBy(entity).agg(F.max(F.struct(*order, *payload)).alias("x"))
    return last.select(entity, *[F.col(f"x.{c}") for c in [*order, *payload]])


def changes(events: DataFrame, entity: str, order: list[str], fields: list[str]) -> DataFrame:
    """Before and after of each event in the entity's time order, with the names of the fields that differ."""
    w = W.partitionBy(entity).orderBy(*order)
    out = events.select(entity, *order, *fields, *[F.lag(c).over(w).alias(f"{c}_before") for c in fields])
    differ = F.concat_ws(",", *[F.when(~F.col(c).eqNullSafe(F.col(f"{c}_before")), F.lit(c)) for c in fields])
    return out.withColumn("changed", differ)


def burn_rate(new: DataFrame, done: DataFrame) -> DataFrame:
    """Per day: new, resolved, and resolved per new. Inputs have a column day."""
    n, d = (x.groupBy("day").agg(F.count(F.lit(1)).alias(c)) for x, c in ((new, "n_new"), (done, "n_done")))
    return n.join(d, "day", "full").na.fill(0, ["n_new", "n_done"]).withColumn("burn_rate", F.round(F.try_divide(F.col("n_done").cast("double"), F.col("n_new")), 6))


def precision_recall(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    p, t = predicted.select(*keys).distinct().withColumn("p", F.lit(True)), truth.select(*keys).distinct().withColumn("t", F.lit(True))
    j = p.join(t, keys, "full")
    both = F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull())
    return j.agg(F.round(F.try_divide(both.cast("double"), F.count("p")), 6).alias("precision"), F.round(F.try_divide(both.cast("double"), F.count("t")), 6).alias("recall"))


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows per combination of keys: a review queue by status and priority, jobs by connector and status."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def graph_statistics(nodes: DataFrame, confidence: Column, low: float = 0.6) -> DataFrame:
    """Nodes, and those of low confidence, by entity type, by status, and in all."""
    rows = nodes.select("entity_type", "status", confidence.alias("confidence"))
    return rows.groupingSets([[F.col("entity_type")], [F.col("status")], []], "entity_type", "status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") < low).alias("low_confidence"))


def job_statistics(items: DataFrame, job: str, failed: Column) -> DataFrame:
    """Per job: items, failed ones, and progress as the percentage of the others."""
    return items.groupBy(job).agg(F.count(F.lit(1)).alias("total"), F.count_if(failed).alias("failed"), F.round(100.0 * F.count_if(~failed) / F.count(F.lit(1)), 4).alias("progress"))


def stage_health(messages: DataFrame, stage: str, time: str, dead: Column) -> DataFrame:
    """Per stage: messages, dead ones, messages a minute, and DOWN, DEGRADED or HEALTHY with over a half, over a tenth or less dead."""
    minutes = (F.unix_timestamp(F.date_trunc("minute", F.max(time))) - F.unix_timestamp(F.date_trunc("minute", F.min(time)))) / 60
    s = messages.groupBy(F.col(stage).alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.count_if(dead).alias("dead"), F.greatest(F.lit(1.0), minutes).alias("minutes"))
    status = F.when(F.col("dead") > 0.5 * F.col("n"), "DOWN").when(F.col("dead") > 0.1 * F.col("n"), "DEGRADED").otherwise("HEALTHY")
    return s.select("stage", "n", "dead", F.round(F.col("n") / F.col("minutes"), 6).alias("per_minute"), status.alias("status"))


def consumer_lag(offsets: DataFrame) -> DataFrame:
    """Messages behind per topic and part, per topic, and in all. offsets: topic, part, end, committed."""
    return offsets.select("topic", "part", (F.col("end") - F.col("committed")).alias("lag")).rollup("topic", "part").agg(F.sum("lag").alias("lag"))


def match_rate(rows: DataFrame, known: DataFrame, key: str, by: str) -> DataFrame:
    """Share of the rows of each group whose key is known. Keys of known are distinct."""
    hits = rows.select(key, by).join(known.select(key).withColumn("hit", F.lit(1)), key, "left")
    return hits.groupBy(by).agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("match_rate"))


def judge_score(rows: DataFrame, by: str, weights: dict[str, float]) -> DataFrame:
    """Mean weighted score per group."""
    return rows.groupBy(by).agg(F.round(F.avg(sum((w * F.col(c) for c, w in weights.items()), F.lit(0.0))), 6).alias("score"))


def unapplied(events: DataFrame, applied: DataFrame, key: str) -> DataFrame:
    """Events that have not been applied."""
    return events.join(applied.select(key), key, "left_anti")


def ingestion_summary(rows: DataFrame, source: str, committed: Column) -> DataFrame:
    """Rows, committed ones and those for review, per source and in all."""
    return rows.rollup(source).agg(F.count(F.lit(1)).alias("total"), F.count_if(committed).alias("committed"), F.count_if(~committed).alias("review"))


def ingestion_result(rows: DataFrame, by: str, name: str) -> DataFrame:
    """Per source: total, committed and review rows, matched, new and ambiguous ones, and what is written: a node for each new
    name and an edge for each committed row. rows: with the outcome of their resolution; ambiguous ones go to review."""
    of = lambda c: F.count_if(c)
    kind = F.col("outcome")
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), of(kind != "ambiguous").alias("committed"), of(kind == "ambiguous").alias("review"), of(kind == "matched").alias("matched"), of(kind == "new").alias("new"),
        of(kind == "ambiguous").alias("ambiguous"), F.count_distinct(F.when(kind == "new", F.col(name))).alias("new_nodes"), of(kind != "ambiguous").alias("new_edges"))
