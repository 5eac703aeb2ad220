"""Pipeline messages as streams: envelope, retries, throughput, counters. Each function takes a streaming or a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ENVELOPE = "id string, key string, kind string, retry_count int, ts timestamp, payload map<string,string>, _corrupt string"
# Seconds before each retry, and retries before the dead letter.
DELAYS, MAX_RETRIES = (5, 30, 120), 3


def parse(raw: DataFrame, column: str = "value") -> DataFrame:
    """Envelope fields, with `bad` where the JSON or a required field is broken; nothing is dropped."""
    m = F.from_json(F.col(column).cast("string"), ENVELOPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = raw.select(F.col(column).alias("raw"), m.alias("m")).select("raw", "m.*")
    return out.withColumn("bad", F.col("_corrupt").isNotNull() | F.col("id").isNull() | F.col("ts").isNull())


def route(messages: DataFrame) -> DataFrame:
    """Failed messages with where they go: retry, one more count and a time before which they wait, or dead letter."""
    failed = messages.filter("kind = 'failed'")
    again = F.col("retry_count") < MAX_RETRIES
    delay = F.element_at(F.array(*map(F.lit, DELAYS)), F.least(F.col("retry_count"), F.lit(MAX_RETRIES - 1)) + 1)
    return failed.select(
        "id", "key", F.when(again, "retry").otherwise("dead_letter").alias("target"), F.when(again, F.col("retry_count") + 1).otherwise(F.col("retry_count")).alias("retry_count"),
        F.when(again, F.col("ts") + F.make_dt_interval(secs=delay)).alias("not_before"))


def dead_letters(messages: DataFrame) -> DataFrame:
    """Failed messages past their retries, with the error, topic and count added to the payload."""
    failed = messages.filter((F.col("kind") == "failed") & (F.col("retry_count") >= MAX_RETRIES))
    note = F.map_concat(F.coalesce("payload", F.create_map().cast("map<string,string>")), F.create_map(F.lit("_topic"), F.col("topic"), F.lit("_error"), F.col("error"), F.lit("_retries"), F.col("retry_count").cast("string")))
    return failed.select("id", "key", note.alias("payload"))


def out_of_order(messages: DataFrame) -> DataFrame:
    """Messages with their number within their key in time order, and whether they came after a later one (by seq)."""
    w = W.partitionBy("key")
    latest = F.max("ts").over(w.orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    return messages.withColumns({"number": F.row_number().over(w.orderBy("ts", "seq")), "late": F.coalesce(F.col("ts") < latest, F.lit(False))})


def throughput(messages: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    m = messages.withWatermark("ts", late) if messages.isStreaming else messages
    out = m.groupBy(F.window("ts", window).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "kind", "n")


def counters(messages: DataFrame) -> DataFrame:
    """Counts per key and kind; in update mode as a stream."""
    return messages.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n"))


def retained(messages: DataFrame, days: dict[str, int | None], now) -> DataFrame:
    """Messages within the days of their kind; kinds without a number stay for good."""
    limit = F.create_map(*[F.lit(x) for k, d in days.items() if d is not None for x in (k, d)])[F.col("kind")]
    return messages.filter(limit.isNull() | (F.col("ts") >= now - F.make_dt_interval(days=limit)))


def merge_once(stream: DataFrame, merge, checkpoint: str, trigger: dict | None = None):
    """Start a query that gives each micro-batch, without repeated ids, to merge(batch, batch_id). merge must be a keyed
    fold, so a batch that runs again after a failure changes nothing."""
    unique = stream.withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["id"])
    return unique.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
