"""The append-only event store: files partitioned by day, read as a table, or as a stream from the beginning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(events: DataFrame, path: str, time: str = "ts") -> None:
    """Add events, each with the whole snapshot of its entity; nothing that is there already is changed."""
    events.withColumn("day", F.to_date(time)).repartition("day", F.pmod(F.xxhash64("event_id"), F.lit(8))).write.mode("append").partitionBy("day").parquet(path)


def read(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """All events, or those of `since` and later days; older days are not opened."""
    out = spark.read.parquet(path)
    return out if since is None else out.filter(F.col("day") >= F.to_date(F.lit(since)))


def replay(spark: SparkSession, path: str, schema) -> DataFrame:
    """The store as a stream. A query with a new checkpoint begins with the first event; the store keeps all of them."""
    return spark.readStream.schema(schema).parquet(path)
