"""Helpers that the operators of this subpackage have in common.

Rows of all operators: the input needs the named id and text columns only; any other column, whatever its
name, is left out before the work starts, so no name can clash. Ids may be null or repeated.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds more than this share of all rows is hot; there are fewer than 1 / HOT_SHARE such keys.
HOT_SHARE = 0.001


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base.rstrip('/')}/gridloom-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and no later job computes it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def two_hashes(value: Column) -> tuple[Column, Column]:
    """128 bits of hash in two bigint columns; cheaper to shuffle and sort than a hex digest."""
    return F.xxhash64(value), F.xxhash64(F.lit(0x5BD1E995), value, F.length(value))


def join_unique(rows: DataFrame, unique: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """Join rows to a table with one row per key, where any share of the rows may have the same key.

    `size` is the column of `unique` that tells how many of the `total` rows have its key. Keys with more than
    HOT_SHARE of all rows number fewer than 1 / HOT_SHARE whatever the input's size, so that part of `unique` is
    broadcast; the other keys are joined by a shuffle in which no key has more than that share.
    """
    at_least = max(1.0, total * HOT_SHARE)
    hot = unique.filter(F.col(size) > at_least)
    cold = unique.filter(F.col(size) <= at_least)
    found_hot = rows.join(F.broadcast(hot), keys, "inner")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return found_hot.unionByName(rest.join(cold, keys, how), allowMissingColumns=True)
