"""Cutting lineage: tables in the folder that the session names, which survive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that are derived once a session: (application, name) -> path.
_STORED: dict[tuple[str, str], str] = {}
#: Where the tables that `cut` returned are.
_CUT: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: For each stored table that is just being derived, the paths of what is cut for it.
_DERIVING: list[list[str]] = []


def folder(spark: SparkSession) -> str:
    """The session's part of spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base.rstrip('/')}/gridloom-{spark.sparkContext.applicationId}"


@contextmanager
def swept(spark: SparkSession):
    """A query that runs inside takes its shuffle files away when it ends; else they stay until the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once, written as Parquet and read back. Its size on disk tells Spark whether to broadcast it."""
    path = f"{folder(df.sparkSession)}/core-{uuid.uuid4().hex}"
    with swept(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _CUT[out] = path
    for paths in _DERIVING:
        paths.append(path)
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables that `cut` returned, as soon as nothing reads them any more."""
    for df in tables:
        _delete(df.sparkSession, _CUT.pop(df))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def state(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the names, sizes and times of the files under the paths; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "length", "modificationTime")
    found = files.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("h")).first()
    return f"{found.n} {found.h}"


def stored(spark: SparkSession, name: str, inputs: list[str], derive) -> DataFrame:
    """The table that derive() makes of the inputs, kept for the session: later calls with the same name read what the first
    one wrote, as long as the files of the inputs are the same. What derive() cuts on the way does not stay."""
    key = (spark.sparkContext.applicationId, f"{name} {' '.join(inputs)} {state(spark, inputs)}")
    if key not in _STORED:
        path = f"{folder(spark)}/stored-{uuid.uuid4().hex}"
        _DERIVING.append(paths := [])
        try:
            with swept(spark):
                derive().write.parquet(path)
        finally:
            _DERIVING.pop()
        for cut_at in paths:
            _delete(spark, cut_at)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def clear(spark: SparkSession) -> None:
    """Remove all that this session's queries have written. No result that is not yet collected may be used after it."""
    _delete(spark, folder(spark))
    for key in [k for k in _STORED if k[0] == spark.sparkContext.applicationId]:
        del _STORED[key]
