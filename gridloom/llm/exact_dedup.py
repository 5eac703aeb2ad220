"""Exact dedup over a persistent digest index.

The index is a table in the warehouse, bucketed and sorted by digest, with one row per distinct normalised text.
New data are digested, reduced to one row per digest, deduplicated by a sort-merge anti-join against the index
(whose side needs no shuffle; each task merges the sorted files of its bucket) and appended.

Defined results: a null text counts as the empty text; texts are equal when identical after each run of the six
ASCII white-space characters is one space; among equal texts the smallest id stays, and a null id counts as larger
than any other (a group with null ids only has the id null). Repeated rows are members of their group like any
other. An empty input gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.shared import cut, join_unique

WHITE = r"[\x20\x09-\x0D]+"


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text with each run of white space made one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ").cast("binary"), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("text_sha256"))


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest; partial aggregation leaves one row per digest and task before the shuffle."""
    return rows.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


class DigestIndex:
    """The persistent index: table `name` with columns text_sha256, keep_id, batch.

    `buckets` should follow the expected index size (about 10 million digests a bucket). A batch is appended as one
    sorted file a bucket. Each digest carries the batch which brought it, and a batch never meets its own digests: one
    that was lost after its append gives the same answer when it runs again, and appends nothing twice.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = 32):
        self.spark, self.name, self.buckets = spark, name, buckets
        if not spark.catalog.tableExists(name):
            self.append(spark.createDataFrame([], "text_sha256 string, keep_id long, batch string"))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def append(self, groups: DataFrame) -> None:
        rows = groups.select("text_sha256", "keep_id", "batch").repartition(self.buckets, "text_sha256")
        rows.write.bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").mode("append").format("parquet").saveAsTable(self.name)

    def unseen(self, groups: DataFrame, batch: str) -> DataFrame:
        """The groups whose digest no earlier batch brought: sort-merge anti-join, the index side is not shuffled."""
        earlier = self.read().filter(F.col("batch") != batch).select("text_sha256")
        return groups.join(earlier.hint("merge"), "text_sha256", "left_anti")

    def add_groups(self, groups: DataFrame, batch: str) -> DataFrame:
        """Put a batch's groups (text_sha256, keep_id, group_size) into the index; returns them as text_sha256,
        keep_id, group_size, fresh: keep_id is the earlier batch's for a text that the index had already."""
        fresh = cut(self.unseen(groups, batch), "digest-fresh")
        earlier = self.read().filter(F.col("batch") != batch).select("text_sha256", F.col("keep_id").alias("first_id"))
        known = groups.join(earlier.hint("merge"), "text_sha256").select("text_sha256", F.col("first_id").alias("keep_id"), "group_size", F.lit(False).alias("fresh"))
        known = cut(known, "digest-known")
        if self.read().filter(F.col("batch") == batch).isEmpty():
            self.append(fresh.withColumn("batch", F.lit(batch)))
        return fresh.withColumn("fresh", F.lit(True)).unionByName(known)

    def add(self, docs: DataFrame, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Put docs into the index and return one row per document: doc_id, keep_id, group_size, kept, text_sha256.

        keep_id is the document that represents the text: of an earlier batch where the index has the text
        already, else the smallest of this batch. kept is true for rows that are new to the index and represent
        their text. group_size counts the rows of this batch with the text.
        """
        rows = cut(digests(docs, id_col, text_col), "digests")
        unique = self.add_groups(cut(grouped(rows), "digest-groups"), batch or uuid.uuid4().hex)
        return _marked(rows, unique)


def _marked(rows: DataFrame, unique: DataFrame) -> DataFrame:
    out = join_unique(rows, unique, ["text_sha256"], "group_size", rows.count())
    return out.select("doc_id", "keep_id", "group_size", (F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")


def dedup(docs: DataFrame, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The whole of docs through a new index that is dropped at the end, in batches of rising ids: columns as of
    `DigestIndex.add`, with group_size over all batches. The smallest id of a text is in the first batch that has it;
    null ids come last."""
    rows = cut(digests(docs, id_col, text_col), "digests")
    at = [k / batches for k in range(1, batches)]
    borders = rows.agg(F.percentile_approx("doc_id", at, 1000).alias("x")).first().x if at else []  # one number a batch
    number = F.lit(0)
    for b in borders or []:
        number = number + F.coalesce((F.col("doc_id") > b).cast("int"), F.lit(1))
    parts = cut(rows.withColumn("batch", number).groupBy("batch", "text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "digest-groups")
    index = DigestIndex(docs.sparkSession, f"digest_index_{uuid.uuid4().hex}")
    try:
        seen = [index.add_groups(parts.filter(F.col("batch") == k).drop("batch"), str(k)) for k in range(batches)]
    finally:
        index.drop()
    each = reduce(DataFrame.unionByName, seen).groupBy("text_sha256").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.lit(True).alias("fresh"))
    return _marked(rows, cut(each, "digest-sizes"))
