"""Upserts as folds: existing rows and a batch, one row per key afterwards. All are associative, so batches and streams agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(rows: DataFrame, keys: list[str], first: list[str] = (), last: list[str] = (), highest: list[str] = (), total: list[str] = (), earliest: list[str] = (), seq: str = "seq") -> DataFrame:
    """One row per key: first-written and last-written fields (each with its row's others), largest, summed, smallest ones."""
    agg: list[Column] = []
    if first:
        agg.append(F.min(F.struct(seq, *first)).alias("_first"))
    if last:
        agg.append(F.max(F.struct(seq, *last)).alias("_last"))
    agg += [F.max(c).alias(c) for c in highest] + [F.sum(c).alias(c) for c in total] + [F.min(c).alias(c) for c in earliest]
    out = rows.groupBy(*keys).agg(*agg)
    return out.select(*keys, *[F.col(f"_first.{c}") for c in first], *[F.col(f"_last.{c}") for c in last], *highest, *total, *earliest)


def merge_non_empty(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """new values replace old ones only where they are neither null nor blank."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    value = lambda c: F.coalesce(F.when(F.trim(F.col(f"n.{c}").cast("string")) != "", F.col(f"n.{c}")), F.col(f"o.{c}")).alias(c)
    return j.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *[value(c) for c in columns])


def missing_parents(children: DataFrame, concepts: DataFrame) -> DataFrame:
    """Candidate classes for parents that no concept has."""
    return children.select(F.col("parent_id").alias("concept_id")).distinct().join(concepts.select("concept_id"), "concept_id", "left_anti").select("concept_id", F.lit(0.6).alias("confidence"), F.lit(True).alias("is_class"))


def by_either_name(left: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Join on name or alternative name: two equi-joins on one lookup, never an OR."""
    lookup = names.select(F.lower("name").alias("_k"), "concept_id").unionByName(names.filter("alt_name IS NOT NULL").select(F.lower("alt_name").alias("_k"), "concept_id")).distinct()
    return left.join(lookup, F.lower(column) == F.col("_k")).drop("_k")


def validated(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rows with review_reason: the first check that fails, else null. Nothing is dropped."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    return rows.withColumn("review_reason", reason)


def relations_by_name(said: DataFrame, concepts: DataFrame) -> DataFrame:
    """Relations whose ends are base names, exactly: src, dst, type, the highest confidence and the first quote.

    said: from_name, to_name, type, confidence, quote, seq; concepts: concept_id, name."""
    for end, out in (("from_name", "src"), ("to_name", "dst")):
        said = said.join(concepts.select(F.col("name").alias(end), F.col("concept_id").alias(out)), end)
    return fold(said, ["src", "dst", "type"], first=["quote"], highest=["confidence"])


def assets(said: DataFrame) -> DataFrame:
    """One row per qualified name: the first name and type, when it was first and last said. said: qualified_name, name, asset_type, seq."""
    return fold(said.withColumns({"created": F.col("seq"), "updated": F.col("seq")}), ["qualified_name"], first=["name", "asset_type"], highest=["updated"], earliest=["created"])


def asset_links(said: DataFrame, names: DataFrame) -> DataFrame:
    """MAPS_TO links of concepts, by either name, to assets: the first mapping type, confidence and notes stay.

    said: concept_name, qualified_name, mapping_type, confidence, notes, seq; names: concept_id, name, alt_name."""
    return fold(by_either_name(said, names, "concept_name"), ["concept_id", "qualified_name"], first=["mapping_type", "confidence", "notes"])


def mentions(extracted: DataFrame, ids: Column) -> DataFrame:
    """MENTIONS_CONCEPT links from the node whose text named further concepts. extracted: src, nodes (array of names)."""
    return extracted.select("src", F.explode("nodes").alias("name")).select("src", ids.alias("dst"), F.lit("MENTIONS_CONCEPT").alias("edge_type")).distinct()


def class_flags(rows: DataFrame) -> DataFrame:
    """concept_id with its last flags. rows: concept_id, is_class, is_deprecated, superseded_by, seq."""
    return fold(rows, ["concept_id"], last=["is_class", "is_deprecated", "superseded_by"])


DEPENDENCY_FIELDS = ["criticality", "propagation_mode", "mitigated", "recovery_hours"]


def dependency_edges(said: DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """(edges, rejected): per (src, dst, edge_type) the last attributes and the first condition, which is set once when the
    edge is made; rows whose type is not among `types` go to review. said: src, dst, edge_type, the fields, condition, seq."""
    known = F.coalesce(F.col("edge_type").isin(types), F.lit(False))
    edges = fold(said.filter(known), ["src", "dst", "edge_type"], first=["condition"], last=DEPENDENCY_FIELDS)
    return edges, said.filter(~known).withColumn("review_reason", F.lit("edge_type"))


def document_rows(chunks: DataFrame) -> DataFrame:
    """Provenance rows keyed `document::chunk`: the first title and connector, when first and last written.

    chunks: document_id, chunk, title, connector, seq."""
    keyed = chunks.withColumns({"doc_id": F.concat_ws("::", F.col("document_id").cast("string"), F.col("chunk").cast("string")), "created": F.col("seq"), "updated": F.col("seq")})
    return fold(keyed, ["doc_id"], first=["title", "connector"], highest=["updated"], earliest=["created"])
