"""Catalog and glossary snapshots: raw JSON of an entity to typed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TAGS = "array<struct<tagFQN:string>>"
TABLE = f"""id string, name string, fullyQualifiedName string, description string, tableType string, tags {_TAGS}, owner struct<name:string>, tier struct<tagFQN:string>,
 columns array<struct<name:string, dataType:string, description:string, tags:{_TAGS}, constraint:string>>"""
TERM = f"id string, name string, fullyQualifiedName string, description string, synonyms array<string>, relatedTerms array<struct<name:string>>, tags {_TAGS}"


def _names(values: Column, field: str) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<struct<" + field + ":string>>")), lambda t: t[field])


def catalog_tables(raw: DataFrame, column: str = "value") -> DataFrame:
    """One record per table: its attributes, tag names and columns. Rows without an id (or not JSON) have null fields."""
    t = raw.select(F.from_json(F.col(column), TABLE).alias("t")).select("t.*")
    fields = lambda c: F.struct(c["name"].alias("name"), c["dataType"].alias("data_type"), F.coalesce(c["description"], F.lit("")).alias("description"), _names(c["tags"], "tagFQN").alias("tags"), (~c["constraint"].eqNullSafe(F.lit("NOT_NULL"))).alias("is_nullable"))
    return t.select(
        "id", "name", F.col("fullyQualifiedName").alias("fqn"), F.coalesce("description", F.lit("")).alias("description"), F.col("tableType").alias("table_type"), _names(F.col("tags"), "tagFQN").alias("tags"),
        F.col("owner.name").alias("owner"), F.col("tier.tagFQN").alias("tier"), F.coalesce(F.transform("columns", fields), F.array()).alias("columns"))


def glossary_terms(raw: DataFrame, column: str = "value") -> DataFrame:
    """One record per glossary term: synonyms, names of related terms, tag names; missing lists are empty."""
    t = raw.select(F.from_json(F.col(column), TERM).alias("t")).select("t.*")
    return t.select(
        "id", "name", F.col("fullyQualifiedName").alias("fqn"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"),
        _names(F.col("relatedTerms"), "name").alias("related_terms"), _names(F.col("tags"), "tagFQN").alias("tags"))


def surface_forms(terms: DataFrame) -> DataFrame:
    """id, surface, form: the name as OFFICIAL and each other synonym once as ALIAS."""
    official = terms.select("id", F.col("name").alias("surface"), F.lit("OFFICIAL").alias("form"))
    alias = terms.select("id", "name", F.explode("synonyms").alias("surface")).filter("surface IS NOT NULL AND NOT surface <=> name").select("id", "surface", F.lit("ALIAS").alias("form")).distinct()
    return official.unionByName(alias)
