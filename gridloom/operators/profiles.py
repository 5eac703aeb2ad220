"""What is known of each concept: aliases, labels, statements, sources, parents, and table rows as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import display
from gridloom.operators import hierarchy


def aliases(terms: DataFrame) -> DataFrame:
    """concept_id, aliases: distinct surfaces in order that are not OFFICIAL. Input: concept_id, surface, form."""
    return terms.filter("form <> 'OFFICIAL'").groupBy("concept_id").agg(F.array_sort(F.collect_set("surface")).alias("aliases"))


def provenance(facts: DataFrame) -> DataFrame:
    """concept_id, first_source, n_sources, last_update. Input: concept_id, source, seq (orders facts), ts.

    Facts fold per source first, so a concept with many facts sends one row per source and task.
    """
    each = facts.groupBy("concept_id", "source").agg(F.min(F.struct("seq", "source")).alias("first"), F.max("ts").alias("last"))
    return each.groupBy("concept_id").agg(F.min("first")["source"].alias("first_source"), F.count("source").alias("n_sources"), F.max("last").alias("last_update"))


def statement_value(kind: Column, reference: Column, texts: Column, plain: Column) -> Column:
    """The value of a statement by its type: a concept's id, the text in the preferred language, or a plain string."""
    return F.when(kind == "concept_ref", reference).when(kind == "multilingual", texts).otherwise(plain)


def pairs_text(rows: DataFrame, key: str, name: str, value: str, out: str) -> DataFrame:
    """name=value of each row of a key, in order of names, joined by commas."""
    each = F.array_sort(F.collect_list(F.struct(name, value)))
    return rows.groupBy(key).agg(F.array_join(F.transform(each, lambda x: F.concat_ws("=", x[name], x[value].cast("string"))), ",").alias(out))


def direct_parent(edges: DataFrame) -> DataFrame:
    """child_id, parent_id: the smallest parent of each child."""
    return edges.groupBy("child_id").agg(F.min("parent_id").alias("parent_id"))


def hierarchy_records(edges: DataFrame) -> DataFrame:
    """One record per concept of the hierarchy: its parent, ancestors (nearest first), depth, numbers of children and siblings."""
    ids = edges.select(F.col("child_id").alias("concept_id")).union(edges.select("parent_id")).distinct()
    n_children = edges.groupBy(F.col("parent_id").alias("concept_id")).agg(F.count_distinct("child_id").alias("n_children"))
    # distinct siblings: per child, the others under its parents
    n_siblings = hierarchy.siblings(edges).groupBy(F.col("child_id").alias("concept_id")).agg(F.count(F.lit(1)).alias("n_siblings"))
    out = ids
    for part in (direct_parent(edges).withColumnRenamed("child_id", "concept_id"), hierarchy.search_fields(hierarchy.closure(edges)), n_children, n_siblings):
        out = out.join(part, "concept_id", "left")
    return out.na.fill(0, ["hierarchy_depth", "n_children", "n_siblings"])


def piped(cells: list[str]) -> Column:
    """A table's row as text: trimmed cells between bars, nulls as empty cells."""
    return F.array_join(F.array(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cells]), " | ")


def with_properties(concepts: DataFrame, given: DataFrame, defaults: dict) -> DataFrame:
    """concepts (name, ...) with the properties given by name in any case; defaults where there are none. given: name (unique in lower case), properties."""
    new = given.select(F.lower("name").alias("_key"), *defaults)
    return concepts.join(new, F.lower("name") == F.col("_key"), "left").drop("_key").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def full_records(edges: DataFrame, concepts: DataFrame, labels: DataFrame, statements: DataFrame, budget: int = 500) -> DataFrame:
    """All that the hierarchy tells of each concept: name, description, ancestors (nearest first, with the last relation),
    subclasses, instances, siblings, labels, statements, inherited context; lists are empty where there is nothing.

    concepts: concept_id, name, description; labels: concept_id, language, label; statements: concept_id, property, value."""
    up = hierarchy.closure(edges)
    named = up.join(concepts.select(F.col("concept_id").alias("ancestor_id"), F.col("name").alias("ancestor_name")), "ancestor_id", "left")
    in_order = lambda *cs: F.array_sort(F.collect_list(F.struct(*cs)))
    above = named.groupBy("concept_id").agg(F.transform(in_order("depth", "ancestor_id", "ancestor_name", "last_relation"), lambda x: F.struct(x["ancestor_id"].alias("concept_id"), x["ancestor_name"].alias("concept_name"), x["last_relation"].alias("relation"))).alias("ancestors"))
    below = hierarchy.children(edges).groupBy(F.col("parent_id").alias("concept_id")).agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("child_id")))).alias(c) for k, c in (("subclass", "subclasses"), ("instance", "instances"))])
    beside = hierarchy.siblings(edges).groupBy(F.col("child_id").alias("concept_id")).agg(F.array_sort(F.collect_list("sibling_id")).alias("siblings"))
    said = labels.groupBy("concept_id").agg(in_order("language", "label").alias("labels"))
    facts = statements.groupBy("concept_id").agg(in_order("property", "value").alias("statements"))
    context = hierarchy.inherited_context(up, concepts.select("concept_id", "description"), budget).select("concept_id", "context")
    out = concepts.select("concept_id", "name", "description")
    for part in (above, below, beside, said, facts, context):
        out = out.join(part, "concept_id", "left")
    empty = {c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("ancestors", "subclasses", "instances", "siblings", "labels", "statements")}
    return out.withColumns({**empty, "context": F.coalesce("context", F.lit(""))})


def lookup_answers(asked: DataFrame, surfaces: DataFrame, concepts: DataFrame, related: DataFrame, assets: DataFrame, sources: DataFrame) -> DataFrame:
    """One answer per asked term, found or not: concept, definition, aliases, related concepts, data assets, provenance and
    flags, with the defaults that a missing value has.

    asked: term; surfaces: concept_id, surface, form; concepts: concept_id, name, name_he, description, description_he,
    confidence, status; related, assets: concept_id, other (at most what is wanted of each); sources: as `provenance` gives."""
    known = surfaces.groupBy(F.lower("surface").alias("_key")).agg(F.min("concept_id").alias("concept_id"))
    list_of = lambda rows, out: rows.groupBy("concept_id").agg(F.array_sort(F.collect_set("other")).alias(out))
    out = asked.select("term").distinct().join(known, F.lower("term") == F.col("_key"), "left").drop("_key").join(concepts, "concept_id", "left")
    for part in (aliases(surfaces), list_of(related, "related"), list_of(assets, "data_assets"), sources):
        out = out.join(part, "concept_id", "left")
    listed = {c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("aliases", "related", "data_assets")}
    confidence = F.coalesce("confidence", F.lit(0.7))
    out = out.withColumns(listed)
    return out.select(
        "term", F.col("concept_id").isNotNull().alias("found"), "concept_id", display(F.col("name_he"), F.col("name")).alias("name"), display(F.col("description_he"), F.col("description")).alias("definition"),
        *listed, F.coalesce("first_source", F.when(F.col("concept_id").isNotNull(), F.lit("unknown"))).alias("primary_source"), F.coalesce("n_sources", F.lit(0)).alias("sources_count"), "last_update",
        F.when(F.col("concept_id").isNotNull(), confidence).alias("confidence"), F.when(F.col("concept_id").isNotNull(), F.coalesce("status", F.lit("CANDIDATE"))).alias("status"),
        (F.col("concept_id").isNotNull() & (confidence < 0.6)).alias("low_confidence"), F.lit(False).alias("degraded_mode"))
