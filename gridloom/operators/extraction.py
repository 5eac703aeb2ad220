"""Extraction records: one nested JSON per chunk to tables of concepts, relations and mappings, with counts per kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gridloom.operators import records
from gridloom.plans.lineage import cut

_CONCEPT = "struct<name:string, name_he:string, canonical_name:string, description:string, description_he:string, terms:array<string>, domain:array<string>, confidence:double>"
RECORD = f"concepts array<{_CONCEPT}>, relationships array<struct<src:string, dst:string, type:string, confidence:double>>, data_mappings array<struct<concept:string, qualified_name:string>>"


def parsed(raw: DataFrame, id_col: str, column: str = "value") -> DataFrame:
    """id_col, concepts, relationships, data_mappings; a missing list, or one of a record that is not JSON, is empty."""
    x = raw.select(id_col, F.from_json(F.col(column), RECORD).alias("x")).select(id_col, "x.*")
    lists = dict(f.split(" ", 1) for f in RECORD.split(", ") if " array<" in f)
    return x.withColumns({c: F.coalesce(c, F.array().cast(x.schema[c].dataType)) for c in lists})


def counts(extractions: DataFrame, id_col: str) -> DataFrame:
    """Per chunk: concepts with a name, relations, mappings."""
    filled = lambda c: F.when(F.trim(c) != "", c)
    named = F.filter("concepts", lambda c: F.coalesce(filled(c["name"]), filled(c["name_he"]), filled(c["canonical_name"]), F.get(c["terms"], F.lit(0))).isNotNull())
    return extractions.select(id_col, F.size(named).alias("n_concepts"), F.size("relationships").alias("n_relations"), F.size("data_mappings").alias("n_mappings"))


def concepts(extractions: DataFrame, id_col: str) -> DataFrame:
    """One row per extracted concept with names, terms and domain filled; review_needed where there is no name or the
    confidence is not within 0 and 1."""
    each = extractions.select(id_col, F.inline("concepts"))
    return records.named(each).withColumn("review_needed", F.col("name").isNull() | ~F.coalesce(F.col("confidence"), F.lit(0.7)).between(0, 1))


def relations(extractions: DataFrame, id_col: str) -> DataFrame:
    return extractions.select(id_col, F.inline("relationships")).withColumn("type", F.upper(F.translate("type", " ", "_")))


def fan_out(raw: DataFrame, id_col: str, column: str = "value") -> tuple[dict[str, DataFrame], dict[str, int]]:
    """Tables of concepts, terms, relations and mappings, and how many rows each has, from one pass over the records.

    The records are parsed once and written; the counters are observed on the way. A concept without any name goes with its
    terms. Its name is always one of its terms, the official one, before the others; equal terms of a concept are one. Of a
    qualified name, the last part names the asset. counters: also records, and broken ones, which are no JSON.
    """
    filled = lambda c: F.when(F.trim(c) != "", c)
    x = raw.select(id_col, F.from_json(F.col(column), RECORD + ", _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("x")).select(id_col, "x.*")
    lists = dict(f.split(" ", 1) for f in RECORD.split(", ") if " array<" in f)
    x = x.withColumns({c: F.coalesce(c, F.array().cast(x.schema[c].dataType)) for c in lists})
    name = lambda c: F.coalesce(filled(c["name"]), filled(c["name_he"]), filled(c["canonical_name"]), filled(F.get(c["terms"], F.lit(0))))
    known = F.transform("concepts", lambda c: c.withField("name", name(c)).withField("terms", F.array_distinct(F.array_compact(F.concat(F.array(name(c)), F.coalesce(F.transform(c["terms"], filled), F.array().cast("array<string>")))))))
    x = x.withColumn("concepts", F.filter(known, lambda c: c["name"].isNotNull()))
    terms = F.aggregate("concepts", F.lit(0), lambda n, c: n + F.size(c["terms"]))
    seen = Observation()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    done = cut(x.observe(
        seen, F.count(F.lit(1)).alias("records"), F.count("_broken").alias("broken"), total(F.size("concepts")).alias("concepts"), total(terms).alias("terms"),
        total(F.size("relationships")).alias("relations"), total(F.size("data_mappings")).alias("mappings")))
    each = done.select(id_col, F.explode("concepts").alias("c"))
    tables = {
        "concepts": records.named(each.select(id_col, "c.*")),
        "terms": each.select(id_col, F.col("c.name").alias("concept"), F.posexplode("c.terms").alias("at", "surface_form")).withColumn("official", F.col("at") == 0).drop("at"),
        "relations": relations(done, id_col),
        "mappings": done.select(id_col, F.inline("data_mappings")).withColumn("asset_name", F.element_at(F.split("qualified_name", "\\."), -1)),
    }
    return tables, {k: int(v) for k, v in seen.get.items()}
