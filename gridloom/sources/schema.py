"""Roles of a wide table's columns: known headers, hints in names, lengths of samples, fallbacks and overrides.

Headers are as many as the table has columns; they are joined to rule tables by key and the rule with the smallest
priority wins. Samples come from the first rows only, so a table of any size is detected at the cost of one top-n.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Known headers of facility tables, spelled right or wrong, and their roles.
KNOWN_HEADERS = {
    "id": "META",
    "site_name": "LOCATION_ID",
    "facility_name": "FACILITY_ID",
    "component_name": "COMPONENT_ID",
    "category": "CATEGORICAL",
    "responsible_body": "STRUCTURED_REF",
    "system": "STRUCTURED_REF",
    "support_for_attack_effort": "CATEGORICAL",
    "support_for_defende_control_effort": "CATEGORICAL",
    "support_for_defence_control_effort": "CATEGORICAL",
    "support_for_intelligence_effort": "CATEGORICAL",
    "support_for_allert_effort": "CATEGORICAL",
    "support_for_alert_effort": "CATEGORICAL",
    "support_for_national_effort": "CATEGORICAL",
    "ploygon": "GEO",
    "polygon": "GEO",
    "central_point": "GEO",
    "details_on_facilty_purpose": "FREE_TEXT",
    "details_on_facility_purpose": "FREE_TEXT",
    "operational_significance_if_damaged": "FREE_TEXT",
    "sop_if_damaged": "FREE_TEXT",
    "deffence_with_iron_dome": "CATEGORICAL",
    "defence_with_iron_dome": "CATEGORICAL",
    "level_for_deffense_with_upper_layer": "CATEGORICAL",
    "level_for_defence_with_upper_layer": "CATEGORICAL",
    "system_information": "FREE_TEXT",
    "component_importance_to_system": "FREE_TEXT",
    "hardering": "META",
    "hardening": "META",
    "concelaments": "META",
    "concealment": "META",
    "sidtibution": "META",
    "distribution": "META",
    "distribution_details": "FREE_TEXT",
    "recovery_capability": "META",
    "redundency": "META",
    "redundancy": "META",
    "redundency_details": "FREE_TEXT",
    "redundancy_details": "FREE_TEXT",
    "primary_backup": "STRUCTURED_REF",
    "secondary_primary": "STRUCTURED_REF",
    "mobility": "META",
    "related_facilty": "STRUCTURED_REF",
    "related_facility": "STRUCTURED_REF",
    "connected_power_station": "STRUCTURED_REF",
    "connection_to_strategic_fuel_reserves": "STRUCTURED_REF",
    "refined_coordinate": "GEO",
    "site_by_aerial_defense": "STRUCTURED_REF",
}

# Hints of each role, in the order in which they are tried; whether a hint may be a word of the name, the
# whole name, or either. Names of more than one word can only be whole names.
HINTS = [
    ("LOCATION_ID", "either", (
        "location", "loc", "site", "site_name", "building", "base", "address", "facility", "zone", "segment", "מיקום", "אתר", "בסיס",
    )),
    ("FACILITY_ID", "either", (
        "facility_name", "facility", "building_name",
    )),
    ("COMPONENT_ID", "either", (
        "component_name", "component",
    )),
    ("FREE_TEXT", "name", (
        "operational_significance_if_damaged", "sop_if_damaged", "system_information", "component_importance_to_system", "distribution_details",
        "redundency_details", "redundancy_details",
    )),
    ("STRUCTURED_REF", "name", (
        "primary_backup", "secondary_primary", "related_facilty", "related_facility", "connected_power_station", "connection_to_strategic_fuel_reserves",
        "responsible_body", "system", "site_by_aerial_defense",
    )),
    ("CATEGORICAL", "name", (
        "support_for_attack_effort", "support_for_defende_control_effort", "support_for_defence_control_effort", "support_for_intelligence_effort",
        "support_for_allert_effort", "support_for_alert_effort", "support_for_national_effort", "deffence_with_iron_dome", "defence_with_iron_dome",
        "level_for_deffense_with_upper_layer", "level_for_defence_with_upper_layer", "central_point",
    )),
    ("GEO", "name", (
        "ploygon", "polygon", "central_point", "refined_coordinate", "coordinate", "geo",
    )),
    ("DEPENDENCY", "word", (
        "dependency", "dependencies", "dep", "uses", "contains", "hosts", "departments", "department", "projects", "project", "assets", "systems",
        "personnel", "תלות", "תלויות", "מחלקות",
    )),
    ("LOCATION_DESC", "word", (
        "description", "desc", "notes", "remarks", "details", "purpose", "details_on_facilty_purpose", "details_on_facility_purpose", "תיאור", "הערות",
    )),
    ("META", "word", (
        "region", "tier", "status", "type", "category", "criticality", "id", "hardering", "hardening", "concelaments", "concealment", "sidtibution",
        "distribution", "recovery_capability", "redundency", "redundancy", "mobility", "אזור", "קריטיות", "סטטוס",
    )),
]
RULES = "kind string, key string, priority int, role string"


def rules() -> list[tuple[str, str, int, str]]:
    """(kind of key, key, priority, role); known headers have priority 0."""
    out = [("name", k, 0, role) for k, role in KNOWN_HEADERS.items()]
    for priority, (role, where, hints) in enumerate(HINTS, 1):
        kinds = {"either": ("name", "word"), "name": ("name",), "word": ("word",)}[where]
        out += [(kind, h, priority, role) for h in hints for kind in kinds]
    return out


def with_headers(cells: list[str | None]) -> list[str]:
    """Header names; an empty cell becomes col_<its index>."""
    return [str(c) if c else f"col_{k}" for k, c in enumerate(cells)]


def stacked(sheets: list[DataFrame]) -> DataFrame:
    """All sheets below one another, their columns by position under the first sheet's header, as text. Columns that
    the header lacks go; columns that a sheet lacks are null."""
    names = with_headers(sheets[0].columns)
    fit = lambda s: s.toDF(*[f"c{k}" for k in range(len(s.columns))]).select(*[(F.col(f"c{k}").cast("string") if k < len(s.columns) else F.lit(None).cast("string")).alias(n) for k, n in enumerate(names)])
    return reduce(DataFrame.unionByName, map(fit, sheets))


def column_roles(rows: DataFrame, order: str, sample: int = 20, shown: int = 5, overrides: dict[str, str] | None = None) -> DataFrame:
    """position, column_name, role, confidence, samples, sparse, overridden of each column but `order`, which puts the rows in
    order. Samples are the first `shown` values among the first `sample` rows; sparse: over half of these rows are null.

    An operator's override replaces a role, with confidence 1."""
    spark, names = rows.sparkSession, [c for c in rows.columns if c != order]
    headers = spark.createDataFrame(list(enumerate(names)), "position int, column_name string").withColumn("key_name", F.lower(F.trim("column_name")))
    first = rows.select(F.col(order).alias("_order"), *[F.col(c).cast("string").alias(c) for c in names]).orderBy("_order").limit(sample)
    flat = first.unpivot(["_order"], names, "column_name", "value")
    in_order = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("_order", "value"))))
    seen = flat.groupBy("column_name").agg(F.slice(in_order["value"], 1, shown).alias("samples"), (2 * F.count_if(F.col("value").isNull()) > F.count(F.lit(1))).alias("sparse"))
    words = F.filter(F.split(F.translate("key_name", "-_", "  "), " +"), lambda w: w != "")
    keys = F.array_union(F.array(F.struct(F.lit("name").alias("kind"), F.col("key_name").alias("key"))), F.transform(words, lambda w: F.struct(F.lit("word").alias("kind"), w.alias("key"))))
    table = spark.createDataFrame(rules(), RULES)
    by_rule = headers.select("position", F.inline(keys)).join(F.broadcast(table), ["kind", "key"]).groupBy("position").agg(F.min(F.struct("priority", "role")).alias("rule"))
    h = headers.join(by_rule, "position", "left").join(seen, "column_name", "left")
    total = F.aggregate("samples", F.lit(0), lambda n, v: n + F.length(v))
    mean = F.when(F.size("samples") > 0, total / F.size("samples"))
    role = F.coalesce("rule.role", F.when(mean > 60, "FREE_TEXT").when(mean < 20, "META"), F.lit("UNKNOWN"))
    h = h.withColumns({"samples": F.coalesce("samples", F.array().cast("array<string>")), "sparse": F.coalesce("sparse", F.lit(False)), "found": role})
    lone = (F.col("position") == 0) & (F.col("found") == "UNKNOWN")
    confidence = F.when(F.col("rule.priority") == 0, 0.98).when(lone, 0.6).when(F.col("found") != "UNKNOWN", 0.85).otherwise(0.4)
    given = spark.createDataFrame(list((overrides or {}).items()), "column_name string, given string")
    h = h.withColumns({"confidence": confidence, "found": F.when(lone, "LOCATION_ID").otherwise(F.col("found"))}).join(F.broadcast(given), "column_name", "left")
    return h.select("position", "column_name", F.coalesce("given", "found").alias("role"), F.when(F.col("given").isNotNull(), 1.0).otherwise(F.col("confidence")).alias("confidence"), "samples", "sparse", F.col("given").isNotNull().alias("overridden"))


def schema_summary(roles: DataFrame) -> DataFrame:
    """One row: location_column, facility_column, component_column, dependency_columns, description_columns, meta_columns,
    confidence (the lowest of all columns), warnings.

    Without a location column the first column is taken; without dependency and free-text columns all columns that have
    no other use are, each with a warning."""
    at = F.struct("position", "column_name")
    first = lambda *kinds: F.min(F.when(F.col("role").isin(*kinds), at))["column_name"]
    named = lambda *kinds: F.array_sort(F.collect_list(F.when(F.col("role").isin(*kinds), at)))["column_name"]
    s = roles.agg(
        first("LOCATION_ID").alias("own_location"), F.min(at)["column_name"].alias("first_column"), first("FACILITY_ID").alias("facility_column"), first("COMPONENT_ID").alias("component_column"),
        named("DEPENDENCY").alias("dep"), named("FREE_TEXT").alias("free"), named("LOCATION_DESC").alias("description_columns"), named("META").alias("meta"), named("CATEGORICAL").alias("cat"), named("GEO").alias("geo"),
        named("UNKNOWN", "LOCATION_ID", "FACILITY_ID", "COMPONENT_ID").alias("others"), F.coalesce(F.min("confidence"), F.lit(0.5)).alias("confidence"),
        F.array_sort(F.collect_list(F.when(F.col("sparse"), at)))["column_name"].alias("sparse"))
    s = s.withColumn("location_column", F.coalesce("own_location", "first_column"))
    used = F.array_compact(F.array("location_column", "facility_column", "component_column"))
    s = s.withColumn("rest", F.when((F.size("dep") == 0) & (F.size("free") == 0), F.array_except("others", used)).otherwise(F.array().cast("array<string>")))
    note = lambda c: F.concat(F.lit("Column '"), c, F.lit("' has > 50% empty cells"))
    warnings = F.concat(
        F.transform("sparse", note),
        F.when(F.col("own_location").isNull() & F.col("first_column").isNotNull(), F.array(F.concat(F.lit("No location column found, taking '"), F.col("first_column"), F.lit("'")))).otherwise(F.array().cast("array<string>")),
        F.when(F.size("rest") > 0, F.array(F.concat(F.lit("No dependency or free-text column found, taking "), F.array_join("rest", ", ")))).otherwise(F.array().cast("array<string>")))
    return s.select("location_column", "facility_column", "component_column", F.concat("dep", "rest", "free").alias("dependency_columns"), "description_columns", F.concat("meta", "cat", "geo").alias("meta_columns"), "confidence", warnings.alias("warnings"))
