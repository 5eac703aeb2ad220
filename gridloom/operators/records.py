"""Concept records, search documents, edges from wide rows, review decisions, and section chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.functions.text import is_header, split_list
from gridloom.operators import hierarchy


def named(concepts: DataFrame) -> DataFrame:
    """Name and description from their first non-blank source, the name as first term, and a domain.

    Input: name, name_he, canonical_name, description, description_he, terms array<string>, domain array<string>.
    """
    filled = lambda *cs: F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in cs])
    out = concepts.withColumns({
        "name": F.coalesce(filled("name", "name_he", "canonical_name"), F.get("terms", F.lit(0))),
        "description": F.coalesce(filled("description", "description_he"), F.lit("")),
        "terms": F.coalesce("terms", F.array().cast("array<string>")),
        "domain": F.when(F.size(F.coalesce("domain", F.array().cast("array<string>"))) == 0, F.array(F.lit("General"))).otherwise(F.col("domain")),
    })
    return out.withColumn("terms", F.when(F.col("name").isNull() | F.array_contains("terms", F.col("name")), F.col("terms")).otherwise(F.array_prepend("terms", F.col("name"))))


def coordinates(point: Column) -> tuple[Column, Column]:
    """Longitude and latitude of `POINT (lon lat)` or `lon,lat`; null for anything else."""
    number = r"(-?[0-9]+(?:\.[0-9]+)?)"
    pattern = rf"(?i)^\s*(?:POINT\s*\(\s*)?{number}\s*[, ]\s*{number}\s*\)?\s*$"
    return tuple(F.when(point.rlike(pattern), F.regexp_extract(point, pattern, k).cast("double")) for k in (1, 2))


def reference_edges(rows: DataFrame, source: str, columns: dict[str, str]) -> DataFrame:
    """One edge for each name listed in a reference column: src, dst, edge_type, source_column."""
    flat = rows.select(F.col(source).alias("src"), *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(["src"], list(columns), "source_column", "names")
    kind = F.create_map(*[F.lit(x) for kv in columns.items() for x in kv])[F.col("source_column")]
    return flat.select("src", F.explode(split_list(F.col("names"))).alias("dst"), F.coalesce(kind, F.lit("DEPENDS_ON")).alias("edge_type"), "source_column").distinct()


def effort_edges(rows: DataFrame, source: str, columns: list[str], levels: dict[str, float]) -> DataFrame:
    """SUPPORTS edges from effort columns, numbers or named levels: src, dst, weight within 0 and 1."""
    flat = rows.select(F.col(source).alias("src"), *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(["src"], columns, "dst", "effort")
    level = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])[F.lower(F.trim("effort"))]
    return flat.withColumn("weight", F.coalesce(F.col("effort").try_cast("double"), level)).filter(F.col("weight").between(0, 1)).select("src", "dst", "weight")


def contains_edges(rows: DataFrame, levels: list[str]) -> DataFrame:
    """CONTAINS edges between neighbouring levels of a row; a node is named with those above it, so equal names do not meet."""
    key = lambda n: F.concat_ws("/", *levels[:n])
    out = None
    for n in range(1, len(levels)):
        step = rows.filter(F.col(levels[n - 1]).isNotNull() & F.col(levels[n]).isNotNull()).select(key(n).alias("src"), key(n + 1).alias("dst"), F.lit(levels[n]).alias("level")).distinct()
        out = step if out is None else out.unionByName(step)
    return out


def search_documents(concepts: DataFrame, terms: DataFrame, ancestors: DataFrame) -> DataFrame:
    """One record per concept with its distinct aliases and its ancestors, nearest first."""
    alias = terms.groupBy("concept_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    none = F.array().cast("array<string>")
    return concepts.join(alias, "concept_id", "left").join(hierarchy.search_fields(ancestors), "concept_id", "left").withColumns(
        {"aliases": F.coalesce("aliases", none), "ancestor_ids": F.coalesce("ancestor_ids", none), "hierarchy_depth": F.coalesce("hierarchy_depth", F.lit(0))})


def update_fields(docs: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """docs with the changed fields where there are new values; documents that no change names stay as they are."""
    new = changes.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    return docs.join(new, key, "left").withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).select(*docs.columns)


def decided_nodes(nodes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Nodes after review: rejected and merged ones go, approved ones are marked, the rest stay pending."""
    d = nodes.join(decisions.select("id", "resolution"), "id", "left").filter("coalesce(resolution, '') NOT IN ('REJECT', 'MERGE')")
    return d.withColumn("status", F.when(F.col("resolution") == "APPROVE", "APPROVED").otherwise("PENDING")).drop("resolution")


def decided_edges(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Edges after review: ends move to the last target of their merges, equal edges fold, loops and rejected ends go."""
    final = hierarchy.replacements(decisions.filter("resolution = 'MERGE'").select("id", F.col("target_id").alias("next_id")))
    gone = decisions.filter("resolution = 'REJECT'").select("id")
    for end in ("src", "dst"):
        edges = edges.join(final.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("final_id", end)).drop("final_id")
        edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return edges.filter("src <> dst").groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))


def top_per(rows: DataFrame, key: str, order: list, limit: int) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("position") <= limit)


#: White space at the ends of a chunk or title.
BLANK = r"[\x09-\x0D\x1C-\x20\x85\p{Z}]+"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}|{BLANK}$", "")


def sections(docs: DataFrame, id_col: str, pages: Column, size: int = 1500, overlap: int = 200, pending: int = 50, least: int = 30) -> DataFrame:
    """Chunks along section headers: id_col, n, title, first_page, last_page, text.

    pages is an array of page texts. Lines gather; a header closes the chunk if over `pending` characters wait; at the
    end of a page a chunk of `size` characters or more closes and leaves its last `overlap` characters to the next.
    Chunks under `least` characters go. A chunk is a stretch of the document's lines, so a fold over the lines of a
    document that carries numbers finds where chunks begin and end, and the texts are cut out at the end. `size` must be
    more than `overlap`.
    """
    line = "struct<page: int, line: string, header: boolean>"
    lines = F.coalesce(F.flatten(F.transform(pages, lambda p, k: F.transform(F.split(p, "\n"), lambda x: F.struct(k.alias("page"), x.alias("line"), is_header(x).alias("header"))))), F.array().cast(f"array<{line}>"))
    chunk = "struct<title: string, first: int, last: int, start: int, stop: int>"
    # start, at: where the waiting chunk and the next line begin; length: characters that wait; open: whether any line does
    state = F.lit(None).cast(f"struct<chunks: array<{chunk}>, start: int, at: int, length: int, title: string, first: int, page: int, open: boolean>")
    zero = F.struct(F.array().cast(f"array<{chunk}>").alias("chunks"), *[F.lit(0).alias(c) for c in ("start", "at", "length")], F.lit(None).cast("string").alias("title"), F.lit(0).alias("first"), F.lit(0).alias("page"), F.lit(False).alias("open"))

    def closed(s, stop):
        return F.array_append(s["chunks"], F.struct(s["title"].alias("title"), s["first"].alias("first"), s["page"].alias("last"), s["start"].alias("start"), stop.alias("stop")))

    def take(s, x):
        """The state after a line; x.ends: another page follows."""
        flush = x["header"] & (s["length"] > pending)
        fresh = flush | ~s["open"]
        end = s["at"] + F.length(x["line"])
        length = F.when(flush, 0).otherwise(s["length"]) + F.length(x["line"]) + 1
        chunks = F.when(flush, closed(s, s["at"] - 1)).otherwise(s["chunks"])
        now = F.struct(
            chunks.alias("chunks"), F.when(fresh, s["at"]).otherwise(s["start"]).alias("start"), (end + 1).alias("at"), length.alias("length"),
            F.when(x["header"], stripped(x["line"])).otherwise(s["title"]).alias("title"), F.when(fresh, x["page"]).otherwise(s["first"]).alias("first"), x["page"].alias("page"), F.lit(True).alias("open"))
        full = x["ends"] & (length >= size)
        cut_off = F.struct(closed(now, end).alias("chunks"), (end - overlap).alias("start"), now["at"].alias("at"), F.lit(overlap).alias("length"), now["title"].alias("title"), x["page"].alias("first"), x["page"].alias("page"), F.lit(True).alias("open"))
        return F.when(full, cut_off).otherwise(now)

    rows = docs.select(id_col, lines.alias("lines")).filter(F.size("lines") > 0)
    ends = F.transform("lines", lambda x, i: F.struct(x["page"].alias("page"), x["line"].alias("line"), x["header"].alias("header"), F.coalesce(F.get("lines", i + 1)["page"] != x["page"], F.lit(False)).alias("ends")))
    folded = rows.select(id_col, F.array_join(F.col("lines.line"), "\n").alias("whole"), F.aggregate(ends, F.coalesce(state, zero), take).alias("s"))
    every = folded.select(id_col, "whole", closed(F.col("s"), F.col("s.at") - 1).alias("chunks"))
    texts = F.transform("chunks", lambda c: F.struct(c["title"].alias("title"), c["first"].alias("first_page"), c["last"].alias("last_page"), stripped(F.substring(F.col("whole"), c["start"] + 1, c["stop"] - c["start"])).alias("text")))
    kept = F.filter(texts, lambda c: F.length(c["text"]) >= least)
    return every.select(id_col, F.posexplode(kept).alias("n", "c")).select(id_col, "n", "c.*")
