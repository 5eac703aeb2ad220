"""Line dedup: drop every line whose key is found in many documents.

Lines are exploded with their position, keyed by the line stripped of ASCII white space at both ends with A-Z in
lower case, and hashed to 128 bits. Distinct documents are counted per hash, and the positions of lines over the
threshold go back to their document, where the other lines are joined in order. Only hashes and positions are
exploded and shuffled by line; the texts move once, to meet their document's positions.

Defined results: a null or empty text is one empty line, and empty keys never count. A document is a value of the id
column: repeated rows with one id count once, rows with a null id are one document together. Each row gets a result
of its own. A document that loses all its lines has the empty text. An empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import cut, join_unique, two_hashes

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Stripped line, A-Z lower-cased; lower() does the same, faster, where all characters are ASCII."""
    inner = F.trim(line, F.lit(WHITE))
    return F.when(F.octet_length(inner) == F.length(inner), F.lower(inner)).otherwise(F.translate(inner, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def frequent_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """Hashes found in at least min_docs documents, with n_docs and n_lines (all rows with the hash)."""
    per_doc = lines.groupBy("h1", "h2", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    counts = per_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_lines"))
    return counts.filter(F.col("n_docs") >= min_docs)


def _marked(docs: DataFrame, min_docs: int, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, text, gone): the row as it was and the positions of its lines that go."""
    base = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row_hash", F.xxhash64("doc_id", "text"))
    exploded = base.select("doc_id", "row_hash", F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("pos", "key")).filter(F.length("key") >= min_chars)
    h1, h2 = two_hashes(F.col("key"))
    lines = cut(exploded.select("doc_id", "row_hash", "pos", h1.alias("h1"), h2.alias("h2")), "lines")
    frequent = cut(frequent_lines(lines, min_docs), "frequent-lines")
    hits = join_unique(lines, frequent, ["h1", "h2"], "n_lines", lines.count())
    gone = hits.groupBy("doc_id", "row_hash").agg(F.collect_set("pos").alias("gone"))
    rows = base.alias("b").join(gone.alias("g"), F.col("b.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("b.row_hash") == F.col("g.row_hash")), "left")
    return rows.select("b.row", "b.doc_id", "b.text", F.coalesce("g.gone", F.array().cast("array<int>")).alias("gone"))


def _kept_text() -> Column:
    """Lines at the positions that are left. Lines and positions are bound once, so the work is linear in the lines."""

    def joined(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    rest = F.transform(F.array(lines_of(F.col("text"))), joined)[0]
    return F.when(F.size("gone") == 0, F.col("text")).otherwise(rest)


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, kept_text."""
    rows = _marked(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), min_docs, min_chars, "doc_id", "text")
    return rows.select("doc_id", F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), _kept_text().alias("kept_text"))


def without_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the frequent lines gone from their texts and all other columns as they were. Texts without such lines,
    null ones too, stay as they are."""
    rows = _marked(docs, min_docs, min_chars, id_col, text_col)
    text = F.when(F.size("gone") == 0, F.col("row")[text_col]).otherwise(_kept_text())
    return rows.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
