"""Sources: binary documents, catalog records, wide rows with column roles, and review routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a file that a task holds as a whole; larger files are hashed line by line.
WHOLE_BYTES = 64 << 20
#: Spark reads lines of files of these names through their codec, so such files are held as a whole (2 GB at most).
CODED = r"\.(gz|bz2|deflate|lz4|snappy|zstd?)$"


def binary_documents(spark: SparkSession, path: str, glob: str = "*.pdf", since: str | None = None, hashed: bool = True) -> DataFrame:
    """Path, size, time and content hash; unreadable files are skipped. since: items modified at or after it. hashed: False
    leaves the hash out and reads no contents."""
    read = lambda kind: spark.read.format(kind).option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
    files = read("binaryFile").load(path)
    files = files if since is None else files.filter(F.col("modificationTime") >= F.lit(since).cast("timestamp"))
    shown = ["path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    if not hashed:
        return files.select(*shown)
    at, whole = F.col("_metadata.file_path"), (F.col("_metadata.file_size") <= WHOLE_BYTES) | F.lower("_metadata.file_name").rlike(CODED)
    small = files.filter(whole).select(*shown, F.sha2("content", 256).alias("content_hash"))
    lines = read("text").option("lineSep", "\n").load(path)
    lines = lines if since is None else lines.filter(F.col("_metadata.file_modification_time") >= F.lit(since).cast("timestamp"))
    return small.unionByName(files.filter(~whole).select(*shown, at.alias("at")).join(_hashes(lines.filter(~whole)), "at").drop("at"))


def _hashes(lines: DataFrame) -> DataFrame:
    """(at, content_hash) of whole files from their lines, which the text source leaves as the bytes that they are.

    A hash goes through a file in order, so a file's lines meet in one task, sorted on disk where they do not fit; it holds a
    batch of them at a time. The file's size tells whether the last line is ended and whether the source left a byte order
    mark out; a file of which lines are missing is unreadable."""

    def scan(batches):
        import hashlib

        import pyarrow as pa

        mark = b"\xef\xbb\xbf"
        ending = {0: (0, b"\n"), 1: (0, b""), -3: (1, b"\n"), -2: (1, b"")}  # what is there too much: state, last bytes

        def row(name, states, size, seen):
            if seen - size in ending:
                which, last = ending[seen - size]
                states[which].update(last)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([states[which].hexdigest()])], ["at", "content_hash"])

        name, states, size, seen = None, [], 0, 0
        for b in batches:
            names = b.column("at").dictionary_encode()
            changes = [0, *[i for i in range(1, len(names)) if names.indices[i] != names.indices[i - 1]], len(names)] if len(names.dictionary) > 1 else [0, len(names)]
            for begin, end in zip(changes, changes[1:]):
                if begin == end:
                    continue
                if (here := names[begin].as_py()) != name:
                    if name is not None:
                        yield from row(name, states, size, seen)
                    name, states, size, seen = here, [hashlib.sha256(), hashlib.sha256(mark)], b.column("size")[begin].as_py(), 0
                text = b"\n".join(([b""] if seen else []) + b.column("line").slice(begin, end - begin).to_pylist())
                for state in states:
                    state.update(text)
                seen += len(text) + (0 if seen else 1)
        if name is not None:
            yield from row(name, states, size, seen)

    each = lines.select(F.col("_metadata.file_path").alias("at"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("k"), F.col("value").cast("binary").alias("line"))
    return each.repartition("at").sortWithinPartitions("at", "begin", "k").select("at", "size", "line").mapInArrow(scan, "at string, content_hash string")


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of the row as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def unseen(scan: DataFrame, jobs: DataFrame, keys=("external_id", "content_hash")) -> DataFrame:
    return scan.join(jobs.select(*keys), list(keys), "left_anti")


def shape(rows: DataFrame, roles: dict[str, list[str]]) -> DataFrame:
    """One map per role with the non-blank cells of its columns; rows blank in all of them go."""
    used = [c for cs in roles.values() for c in cs]
    cell = lambda c: F.trim(F.col(c).cast("string"))
    filled = lambda cs: F.map_filter(F.map_from_arrays(F.array(*map(F.lit, cs)), F.array(*map(cell, cs))), lambda _, v: v != "")
    out = rows.filter(F.greatest(*[F.coalesce(F.length(cell(c)), F.lit(0)) for c in used], F.lit(0)) > 0)
    return out.select("*", *[filled(cs).alias(role) for role, cs in roles.items()])


def reviewed(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """review_needed and review_reason; every row stays."""
    reason = F.concat_ws(",", *[F.when(bad, F.lit(name)) for name, bad in checks.items()])
    return rows.withColumn("review_reason", F.when(reason != "", reason)).withColumn("review_needed", reason != "")


def schema_report(rows: DataFrame, known: dict[str, str], hints: dict[str, str], sample: int = 20, order: str | None = None) -> DataFrame:
    """Role of each column from the first `sample` rows: known name, hint in the name, then mean length of the samples."""
    columns = [c for c in rows.columns if c != order]
    first = (rows.orderBy(order) if order else rows).limit(sample)
    flat = first.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    stats = flat.groupBy("column").agg(F.avg(F.length("value")).alias("mean_length"), F.avg(F.col("value").isNull().cast("int")).alias("null_share"))
    by_name = F.lit(None).cast("string")
    for k, role in known.items():
        by_name = F.when(F.lower("column") == k, role).otherwise(by_name)
    by_hint = F.coalesce(*[F.when(F.contains(F.lower("column"), F.lit(k)), F.lit(role)) for k, role in hints.items()], F.lit(None).cast("string"))
    by_length = F.when(F.col("mean_length") > 60, "FREE_TEXT").when(F.col("mean_length") < 20, "META")
    confidence = F.when(by_name.isNotNull(), 0.98).when(F.coalesce(by_hint, by_length).isNotNull(), 0.85).otherwise(0.4)
    return stats.select("column", F.coalesce(by_name, by_hint, by_length, F.lit("UNKNOWN")).alias("role"), confidence.alias("confidence"), (F.col("null_share") > 0.5).alias("sparse"))
