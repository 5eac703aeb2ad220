"""Token counts: batch encoding in an Arrow function that returns lengths only.

Rows are regrouped into batches of equal bytes, so a few long texts make a batch of their own. Texts over a million
characters are cut at single blanks between words, where no token crosses. The library encodes all parts of a batch in
one call, and only the lengths leave it. Nothing is shuffled.

Defined results: a null text is the empty text with no tokens; null and repeated ids pass through, one row per input
row; an empty input gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.words import BATCH_BYTES, balanced, chunks, tokenizer

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def lengths(tok, texts: list[str]) -> list[int]:
    """Numbers of tokens of texts, encoded in calls of about BATCH_BYTES characters."""
    out = [0] * len(texts)
    owners, parts, held = [], [], 0

    def flush() -> None:
        for k, e in zip(owners, tok.encode_batch_fast(parts, add_special_tokens=False)):
            out[k] += len(e)
        owners.clear()
        parts.clear()

    for k, text in enumerate(texts):
        for part in chunks(text):
            owners.append(k)
            parts.append(part)
            held += len(part)
            if held >= BATCH_BYTES:
                flush()
                held = 0
    flush()
    return out


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def scan(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        tok = tokenizer(tokenizer_path)
        for ids, texts in balanced(batches):
            n = lengths(tok, texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(scan, SCHEMA)
