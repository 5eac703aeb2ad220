"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a byte context tree of variable order, learned from a bounded sample: the `sample_docs` labelled
documents per language with the smallest hash of their id. Its statistics are then frozen, so the code length of every
byte after every context is a constant: counts at the longest known context, else an escape (method C: distinct
symbols over total plus distinct) to the context without its oldest byte, with symbols of longer contexts excluded,
down to a uniform code. The contexts of all languages form one table, and a text's exact code length under each
language is a sum of table entries at its bytes. The language with the shortest code is predicted.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text if nothing could be
learned. Ties go to the language that sorts first. A null id is in no sample and not held out. Repeated rows are scored
each; an empty input gives an empty result. Other columns are not read; lang is read for the sample only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.words import balanced

ORDER = 4
SAMPLE_DOCS = 400
#: A context is kept if the sample has it this often, over all languages.
MIN_COUNT = 12
LETTER = re.compile(r"[^\W\d_]")
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"
#: Positions scored at once.
SLICE = 1 << 19


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, per_lang: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, text) of the documents learned from: those whose id's hash lies in the lowest per_lang / n part of its
    range, for a language with n documents. Counts by language decide the part, so no language is sorted."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = rows.groupBy("lang").agg((F.lit(per_lang) / F.count(F.lit(1))).alias("share"))  # a row per language
    place = F.xxhash64("doc_id") / 2.0**64 + 0.5
    return rows.join(F.broadcast(share), "lang").filter(place <= F.col("share")).select("lang", "text")


def gram_counts(rows: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n): counts of order + 1 successive bytes, as one integer; texts begin after `order` zero bytes."""

    def scan(batches):
        for b in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(bytes(order) + (text or "").encode())
            for lang, texts in by_lang.items():
                grams = []
                for t in texts:
                    x = np.frombuffer(t, np.uint8).astype(np.int64)
                    n = len(x) - order
                    grams.append(sum(x[k : k + n] << (8 * (order - k)) for k in range(order + 1)))
                gram, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return rows.mapInArrow(scan, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """children[k]: for a context of k bytes (row, from 1) and one older byte (symbol), the row of the longer context, or 0.
    first[k]: where the contexts of k bytes begin in `bits`. bits: code length at [context * symbols + symbol, language]."""

    langs: list[str]
    symbol: np.ndarray
    children: list[np.ndarray]
    first: list[int]
    bits: np.ndarray


def learn(grams: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER, min_count: int = MIN_COUNT) -> Model:
    langs = sorted(grams)
    used = np.unique(np.concatenate([(g >> (8 * k)) & 255 for g, _ in grams.values() for k in range(order + 1)]))
    symbol = np.zeros(256, np.int64)  # 0: any byte that the sample lacks
    symbol[used] = np.arange(1, len(used) + 1)
    size = len(used) + 1
    coded = {}
    for lang, (g, n) in grams.items():
        # newest context byte first, so a longer context has its suffix as prefix: sym, b1, b2, ...
        s = [symbol[(g >> (8 * k)) & 255] for k in range(order + 1)]
        coded[lang] = (s, n)
    children, rows_of, counts = [], [], []
    for k in range(order + 1):
        if k == 0:
            rows = {lang: np.ones(len(n), np.int64) for lang, (_, n) in coded.items()}
            total = 1
        else:
            parent = rows_of[-1]
            key = {lang: np.where(parent[lang] > 0, parent[lang] * size + coded[lang][0][k], 0) for lang in langs}
            weight = np.zeros((children_rows + 1) * size, np.int64)
            for lang in langs:
                np.add.at(weight, key[lang], coded[lang][1])
            weight[:size] = 0
            kept = np.flatnonzero(weight >= min_count)
            table = np.zeros((children_rows + 1) * size, np.int32)
            table[kept] = np.arange(1, len(kept) + 1)
            children.append(table)
            rows = {lang: table[key[lang]].astype(np.int64) for lang in langs}
            total = len(kept)
        children_rows = total
        rows_of.append(rows)
        c = np.zeros((len(langs), total + 1, size))
        for j, lang in enumerate(langs):
            np.add.at(c[j], (rows[lang], coded[lang][0][0]), coded[lang][1])
        c[:, 0] = 0
        counts.append(c)
    first = np.cumsum([0, *[c.shape[1] for c in counts]]).tolist()
    bits = np.zeros((first[-1], size, len(langs)), np.float32)
    up: list[np.ndarray] = [np.zeros(0, np.int64)]  # parent row of each context
    for k in range(1, order + 1):
        at = np.flatnonzero(children[k - 1])
        parent = np.zeros(counts[k].shape[1], np.int64)
        parent[children[k - 1][at]] = at // size
        up.append(parent)
    for k in range(order + 1):
        for j in range(len(langs)):
            bits[first[k] : first[k + 1], :, j] = code_lengths([c[j] for c in counts[: k + 1]], up[: k + 1])
    return Model(langs, symbol.astype(np.uint8 if size <= 256 else np.int64), children, first, bits.reshape(-1, len(langs)))


def code_lengths(counts: list[np.ndarray], up: list[np.ndarray]) -> np.ndarray:
    """Bits of each symbol at each context of the longest order in counts."""
    k = len(counts) - 1
    rows = np.arange(counts[k].shape[0])
    p = np.zeros(counts[k].shape)
    excluded = np.zeros(p.shape, bool)
    escape = np.ones((len(rows), 1))
    for level in range(k, -1, -1):
        c = np.where(excluded, 0, counts[level][rows])
        total, distinct = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
        scale = escape / np.maximum(total + distinct, 1)
        p += c * scale
        escape = np.where(total > 0, distinct * scale, escape)
        excluded |= c > 0
        if level:
            rows = up[level][rows]
    left = (~excluded).sum(1, keepdims=True)
    p += np.where(excluded, 0, escape / np.maximum(left, 1))
    return -np.log2(np.maximum(p, 1e-30))


def lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Code length in bits of each text under each language."""
    order, size = len(model.children), len(model.bits) // model.first[-1]
    out = np.zeros((len(texts), len(model.langs)))
    pad = bytes(order)
    buffer = model.symbol[np.frombuffer(b"".join(pad + t for t in texts), np.uint8)]
    ends = np.cumsum([len(t) + order for t in texts])
    for a in range(order, len(buffer), SLICE):
        b = min(a + SLICE, len(buffer))
        row = np.ones(b - a, np.int32)
        deepest = np.full(b - a, model.first[0] + 1, np.int32)
        for k, table in enumerate(model.children, 1):
            row = table[row * size + buffer[a - k : b - k]]
            deepest = np.where(row > 0, model.first[k] + row, deepest)
        bits = model.bits[deepest.astype(np.int64) * size + buffer[a:b]]
        start = np.searchsorted(ends, a, "right")
        for_docs = np.arange(start, len(texts))
        begin = np.maximum(ends[for_docs] - np.array([len(texts[d]) for d in for_docs], np.int64), a)
        stop = np.minimum(ends[for_docs], b)
        has = begin < stop
        if has.any():
            edges = np.ravel(np.column_stack([begin[has] - a, stop[has] - a]))
            if edges[-1] == b - a:
                edges = edges[:-1]
            out[for_docs[has]] += np.add.reduceat(bits, edges, axis=0, dtype=np.float64)[::2]
    return out


def fit(docs: DataFrame, per_lang: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """The sample bounds what comes to the driver: at most its distinct byte grams."""
    grams: dict[str, list] = {}
    for r in gram_counts(sample(docs, per_lang, id_col, text_col, lang_col), ORDER).toLocalIterator():
        grams.setdefault(r.lang, []).append((r.gram, r.n))
    return learn({k: tuple(np.array(v, np.int64).T) for k, v in grams.items()}) if grams else None


def labelled(model: Model | None, texts: list[str]) -> list[tuple[str, float, float | None]]:
    """(language, score, bits per byte) of each text."""
    out: list[tuple[str, float, float | None]] = [("und", 0.0, None)] * len(texts)
    known = [k for k, t in enumerate(texts) if LETTER.search(t)] if model else []
    if known:
        data = [texts[k].encode() for k in known]
        bits = lengths(model, data)
        for k, d, row, j in zip(known, data, bits, bits.argmin(1)):
            out[k] = (model.langs[j], float(1 / np.exp2(np.maximum(row[j] - row, -1000)).sum()), float(row[j] / len(d)))
    return out


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (posterior of the prediction), bits_per_byte."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        for ids, texts in balanced_with_flag(batches):
            langs, scores, rates = zip(*labelled(held.value, texts))
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in ids], pa.int64()), pa.array([h for _, h in ids], pa.bool_()), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    return rows.mapInArrow(scan, SCHEMA)


def balanced_with_flag(batches):
    """As balanced(), with (id, flag) pairs as ids."""
    pairs = (pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([b.column(0), b.column(2)], ["i", "h"]), b.column(1)], ["id", "text"]) for b in batches)
    for ids, texts in balanced(pairs):
        yield [(x["i"], x["h"]) for x in ids], texts


def without_unknown(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs whose predicted language is not `und`, all columns as they were; if nothing could be learned,
    those with a letter. Nothing is shuffled."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def scan(batches):
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            known = [label != "und" for label, _, _ in labelled(held.value, texts)] if held.value else [LETTER.search(t) is not None for t in texts]
            yield b.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)


def identify(docs: DataFrame, **columns: str) -> DataFrame:
    return predict(docs, fit(docs, **columns), **{k: v for k, v in columns.items() if k != "lang_col"})
