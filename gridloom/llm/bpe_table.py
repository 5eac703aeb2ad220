"""BPE encoding through a table of distinct words, and decoding through an id-to-piece join.

1. Split: each task splits its documents into words and numbers the distinct words of a block of documents, the most
   common first. A block leaves as one row with the documents' words by number, and one row for each part of the word
   range (by the word's checksum) with the block's distinct words in it. Both are compressed.
2. Encode: the word rows are dealt out by part, so all that is said of a word meets in one place, where it is encoded
   once for the whole input. A block names a word once, so no word is hot, however common it is. The number of parts
   follows the size of the texts.
3. Join back: ids return to their block by word number and are put in the documents' places by position.
4. Decode: each block is joined to the vocabulary's pieces in order of id, whose number the tokenizer file fixes, so they
   are broadcast; the ids of the block's words select their pieces. `decode` is the same join for any table of ids.

Texts move only as word numbers. A task holds a block of documents, or the distinct words of one part. Defined results: a
null text is the empty text, with no ids and the empty decoded text. Null and repeated ids pass through, one row per input
row; an empty input gives an empty result. Other columns are not read. A document is never split over blocks.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.shared import cut
from gridloom.llm.words import NOT_PLAIN, WORD, balanced, chunks, tokenizer

#: Bytes of text in a block.
BLOCK_BYTES = 48 << 20
#: Bytes of text whose distinct words make a part, and the fewest parts.
PART_BYTES, LEAST_PARTS = 128 << 20, 32
SPLIT = "block long, part int, words binary, nums binary, docs binary"
IDS = "block long, nums binary, sizes binary, ids binary"


class Splitter:
    """Words of whole texts, as the tokenizer's normaliser and word pattern give them."""

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def words(self, text: str) -> Iterator[str]:
        has_special = any(s in text for s in self.special)
        for part in self.cut.split(text) if has_special else [text]:
            if has_special and part in self.special:
                yield part
            elif NOT_PLAIN.search(part):
                norm = self.tok.normalizer.normalize_str(part)
                for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(norm):
                    yield norm[a:b]
            else:
                for c in chunks(part):
                    yield from WORD.findall(c.lower())


class Block:
    """Documents of one block: ids, their numbers of words, and the words' numbers one after the other."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids, self.sizes, self.positions, self.held = [], [], [], 0

    def add(self, doc_id, words: Iterator[str], size: int) -> None:
        number = self.number
        at = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint32)
        self.ids.append(doc_id)
        self.sizes.append(len(at))
        self.positions.append(at)
        self.held += size

    def rows(self, block: int, parts: int) -> Iterator[pa.RecordBatch]:
        words = list(self.number)
        positions = np.concatenate(self.positions) if self.positions else np.zeros(0, np.uint32)
        order = np.argsort(-np.bincount(positions, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), "<u4")
        rank[order] = np.arange(len(words))
        table = pa.table({"doc_id": pa.array(self.ids, pa.int64()), "n": pa.array(self.sizes, pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        head = packed(sink.getvalue().to_pybytes())
        # bytes of the numbers by significance: the high ones are mostly zero, so they compress well
        body = packed(rank[positions].view(np.uint8).reshape(-1, 4).T.tobytes())
        yield batch(SPLIT, [(block, None, None, None, len(head).to_bytes(8, "little") + head + body)])
        by_part: list[list[str]] = [[] for _ in range(parts)]
        for w in words:
            by_part[zlib.crc32(w.encode()) % parts].append(w)
        number = self.number
        for part, own in enumerate(by_part):
            if own:
                own.sort()
                nums = rank[[number[w] for w in own]]
                yield batch(SPLIT, [(block, part, packed("\n".join(own).encode()), packed(nums.view(np.uint8).reshape(-1, 4).T.tobytes()), None)])


def packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 6).compress(data, asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpacked(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def documents_of(docs: bytes) -> tuple[list, list[int], np.ndarray]:
    n = int.from_bytes(docs[:8], "little")
    table = pa.ipc.open_stream(unpacked(docs[8 : 8 + n])).read_all()
    return table["doc_id"].to_pylist(), table["n"].to_pylist(), numbers(docs[8 + n :])


def batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


def split_words(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, parts: int) -> DataFrame:
    def scan(batches):
        splitter, block, n = Splitter(tokenizer_path), Block(), TaskContext.get().partitionId() << 32
        for ids, texts in balanced(batches):
            for doc_id, text in zip(ids, texts, strict=True):
                block.add(doc_id, splitter.words(text), len(text))
            if block.held >= BLOCK_BYTES:
                yield from block.rows(n, parts)
                block, n = Block(), n + 1
        if block.ids:
            yield from block.rows(n, parts)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(scan, SPLIT)


class WordTable:
    """Ids of words, without the tokenizer's normaliser: words are normalised already."""

    def __init__(self, path: str):
        from tokenizers import normalizers

        self.tok = tokenizer(path)
        self.tok.normalizer = normalizers.Sequence([])
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        self.ends[[i for w, i in self.tok.get_vocab().items() if w.endswith("</w>")]] = True

    def encode(self, words: list[str]) -> list[np.ndarray]:
        out = []
        for k in range(0, len(words), 20_000):
            some = words[k : k + 20_000]
            ids = np.array(self.tok.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                out += np.split(ids, cuts[:-1])
            else:  # a special token, or a word without a marked end
                out += [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(some, add_special_tokens=False)]
        return out


def encode_words(words: DataFrame, tokenizer_path: str, parts: int) -> DataFrame:
    """The ids of the words of each row, for its block. Rows come sorted by part within their partition."""

    def scan(batches):
        table = WordTable(tokenizer_path)

        def coded(rows):
            lists = [unpacked(w).decode().split("\n") for _, w, _ in rows]
            distinct = sorted(set().union(*lists))
            ids = dict(zip(distinct, table.encode(distinct)))
            for (block, _, nums), own in zip(rows, lists):
                got = [ids[w] for w in own]
                sizes, flat = np.fromiter(map(len, got), "<u4", len(got)), np.concatenate(got)
                yield batch(IDS, [(block, nums, packed(sizes.view(np.uint8).reshape(-1, 4).T.tobytes()), packed(flat.view(np.uint8).reshape(-1, 4).T.tobytes()))])

        part, rows = None, []
        for b in batches:
            for block, p, w, nums in zip(*(c.to_pylist() for c in b.columns)):
                if p != part and rows:
                    yield from coded(rows)
                    rows = []
                part = p
                rows.append((block, w, nums))
        if rows:
            yield from coded(rows)

    return words.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(scan, IDS)


def vocabulary(spark: SparkSession, tokenizer_path: str) -> DataFrame:
    """(id, piece): as many rows as the tokenizer file has tokens."""
    tok = tokenizer(tokenizer_path)
    return spark.createDataFrame(pa.table({"id": pa.array(range(tok.get_vocab_size()), pa.int32()), "piece": [tok.id_to_token(i) for i in range(tok.get_vocab_size())]}))


def decode(rows: DataFrame, tokenizer_path: str, key: str = "word") -> DataFrame:
    """(key, ids, decoded) of rows (key, ids) with distinct keys: the pieces of the ids in order, joined by one space."""
    each = rows.select(key, F.posexplode("ids").alias("pos", "id"))
    pieces = each.join(F.broadcast(vocabulary(rows.sparkSession, tokenizer_path)), "id").select(key, "pos", "id", "piece")
    in_order = F.array_sort(F.collect_list(F.struct("pos", "id", "piece")))
    found = pieces.groupBy(key).agg(in_order.alias("x")).select(key, F.col("x.id").alias("ids"), F.array_join("x.piece", " ").alias("decoded"))
    none = rows.filter(F.size("ids") == 0).select(key, "ids", F.lit("").alias("decoded"))
    return found.unionByName(none)


def assemble(split: DataFrame, ids: DataFrame, schema: str, result) -> DataFrame:
    """result(doc_ids, encoded, decoded) makes an Arrow table of `schema` from lists: ids of each document's words as
    decimal text, and their pieces, each joined by one space. split: document rows with the vocabulary's pieces."""

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        piece = left["pieces"][0].as_py()
        text: dict[int, str] = {}
        decoded: dict[int, str] = {}
        for nums, sizes, ids in zip(right["nums"].to_pylist(), right["sizes"].to_pylist(), right["ids"].to_pylist()):
            at, got = 0, numbers(ids).tolist()
            for num, n in zip(numbers(nums).tolist(), numbers(sizes).tolist()):
                own = got[at : at + n]
                at += n
                text[num] = " ".join(map(str, own))
                decoded[num] = " ".join([piece[i] for i in own])
        tables = []
        for docs in left["docs"].to_pylist():
            names, sizes, positions = documents_of(docs)
            at, part_ids, part_encoded, part_decoded = 0, [], [], []
            for name, n in zip(names, sizes):
                own = positions[at : at + n].tolist()
                at += n
                part_ids.append(name)
                part_encoded.append(" ".join(filter(None, map(text.__getitem__, own))))
                part_decoded.append(" ".join(filter(None, map(decoded.__getitem__, own))))
                if len(part_ids) == 256:
                    tables.append(result(part_ids, part_encoded, part_decoded))
                    part_ids, part_encoded, part_decoded = [], [], []
            tables.append(result(part_ids, part_encoded, part_decoded))
        return pa.concat_tables(tables)

    return split.groupBy("block").cogroup(ids.groupBy("of_block")).applyInArrow(join, schema)


def _run(docs: DataFrame, tokenizer_path: str, schema: str, result, id_col: str, text_col: str) -> DataFrame:
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(LEAST_PARTS, size // PART_BYTES)
    split = cut(split_words(docs, tokenizer_path, id_col, text_col, parts), "bpe-words")
    ids = encode_words(split.filter("part IS NOT NULL").select("block", "part", "words", "nums"), tokenizer_path, parts)
    in_order = F.array_sort(F.collect_list(F.struct("id", "piece")))["piece"]
    pieces = vocabulary(docs.sparkSession, tokenizer_path).agg(in_order.alias("pieces")).withColumn("all", F.lit(True))
    blocks = split.filter("part IS NULL").select("block", "docs", F.lit(True).alias("all"))
    return assemble(blocks.join(F.broadcast(pieces), "all"), ids.withColumnRenamed("block", "of_block"), schema, result)


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (array of int), decoded."""

    def result(names, encoded, decoded):
        ids = [[int(x) for x in e.split()] for e in encoded]
        return pa.table({"doc_id": pa.array(names, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())})

    return _run(docs, tokenizer_path, "doc_id long, ids array<int>, decoded string", result, id_col, text_col)


def encode_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, taken where the ids and the text are put together."""

    def hexes(texts):
        return pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())

    def result(names, encoded, decoded):
        n = [e.count(" ") + 1 if e else 0 for e in encoded]
        return pa.table({"doc_id": pa.array(names, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": hexes(encoded), "decoded_sha256": hexes(decoded)})

    return _run(docs, tokenizer_path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", result, id_col, text_col)
