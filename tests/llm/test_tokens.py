import os
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gridloom.llm import bpe_table, packing, token_counts, words
from tests.llm.helpers import CASES, cases, empty

DATA = os.environ.get("TEST_DATA_DIR", "/root/testdata")

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
FIXTURE = f"{DATA}/sf0.001/documents.parquet"


def texts(df):
    return sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=str)


@pytest.mark.parametrize("name", ["cases", "fixture"])
def test_bpe_equals_library(spark, name):
    df = cases(spark) if name == "cases" else spark.read.parquet(FIXTURE)
    tok = Tokenizer.from_file(WORD)
    want = []
    for i, t in texts(df):
        ids = tok.encode(t, add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in bpe_table.encode_digests(df, WORD).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_bpe_ids_and_empty(spark):
    rows = bpe_table.encode_documents(cases(spark), WORD).collect()
    tok = Tokenizer.from_file(WORD)
    assert len(rows) == len(CASES)
    assert {tuple(r.ids) for r in rows if r.doc_id == 1} == {tuple(tok.encode(CASES[0][1], add_special_tokens=False).ids)}
    assert bpe_table.encode_documents(empty(spark), WORD).count() == 0


def test_decode_of_ids_equals_library(spark):
    tok = Tokenizer.from_file(WORD)
    rows = [(k, tok.encode(t or "", add_special_tokens=False).ids) for k, (_, t, *_) in enumerate(CASES)] + [(99, [0, 49406, 49407, 5])]
    got = {r.word: (r.ids, r.decoded) for r in bpe_table.decode(spark.createDataFrame(rows, "word int, ids array<int>"), WORD).collect()}
    assert got == {k: (ids, tok.decode(ids, skip_special_tokens=False)) for k, ids in rows}


@pytest.mark.parametrize("block", [2_000, bpe_table.BLOCK_BYTES])
def test_blocks_and_parts_change_nothing(spark, monkeypatch, block):
    monkeypatch.setattr(bpe_table, "BLOCK_BYTES", block)
    monkeypatch.setattr(bpe_table, "LEAST_PARTS", 3)
    got = {tuple(r) for r in bpe_table.encode_digests(cases(spark).coalesce(2), WORD).collect()}
    monkeypatch.undo()
    assert got == {tuple(r) for r in bpe_table.encode_digests(cases(spark), WORD).collect()}


@pytest.mark.parametrize("name", ["cases", "fixture"])
def test_token_counts_equal_library(spark, name):
    df = cases(spark) if name == "cases" else spark.read.parquet(FIXTURE)
    tok = Tokenizer.from_file(BYTE)
    want = [(i, len(t.encode()), n := len(tok.encode(t, add_special_tokens=False).ids), n > 1024) for i, t in texts(df)]
    assert sorted(map(tuple, token_counts.count_tokens(df, BYTE).collect()), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(empty(spark), BYTE).count() == 0


@pytest.mark.parametrize("pool", [3_000, packing.POOL])
@pytest.mark.parametrize("name", ["cases", "fixture"])
def test_packing_keeps_each_token_once(spark, monkeypatch, name, pool):
    monkeypatch.setattr(packing, "POOL", pool)
    df = cases(spark) if name == "cases" else spark.read.parquet(FIXTURE)
    df = df.dropDuplicates(["doc_id"])
    tok = Tokenizer.from_file(WORD)
    want = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in texts(df)}
    rows = packing.pack_documents(df.coalesce(2), WORD).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids.tobytes()) and r.doc_tokens == len(want[r.doc_id])
        docs[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, ids in want.items():
        at = 0
        for start, length in sorted(docs[i]):
            assert start == at and length > 0
            at += length
        assert at == len(ids)
    sizes = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        sizes.append(at)
    assert all(s & (s - 1) == 0 for s in sizes)
    steps = defaultdict(set)
    for r in rows:
        steps[r.step_group].add(r.sequence_id)
    assert max(map(len, steps.values())) <= packing.STEP
    assert packing.pack_documents(empty(spark), WORD).count() == 0


def some_pieces(seed, n):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(2048, np.maximum(1, rng.lognormal(5.5, 1.1, n).astype(int)))
    return [packing.Piece(k, np.zeros(x, np.uint16), 0, int(x)) for k, x in enumerate(lengths)]


def packed(pieces, tiers):
    by_tier, left = packing.pack_tiers(pieces, tiers)
    for tier, packs in by_tier.items():
        assert all(sum(p.length for p in pack) == tier for pack in packs)
    assert sum(p.length for p in left) < tiers[0]
    got = sorted((p.doc_id, p.start, p.length) for packs in [*by_tier.values(), [left]] for pack in packs for p in pack)
    at = {p.doc_id: 0 for p in pieces}
    for doc, start, length in got:
        assert start == at[doc] and length > 0
        at[doc] += length
    assert at == {p.doc_id: p.length for p in pieces}
    return by_tier


def test_tiers_change_the_packing():
    by_tier = packed(some_pieces(1, 3000), packing.TIERS)
    assert all(len(by_tier[t]) > 20 for t in packing.TIERS)
    one = packed(some_pieces(1, 3000), (2048,))
    assert len(one[2048]) > len(by_tier[2048])
    # long windows hold long pieces and, in their gaps, pieces of shorter tiers; most pieces are never cut
    kinds = {packing.tier_of(p.length, packing.TIERS) for pack in by_tier[2048] for p in pack}
    assert kinds == set(packing.TIERS)
    assert sum(len(pack) for packs in by_tier.values() for pack in packs) < 1.35 * 3000
    assert sum(len(pack) for pack in by_tier[256]) / len(by_tier[256]) < 5


def test_best_fit_equals_plain_search():
    pieces = some_pieces(2, 300)
    got, _ = packing.best_fit(pieces, 2048)
    plain = []
    for p in sorted(pieces, key=lambda p: -p.length):
        room = [x for x in plain if sum(x) + p.length <= 2048]
        if room:
            max(room, key=sum).append(p.length)
        else:
            plain.append([p.length])
    assert sorted(sum(p.length for p in pack) for pack in got) == sorted(map(sum, plain))


def test_step_groups_are_of_one_tier_and_balanced(spark):
    rows = packing.pack_documents(spark.read.parquet(FIXTURE).coalesce(1), WORD).collect()
    tiers, cost = defaultdict(set), defaultdict(int)
    for r in rows:
        tiers[r.step_group].add(r.window)
        cost[r.window, r.step_group] += r.length**2
    assert all(len(t) == 1 for t in tiers.values())
    own = [c for (w, _), c in cost.items() if w == 2048]
    assert max(own) < 2 * min(own) or len(own) < 3


def test_batches_are_balanced_by_bytes():
    texts = ["ä" * 300, None, "x" * 5000, "", "y" * 100] * 40
    table = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], ["id", "text"])
    groups = list(words.balanced([table, table.slice(0, 0), table], 2000))
    assert [i for ids, _ in groups for i in ids] == [*range(200)] * 2
    assert [t for _, ts in groups for t in ts] == [t or "" for t in texts] * 2
    sizes = [[len(t.encode()) for t in ts] for _, ts in groups]
    assert all(sum(s) >= 2000 and sum(s[:-1]) < 2000 for s in sizes[:-1])


def test_long_texts_are_cut_where_no_token_crosses(monkeypatch):
    tok = words.tokenizer(BYTE)
    text = "".join(f"it's  {k} wörds,\n\tof <|endoftext|> text " for k in range(2000))
    monkeypatch.setattr(words.chunks, "__defaults__", (500,))
    assert len(list(words.chunks(text))) > 50
    assert token_counts.lengths(tok, [text, "", "a b"]) == [len(tok.encode(t, add_special_tokens=False).ids) for t in (text, "", "a b")]
