"""The stages of the pipeline, each against a plain version of what it has to do, and run() as a whole."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import language_id, line_dedup, near_dedup, toxicity
from tests.llm.helpers import CASES

DATA = os.environ.get("TEST_DATA_DIR", "/root/testdata")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory, spark):
    """Documents with the special cases, copies, near copies, a frequent line and insults; all columns have nulls."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(2)
    vocabulary = ["river", "stone", "garden", "winter", "letter", "music", "paper", "window", "harbour", "teacher", "street", "morning"]
    rows, labels = [], []
    for k in range(100, 400):
        words = [rng.choice(vocabulary) for _ in range(60)]
        if toxic := k % 5 == 1:
            words[rng.randrange(60)] = rng.choice(["dumbface", "dumbface", "dumbf4ce", "d u m b f a c e"])
        text = " ".join(words) + ("\nSubscribe to our newsletter" if k % 3 == 0 else "")
        rows.append((k, text, "en", "web", len(text)))
        labels.append((k, 1, int(toxic)))
    for k in range(20):
        old = rows[3 * k + 2]
        words = old[1].split()
        words[7] = "changed"
        rows.append((1000 + k, " ".join(words), None, None, None))
    rows += [(i, t, lang, kept, n) for i, t, lang, kept, n in CASES]
    spark.createDataFrame(rows, COLUMNS).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels + [(None, None, 1), (5, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def docs_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bag(rows):
    return Counter(map(tuple, rows))


def test_toxic_documents_go(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = STAGES["toxicity"](spark, docs, sf_dir)
    assert out.columns == docs.columns
    scorer = toxicity.Scorer(toxicity.fit(docs, labels))
    assert bag(out.collect()) == bag(r for r in docs.collect() if scorer.score(r.text or "")[0] < 0.5)
    kept = {r.doc_id for r in out.collect()}
    assert not any(k in kept for k in range(100, 400) if k % 5 == 1) and all(k in kept for k in range(100, 400) if k % 5 != 1)


def test_documents_without_a_language_go(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    out = STAGES["language_id"](spark, docs, sf_dir)
    assert bag(out.collect()) == bag(r for r in docs.collect() if any(c.isalpha() for c in r.text or ""))
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = STAGES["language_id"](spark, unlabelled, sf_dir)
    assert kept.count() == out.count()  # nothing can be learned: documents with letters stay


def test_frequent_lines_go(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for r in docs.collect():
        for x in (r.text or "").split("\n"):
            holders[key(x)].add(r.doc_id)
    want = []
    for r in docs.collect():
        rest = [x for x in (r.text or "").split("\n") if not key(x) or len(holders[key(x)]) < 10]
        text = None if r.text is None else "\n".join(rest)
        want.append((r.doc_id, text, r.lang, r.source, None if text is None else len(text)))
    assert bag(STAGES["line_dedup"](spark, docs, sf_dir).collect()) == bag(want)


def test_one_of_each_class_stays(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    out = STAGES["near_dedup"](spark, docs, sf_dir).collect()
    rows = docs.collect()
    h = near_dedup.Hasher()
    hashes = [h.hashes(h.words(r.text or "")) for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(rows):
        for j in range(i):
            same = hashes[i].tolist() == hashes[j].tolist() if len(hashes[i]) else (a.text or "") == (rows[j].text or "")
            if find(i) != find(j) and (same or near_dedup.similar(hashes[i], hashes[j])):
                root[find(i)] = find(j)
    classes = defaultdict(list)
    for k, r in enumerate(rows):
        classes[find(k)].append(r)
    assert len(out) == len(classes)
    first = {min((r.doc_id is None, r.doc_id or 0) for r in c) for c in classes.values()}
    assert {(r.doc_id is None, r.doc_id or 0) for r in out} == first


def test_packing_holds_every_token_once(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in docs.collect():
        want[r.doc_id] += len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1
    got, sizes = Counter(), Counter()
    for r in STAGES["packing"](spark, docs, sf_dir).collect():
        got[r.doc_id] += r.length
        sizes[r.sequence_id] += r.length
    assert got == want and all(n <= 2048 and n & (n - 1) == 0 for n in sizes.values())


def test_run_is_its_stages_in_order(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), COLUMNS)
    want = Counter()
    for r in STAGES["packing"](spark, docs, sf_dir).collect():
        want[r.doc_id] += r.length
    got = Counter()
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got[r.doc_id] += r.length
    assert got == want and 0 < len(want) < 300


def test_stages_take_empty_tables_and_other_columns(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, docs.limit(0), sf_dir)
        assert none.count() == 0 and none.columns == docs.columns, name
        clash = docs.withColumns({c: F.lit(1) for c in ("h1", "node", "text_hash", "row", "gone", "size", "kept_id", "hash", "score", "toxic")})
        out = stage(spark, clash, sf_dir)
        assert out.columns == clash.columns and bag(out.select(docs.columns).collect()) == bag(stage(spark, docs, sf_dir).collect()), name
    assert STAGES["packing"](spark, docs.limit(0), sf_dir).count() == 0
