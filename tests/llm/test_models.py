import os
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import language_id, toxicity
from tests.llm.helpers import CASES, cases, empty

DATA = os.environ.get("TEST_DATA_DIR", "/root/testdata")

FIXTURE = f"{DATA}/sf0.01"


def plain_code_length(trees, langs, text, symbols, order):
    """Method C with exclusion, straight from counts: contexts as byte strings. Contexts as in the model's table."""
    data = bytes(order) + text
    total = 0.0
    for i in range(order, len(data)):
        excluded, escape, p = set(), 1.0, None
        for k in range(order, -1, -1):
            counts = trees.get(data[i - k : i])
            if counts is None:
                continue
            left = {s: n for s, n in counts.items() if s not in excluded}
            n, d = sum(left.values()), len(left)
            if data[i] in left:
                p = escape * left[data[i]] / (n + d)
                break
            if n:
                escape *= d / (n + d)
            excluded |= set(left)
        if p is None:
            p = escape / (symbols - len(excluded))
        total -= np.log2(p)
    return total


def test_code_lengths_equal_plain_ppm():
    texts = {"a": [b"abracadabra abra", b"banana"], "b": [b"xyzzy plugh", b"cocoa banana xyz"]}
    order = 3
    grams = {}
    for lang, ts in texts.items():
        c = Counter()
        for t in ts:
            d = bytes(order) + t
            for i in range(order, len(d)):
                c[int.from_bytes(d[i - order : i + 1], "big")] += 1
        grams[lang] = tuple(np.array(sorted(c.items()), np.int64).T)
    model = language_id.learn(grams, order, min_count=1)
    used = {b for ts in texts.values() for t in ts for b in bytes(order) + t}
    for j, lang in enumerate(model.langs):
        trees = defaultdict(Counter)
        for t in texts[lang]:
            d = bytes(order) + t
            for i in range(order, len(d)):
                for k in range(order + 1):
                    trees[d[i - k : i]][d[i]] += 1
        for t in (b"banana", b"abracadabra", b"xyz", b"dab co"):
            want = plain_code_length(trees, model.langs, t, len(used) + 1, order)
            got = language_id.lengths(model, [b"zz", t, b""])[1, j]
            assert abs(want - got) < 1e-3 * len(t)


def test_languages_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FIXTURE}/documents.parquet")
    out = language_id.identify(docs)
    rows = out.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert sum(held) / len(held) >= 0.98


def test_languages_special_rows(spark):
    rows = {r.doc_id: r for r in language_id.identify(cases(spark)).collect()}
    assert rows[2].lang_pred == rows[3].lang_pred == "und" and rows[1].lang_pred in {"en", "de", "fr"}
    assert language_id.identify(cases(spark)).count() == len(CASES)
    assert language_id.identify(empty(spark)).count() == 0
    unlabelled = cases(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(unlabelled).collect()} == {"und"}


def test_toxicity_held_out(spark):
    d = f"{DATA}/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.score(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    said = [r.toxic for r in rows if r.predicted]
    clean = [r.predicted for r in rows if not r.toxic]
    assert sum(said) / len(said) >= 0.9 and sum(clean) / len(clean) <= 0.01
    assert sum(said) / sum(r.toxic for r in rows) >= 0.6


def test_viterbi_restores_disguised_words():
    counts = np.zeros((toxicity.N,) * 3)
    for word, n in {"idiot": 50, "stupid": 50, "loser": 50, "clown": 50, "the": 200, "book": 100, "trash": 40}.items():
        c = toxicity.codes(f"  {word} ")
        for x in zip(c, c[1:], c[2:]):
            counts[x] += n
    r = toxicity.Restorer(toxicity.trigram_bits(counts))
    text = "the 1d10t and st00pid, l0s3r! c l o w n xx trrrash booook"
    assert set(r.words(text)) >= {"idiot", "loser", "clown", "trash", "book"}
    assert r.words("call 555 on 45.114.23.72 or see the book") == []


def test_every_kind_of_disguise_is_restored():
    counts = np.zeros((toxicity.N,) * 3)
    for word, n in {"idiot": 50, "stupid": 50, "ass": 50, "the": 200, "book": 100, "letter": 100, "see": 100}.items():
        c = toxicity.codes(f"  {word} ")
        for x in zip(c, c[1:], c[2:]):
            counts[x] += n
    r = toxicity.Restorer(toxicity.trigram_bits(counts))
    for word in ("1diot", "!diot", "id1ot", "idi0t", "idio7", "idiiot", "i/d/i/o/t", "i*d*i*o*t", "i  d  i  o  t", "i.d.1.o.t", "i--d--i--o--t", "id*iot"):
        assert "idiot" in r.words(f"the {word}, book"), word
    for word in ("stuupid", "s7upid", "5tupid", "stupi|d"):
        assert r.words(f"the {word} book!") == ["stupid"], word
    for word in ("a$$", "a55", "@$s", "@ss"):
        assert r.words(f"({word}) the") == ["ass"], word
    assert r.words("(see the letter!) 1, 2, 3 the book") == []


def test_toxicity_special_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (8, None, 1), (None, 1, 1), (1, 0, 1)], "doc_id long, toxic int, text int")
    rows = toxicity.score(cases(spark), labels).collect()
    assert len(rows) == len(CASES) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty(spark), labels).count() == 0
    assert toxicity.score(cases(spark), labels.limit(0)).filter("predicted = 1").count() == 0


def test_scores_equal_a_plain_decision_list(spark):
    """Every word read by a full search over all its readings, every gram looked up in the list: no tasks, no caches."""
    d = f"{FIXTURE}"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").limit(300), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.predict(docs, model).collect()}
    for r in docs.collect():
        words = toxicity.all_words(r.text or "", toxicity.Restorer(model.bits))[0]
        best = max([model.limits.get(f" {w} "[k : k + toxicity.GRAM], 0.0) for w in words for k in range(len(w) - 2)], default=0.0)
        want = max(best, model.base)
        assert got[r.doc_id] == (want, int(want >= 0.5))


def test_viterbi_equals_search_over_all_readings():
    import itertools

    rng = np.random.default_rng(1)
    bits = toxicity.trigram_bits(rng.integers(0, 50, (toxicity.N,) * 3).astype(float))
    for token in ("1d10t", "a$$", "st00pid", "booook", "@ss", "l0ser"):
        steps = toxicity.lattice(token)
        best = None
        for reading in itertools.product(*steps):
            word = "".join(x for x, _ in reading)
            c = toxicity.codes(f"  {word} ")
            cost = sum(e for _, e in reading) + float(bits[c[:-2], c[1:-1], c[2:]].sum())
            best = min(best or (cost, word), (cost, word))
        got = toxicity.viterbi(token, bits)
        c = toxicity.codes(f"  {got} ")
        assert got == best[1] or abs(best[0] - min(sum(e for _, e in r) + float(bits[c[:-2], c[1:-1], c[2:]].sum()) for r in itertools.product(*steps) if "".join(x for x, _ in r) == got)) < 1e-3


def test_pieces_read_as_the_whole_text_and_once(monkeypatch):
    """Readings of pieces against readings of whole texts; a piece that occurs often is read once."""
    rng = np.random.default_rng(5)
    bits = toxicity.trigram_bits(rng.integers(0, 50, (toxicity.N,) * 3).astype(float))
    r, across = toxicity.Restorer(bits), 0
    for letters in ("ab1!.-_ \n2é", "ab. ", "a b c-d_1 \t,x$ 9", "lo0s5er  .!*"):
        for n in rng.integers(0, 30, 1500):
            text = "".join(rng.choice(list(letters), n))
            whole = r.words(text)
            want = set(toxicity.WORD.findall(text)) | {w for x in whole for w in toxicity.WORD.findall(x)}
            assert toxicity.all_words(text, r) == (want, len(whole)), text
            across += any(" " in p for p in r.pieces(text))
    assert across > 100
    for word in ("letter", "aabb", "xaa", "aa", "booksee"):
        assert not r.stays(word) or toxicity.viterbi(word, bits) == word
    asked, words = [], toxicity.Restorer.words
    monkeypatch.setattr(toxicity.Restorer, "words", lambda self, text: asked.append(len(text)) or words(self, text))
    scorer = toxicity.Scorer(toxicity.Model(bits))
    assert scorer.score("the letter l0ser " * 1000)[1] >= 1000
    assert sum(asked) < 100
