import random

from pyspark.sql import functions as F

import random

from gridloom.functions import text as fn
from gridloom.operators import hierarchy, records
from gridloom.streaming import messages


def test_list_values_are_trimmed(spark):
    got = spark.createDataFrame([(" a0, 1b ,\n,c2\n d ",)], "x string").select(fn.split_list(F.col("x")).alias("y")).first().y
    assert got == ["a0", "1b", "c2", "d"]


def test_replacements_with_chains_and_cycles(spark):
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("p", "q"), ("q", "r"), ("r", "p"), ("s", "p"), ("x", "x"), ("y", None)]
    got = {r.id: r.final_id for r in hierarchy.replacements(spark.createDataFrame(links, "id string, next_id string")).collect()}
    assert got == {"a": "d", "b": "d", "c": "d", "p": "p", "q": "q", "r": "r", "s": "s"}
    assert hierarchy.replacements(spark.createDataFrame([], "id string, next_id string")).count() == 0


def test_review_decisions(spark):
    edges = spark.createDataFrame([("a", "z", 0.3), ("b", "z", 0.9), ("a", "b", 0.5), ("z", "bad", 0.5)], "src string, dst string, confidence double")
    decisions = spark.createDataFrame([("a", "MERGE", "b"), ("bad", "REJECT", None), ("z", "APPROVE", None)], "id string, resolution string, target_id string")
    assert {tuple(r) for r in records.decided_edges(edges, decisions).collect()} == {("b", "z", 0.9)}
    nodes = spark.createDataFrame([("a",), ("b",), ("z",), ("bad",)], "id string")
    assert {tuple(r) for r in records.decided_nodes(nodes, decisions).collect()} == {("b", "PENDING"), ("z", "APPROVED")}


def test_sections(spark):
    body = "x" * 60
    pages = [f"1. First\n{body}", f"{body}\n2. Second\nshort", f"{'y' * 100}\n{'z' * 1500}", "tail of it"]
    docs = spark.createDataFrame([(1, pages), (2, None), (3, ["too short"]), (None, [])], "doc long, pages array<string>")
    got = [tuple(r) for r in records.sections(docs, "doc", F.col("pages")).orderBy("doc", "n").collect()]
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in got] == [(1, 0, "1. First", 0, 1), (1, 1, "2. Second", 1, 2), (1, 2, "2. Second", 2, 3)]
    assert got[0][5] == f"1. First\n{body}\n{body}"
    assert got[2][5] == "z" * 200 + "\ntail of it"


def test_refresh_of_some_ancestors_equals_a_new_closure(spark):
    make = lambda pairs: spark.createDataFrame([(a, b, "SUBCLASS_OF") for a, b in pairs], "child_id string, parent_id string, relation string")
    old, new = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], [("a", "b"), ("b", "y"), ("c", "d"), ("x", "y")]
    changed = spark.createDataFrame([("b",)], "concept_id string")
    got = hierarchy.refreshed(hierarchy.closure(make(old)), make(new), changed)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, hierarchy.closure(make(new)).collect()))


def test_names_coordinates_and_weights(spark):
    row = spark.createDataFrame([(None, " ", None, "", None, ["t"], [])], "name string, name_he string, canonical_name string, description string, description_he string, terms array<string>, domain array<string>")
    r = records.named(row).first()
    assert (r.name, r.description, r.terms, r.domain) == ("t", "", ["t"], ["General"])
    points = spark.createDataFrame([("POINT (34.5 -31)",), ("34.5,-31",), ("x",), (None,)], "p string")
    assert [tuple(x) for x in points.select(*records.coordinates(F.col("p"))).collect()] == [(34.5, -31.0)] * 2 + [(None, None)] * 2
    wide = spark.createDataFrame([("s", "0.5", "HIGH"), ("t", "7", None)], "site string, a string, b string")
    assert {tuple(r) for r in records.effort_edges(wide, "site", ["a", "b"], {"high": 0.9}).collect()} == {("s", "a", 0.5), ("s", "b", 0.9)}


def test_dead_letters_carry_the_error(spark):
    m = spark.createDataFrame([("1", "k", "failed", 3, {"a": "b"}, "t", "e"), ("2", "k", "failed", 1, None, "t", "e"), ("3", "k", "failed", 5, None, "t", "e")], "id string, key string, kind string, retry_count int, payload map<string,string>, topic string, error string")
    got = {r.id: r.payload for r in messages.dead_letters(m).collect()}
    assert got == {"1": {"a": "b", "_topic": "t", "_error": "e", "_retries": "3"}, "3": {"_topic": "t", "_error": "e", "_retries": "5"}}


def plain_chunks(pages, size, overlap, pending, least):
    """(title, first page, last page, text) line by line."""
    lines = [(k, x) for k, p in enumerate(pages or []) for x in p.split("\n")]
    out, parts, length, title, first, page = [], [], 0, None, 0, 0
    flush = lambda: out.append((title, first, page, "\n".join(parts).strip()))
    for k, (p, x) in enumerate(lines):
        if x.startswith("1."):
            if length > pending:
                flush()
                parts, length = [], 0
            title = x.strip()
        if not parts:
            first = p
        page = p
        parts.append(x)
        length += len(x) + 1
        if length >= size and k + 1 < len(lines) and lines[k + 1][0] != p:
            flush()
            parts = ["\n".join(parts)[-overlap:]]
            length, first = len(parts[0]), p
    flush()
    return [c for c in out if len(c[3]) >= least]


def test_random_sections_equal_a_line_by_line_fold(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["a b", "word", "é x", "\x1c", "", "  ", "1. Head", "text" * 9])
    docs = [(k, ["\n".join(word().lower() if rng.random() < 0.9 else "1. Part" for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 6))]) for k in range(80)]
    found = {}
    rows = records.sections(spark.createDataFrame(docs, "doc long, pages array<string>"), "doc", F.col("pages"), size=90, overlap=17, pending=30, least=10)
    for r in rows.orderBy("doc", "n").collect():
        found.setdefault(r.doc, []).append((r.title, r.first_page, r.last_page, r.text))
    for k, pages in docs:
        assert found.get(k, []) == (plain_chunks(pages, 90, 17, 30, 10) if pages else [])
    assert not any(x in rows._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))
