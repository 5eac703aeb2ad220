"""Names in free texts against a scan from left to right, extraction fan-out, outcomes of resolution."""

import json
import random
import re

from gridloom.operators import extraction, grounding, resolve


def plain(text, names, held):
    parts = [p for p in re.split(r"(?<![^\W_])(?=[^\W_])|(?<=[^\W_])(?![^\W_])", text) if p]
    low, out, gone, n, i = [p.lower() for p in parts], [], [], 0, 0
    known = sorted(({"l": [p for p in re.split(r"(?<![^\W_])(?=[^\W_])|(?<=[^\W_])(?![^\W_])", x.lower()) if p], "x": x.lower()} for x in names), key=lambda k: -len(k["l"]))
    while i < len(parts):
        hit = next((k for k in known if low[i : i + len(k["l"])] == k["l"]), None)
        if hit is None:
            out.append(parts[i])
            i += 1
            continue
        n += 1
        if hit["x"] in held:
            out += parts[i : i + len(hit["l"])]
        else:
            gone.append(hit["x"])
        i += len(hit["l"])
    return "".join(out), n, gone


def test_random_texts(spark):
    rng = random.Random(6)
    words = ["dept", "7", "loc", "Haifa", "north", "é", "x"]
    names = sorted({rng.choice(["-", " "]).join(rng.choice(words) for _ in range(rng.randint(1, 4))).lower() for _ in range(25)})
    texts = [("".join(rng.choice(words) + rng.choice([" ", "-", ", ", "  "]) for _ in range(rng.randint(0, 25)))).upper() if k % 2 else " ".join(rng.choice(words) for _ in range(20)) for k in range(60)]
    held = {k: set(rng.sample(names, 5)) for k in range(60)}
    r = spark.createDataFrame(list(enumerate(texts)) + [(99, None), (100, "")], "report long, text string")
    d = spark.createDataFrame([(x.upper(),) for x in names] + [(' "dept" ',), ("",), (None,)], "name string")
    got = {x.report: (x.text, x.n_mentions, x.ungrounded) for x in grounding.stripped(r, d, spark.createDataFrame([(k, x.title()) for k, v in held.items() for x in v], "report long, name string")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == plain(t, {*names, "dept"}, held[k]), t
    assert got[99] == (None, 0, []) and got[100] == ("", 0, [])
    assert sum(n for _, n, _ in got.values()) > 100


def test_longest_name_wins_and_borders_hold(spark):
    r = spark.createDataFrame([(1, "Ask DEPT-31 or dept-3; the loc-7 North gate, loc-7x.")], "report long, text string")
    d = spark.createDataFrame([("DEPT-3",), ("LOC-7",), ("loc-7 north",)], "name string")
    row = grounding.stripped(r, d, spark.createDataFrame([(1, "Loc-7")], "report long, name string")).first()
    assert (row.text, row.n_mentions, row.ungrounded) == ("Ask DEPT-31 or ; the  gate, loc-7x.", 2, ["dept-3", "loc-7 north"])


def test_fan_out_counts_what_its_tables_hold(spark):
    records = [
        {"concepts": [{"name": "A", "terms": ["a", "A", " ", None]}, {"name": " ", "terms": ["first", "x"]}, {"terms": []}], "relationships": [{"src": "A", "dst": "B", "type": "part of"}]},
        {"concepts": None, "data_mappings": [{"concept": "A", "qualified_name": "db.s.t"}, {"concept": "A", "qualified_name": "t"}]},
        {},
    ]
    raw = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)] + [(8, "{"), (9, None)], "id long, value string")
    tables, counters = extraction.fan_out(raw, "id")
    assert {k: tables[k].count() for k in tables} == {k: counters[k] for k in tables} == {"concepts": 2, "terms": 4, "relations": 1, "mappings": 2}
    assert counters["records"] == 5 and counters["broken"] == 1
    assert sorted((r.concept, r.surface_form, r.official) for r in tables["terms"].collect()) == [("A", "A", True), ("A", "a", False), ("first", "first", True), ("first", "x", False)]
    assert sorted(r.asset_name for r in tables["mappings"].collect()) == ["t", "t"]
    none, zero = extraction.fan_out(raw.limit(0), "id")
    assert none["concepts"].count() == 0 and set(zero.values()) == {0}


def test_outcomes_are_disjoint(spark):
    known = spark.createDataFrame([("operations center a", "A"), ("operations center b", "B"), ("depot", "D"), ("depot", "E"), ("gate house", "G")], "norm string, concept_id string")
    said = spark.createDataFrame([(1, "operations center a"), (2, "depot"), (3, "gate houze"), (4, "unknown"), (5, None), (6, "gate house")], "id long, norm string")
    assert {r.id: (r.n_candidates, r.outcome) for r in resolve.outcomes(said, known).collect()} == {1: (2, "ambiguous"), 2: (2, "ambiguous"), 3: (1, "matched"), 4: (0, "new"), 5: (0, "new"), 6: (1, "matched")}
    exact = {r.id: r.outcome for r in resolve.outcomes(said, known, threshold=None).collect()}
    assert exact == {1: "matched", 2: "ambiguous", 3: "new", 4: "new", 5: "new", 6: "matched"}
