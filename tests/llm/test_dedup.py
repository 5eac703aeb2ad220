import hashlib
import re
from collections import Counter, defaultdict

from gridloom.llm import exact_dedup, line_dedup
from tests.llm.helpers import CASES, DOCS, cases, empty


def test_exact_dedup_against_brute_force(spark):
    rows = exact_dedup.DigestIndex(spark, "ix_brute", 4).add(cases(spark)).collect()
    sha = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    groups = defaultdict(list)
    for i, t, *_ in CASES:
        groups[sha(t)].append(i)
    keep = {h: min((i for i in g if i is not None), default=None) for h, g in groups.items()}
    want = [(i, keep[sha(t)], len(groups[sha(t)]), i == keep[sha(t)], sha(t)) for i, t, *_ in CASES]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_dedup_in_batches_against_brute_force(spark):
    sha = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    data = [(i, t) for i, t, *_ in CASES] + [(k, f"t{k % 7}") for k in range(100, 160)] + [(None, "only null"), (None, None)]
    groups = defaultdict(list)
    for i, t in data:
        groups[sha(t)].append(i)
    keep = {h: min((i for i in g if i is not None), default=None) for h, g in groups.items()}
    want = sorted(((i, keep[sha(t)], len(groups[sha(t)]), i == keep[sha(t)], sha(t)) for i, t in data), key=str)
    tables = len(spark.catalog.listTables())
    for batches in (1, 2, 5):
        got = exact_dedup.dedup(spark.createDataFrame(data, "doc_id long, text string"), batches).collect()
        assert sorted(map(tuple, got), key=str) == want
    assert len(spark.catalog.listTables()) == tables
    assert exact_dedup.dedup(empty(spark)).count() == 0


def test_a_batch_that_runs_again_gives_the_same(spark):
    index = exact_dedup.DigestIndex(spark, "ix_again", 4)
    index.add(spark.createDataFrame([(1, "a b", "", "", 0)], DOCS), "first")
    second = spark.createDataFrame([(3, "a  b", "", "", 0), (4, "d", "", "", 0)], DOCS)
    once, again = (sorted(map(tuple, index.add(second, "second").collect())) for _ in range(2))
    assert once == again and [r[3] for r in again] == [False, True]
    assert index.read().count() == 2


def test_anti_join_is_a_merge_without_shuffle_of_the_index(spark):
    index = exact_dedup.DigestIndex(spark, "ix_merge", 4)
    index.add(spark.createDataFrame([(1, "a b", "", "", 0)], DOCS))
    groups = exact_dedup.grouped(exact_dedup.digests(spark.createDataFrame([(2, "c", "", "", 0)], DOCS)))
    plan = index.unseen(groups, "x")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    side = plan[plan.index("LeftAnti"):]
    assert side.count("Exchange") == 1  # the new data only


def test_long_text_loses_its_lines(spark):
    lines = [f"own {k}" if k % 2 else "common" for k in range(200_000)]
    data = [(0, "\n".join(lines))] + [(k, "common") for k in range(1, 12)]
    got = {r.doc_id: r for r in line_dedup.drop_frequent_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[0].kept_text == "\n".join(lines[1::2]) and got[0].n_dropped == 100_000 and got[1].kept_text == ""


def test_index_persists_and_drops_known_texts(spark):
    index = exact_dedup.DigestIndex(spark, "ix_persist", 4)
    index.add(spark.createDataFrame([(1, "a b", "", "", 0), (2, "c", "", "", 0)], DOCS))
    again = {r.doc_id: r for r in index.add(spark.createDataFrame([(3, "a  b", "", "", 0), (4, "d", "", "", 0), (5, "d", "", "", 0)], DOCS)).collect()}
    assert (again[3].keep_id, again[3].kept) == (1, False)
    assert (again[4].keep_id, again[4].kept) == (4, True) and not again[5].kept
    assert index.read().count() == 3
    assert index.add(empty(spark)).count() == 0 and index.read().count() == 3
    plan = spark.table("ix_persist")._jdf.queryExecution().toString()
    assert "ix_persist" in plan


def test_line_dedup_against_brute_force(spark):
    data = [(i, f"Common line \n own {i}\n\n{'TWICE' if i < 3 else 'x' + str(i)}", "", "", 0) for i in range(12)]
    data += [(3, data[3][1], "", "", 0), (None, "common LINE\r\nb", "", "", 0), (20, None, "", "", 0), (21, "", "", "", 0), (22, "common line", "", "", 0)]
    got = line_dedup.drop_frequent_lines(spark.createDataFrame(data, DOCS), min_docs=10).collect()
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    docs = defaultdict(set)
    for i, t, *_ in data:
        for x in (t or "").split("\n"):
            docs[key(x)].add(i)
    want = []
    for i, t, *_ in data:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not key(x) or len(docs[key(x)]) < 10]
        want.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    assert Counter(map(tuple, got)) == Counter(want)
    assert line_dedup.drop_frequent_lines(empty(spark)).count() == 0
    assert line_dedup.drop_frequent_lines(cases(spark)).count() == len(CASES)


def test_native_plans_run_no_python(spark):
    plan = line_dedup.drop_frequent_lines(cases(spark))._jdf.queryExecution().toString()
    plan += exact_dedup.DigestIndex(spark, "ix_plan", 4).add(cases(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
