"""What traversals leave on disk, and that what they no longer keep is not missed."""

import os
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import impact
from gridloom.plans import lineage
from tests.core.test_impact import EDGES, graph, origins


def written(spark):
    top = lineage.folder(spark).removeprefix("file://")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)


def shuffle_files(spark):
    names = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {n for n in names.split("\n") if "/shuffle_" in n}


def test_cut_tables_leave_no_shuffle_files_and_can_go(spark):
    before, size = shuffle_files(spark), written(spark)
    out = lineage.cut(spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").count())
    assert out.count() == 7 and not {n for n in shuffle_files(spark) - before if n.endswith(".data") and os.path.getsize(n) > 200}
    assert written(spark) > size
    lineage.drop(out)
    assert written(spark) == size


@pytest.mark.parametrize("broad", [3, 40, 20_000])
def test_counts_of_all_nodes_against_brute_force(spark, monkeypatch, broad):
    """Cycles, loops, double edges and sinks; sets from below, bitmaps and both."""
    rng = random.Random(broad)
    names = [f"n{k}" for k in range(80)]
    edges = [(rng.choice(names[:60]), rng.choice(names), rng.choice(["FEEDS", "USES"]), "LOW", False) for _ in range(110)] + [("n1", "n1", "FEEDS", "LOW", False)]
    want = {}
    for o in [*names[:50], "nowhere"]:
        seen, at = set(), {o}
        for _ in range(4):
            at = {d for s, d, *_ in edges if s in at}
            seen |= at
        want[o] = len(seen - {o})
    monkeypatch.setattr(impact, "BROAD", broad)
    got = impact.downstream_counts(origins(spark, *want), spark.createDataFrame(edges, EDGES), 4).collect()
    assert {r.origin: r.downstream for r in got} == want


def test_counts_of_all_nodes_keep_no_row_for_each_pair(spark):
    names = [f"n{k}" for k in range(3000)]
    edges = spark.createDataFrame([(names[k], names[(7 * k + j) % 3000], "FEEDS", "LOW", False) for k in range(3000) for j in (3, 1500)], EDGES)
    ready, asked = lineage.cut(impact.links(edges)), lineage.cut(origins(spark, *names))
    start = written(spark)
    assert impact.downstream_counts(asked, ready, 6).agg(F.sum("downstream")).first()[0] > 150_000
    kept = written(spark) - start
    start = written(spark)
    impact.counted(asked, ready, 6).count()
    assert kept < (written(spark) - start) / 4


def test_estimates_keep_no_level(spark, monkeypatch):
    """The sketches of all levels give the same estimates; nodes that no edge has, and ends that are no nodes."""
    rng = random.Random(4)
    names = [f"n{k}" for k in range(400)]
    edges = spark.createDataFrame([(rng.choice(names[:300]), rng.choice([*names, "else"]), "FEEDS", "LOW", False) for _ in range(700)], EDGES)
    ready, nodes = lineage.cut(impact.links(edges)), lineage.cut(spark.createDataFrame([(n,) for n in [*names, "alone"]], "node string"))
    start = written(spark)
    want = {tuple(r) for r in impact.estimates(impact.downstream_sketches(nodes, ready, 6), 6).collect()}
    kept = written(spark) - start
    monkeypatch.setattr(impact, "SLICE_EDGES", 100, raising=False)
    start = written(spark)
    assert {tuple(r) for r in impact.downstream_estimates(nodes, ready, 6).collect()} == want and len(want) >= 401
    assert written(spark) - start < kept / 4


def test_stored_tables_leave_nothing_else(spark, tmp_path):
    source = str(tmp_path / "t.parquet")
    spark.range(1000).write.parquet(source)
    start = written(spark)
    lineage.stored(spark, "few", [source], lambda: lineage.cut(spark.read.parquet(source)).filter("id < 3"))
    assert written(spark) - start < 3000


def test_report_lines_in_pieces_from_the_last_nodes(spark, monkeypatch):
    """Lines over many pieces in order; the last three nodes of a way are carried along and equal the end of the way."""
    rng = random.Random(9)
    names = [f"n{k}" for k in range(120)]
    nodes, edges = graph(spark, [(n, rng.choice(["PROJECT", "SYSTEM"]), rng.choice(["ACTIVE", "PLANNED"])) for n in names[:-2]], [(rng.choice(names), rng.choice(names), "FEEDS", rng.choice(list(impact.RANK)), rng.random() < 0.5) for _ in range(300)])
    at, ready = origins(spark, *names[:12]), lineage.cut(impact.links(edges, nodes=nodes))
    full = impact.propagate(at, nodes, ready).collect()
    start = written(spark)
    tail = impact.propagate(at, nodes, ready, tail=True)
    assert {(r.origin, r.node): (r.path, r.tier) for r in tail.collect()} == {(r.origin, r.node): (" > ".join(r.path.split(" > ")[-3:]), r.tier) for r in full} and "edge_path" not in tail.columns
    monkeypatch.setattr(impact, "PIECE_LINES", 7)
    want = {}
    for r in sorted(full, key=lambda r: (r.hop, r.node)):
        said = want.setdefault((r.origin, r.tier), [0, []])
        said[0] += 1
        if r.entity_type is not None:
            said[1].append(f"- {r.node} ({r.entity_type}) via {' > '.join(r.path.split(' > ')[-3:])}{' [mitigated]' if r.mitigated else ''}")
    before = shuffle_files(spark)
    lines = impact.report_lines(tail)
    left = [n for n in shuffle_files(spark) - before if n.endswith(".data") and os.path.getsize(n) > 200]
    assert {(r.origin, r.tier): [r.n, r.text] for r in lines.collect()} == {k: [n, "\n".join(x)] for k, (n, x) in want.items()}
    assert len(full) > 300 and max(n for n, _ in want.values()) > 14 and not left and written(spark) > start
