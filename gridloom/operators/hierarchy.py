"""Ancestors, children, siblings and inherited context over (child_id, parent_id, relation)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.operators.impact import numbered
from gridloom.plans.lineage import cut


def closure(edges: DataFrame, max_depth: int = 10, only: DataFrame | None = None) -> DataFrame:
    """concept_id, ancestor_id, depth (fewest), relation_path, last_relation: one row per pair, first path by text.

    only: the concepts (concept_id) whose ancestors are wanted.
    """
    e = cut(edges.select("child_id", "parent_id", "relation").distinct())
    level = e.select(F.col("child_id").alias("concept_id"), F.col("parent_id").alias("ancestor_id"), F.col("relation").alias("relation_path")).filter("concept_id <> ancestor_id")
    level = level if only is None else level.join(only, "concept_id", "left_semi")
    level = cut(level.groupBy("concept_id", "ancestor_id").agg(F.min("relation_path").alias("relation_path")).withColumn("depth", F.lit(1)))
    levels, seen = [level], level.select("concept_id", "ancestor_id")
    for depth in range(2, max_depth + 1):
        step = level.join(e, F.col("ancestor_id") == F.col("child_id")).filter("concept_id <> parent_id")
        step = step.select("concept_id", F.col("parent_id").alias("ancestor_id"), F.concat_ws(">", "relation_path", "relation").alias("relation_path")).join(seen, ["concept_id", "ancestor_id"], "left_anti")
        level = cut(step.groupBy("concept_id", "ancestor_id").agg(F.min("relation_path").alias("relation_path")).withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("concept_id", "ancestor_id"))
    return reduce(DataFrame.unionByName, levels).withColumn("last_relation", F.element_at(F.split("relation_path", ">"), -1))


def children(edges: DataFrame, limit: int = 50) -> DataFrame:
    w = W.partitionBy("parent_id").orderBy("child_id")
    kind = F.when(F.col("relation") == "SUBCLASS_OF", "subclass").otherwise("instance")
    return edges.select("parent_id", "child_id", kind.alias("kind")).distinct().withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)


def siblings(edges: DataFrame, limit: int = 20) -> DataFrame:
    """The first `limit` others under each parent; limit + 1 children of a parent are enough to find them."""
    first = children(edges, limit + 1).select("parent_id", F.col("child_id").alias("sibling_id"))
    pairs = edges.select("child_id", "parent_id").distinct().join(first, "parent_id").filter("child_id <> sibling_id").select("child_id", "sibling_id").distinct()
    return pairs.withColumn("position", F.row_number().over(W.partitionBy("child_id").orderBy("sibling_id"))).filter(F.col("position") <= limit)


def affected(ancestors: DataFrame, changed: DataFrame) -> DataFrame:
    """Concepts whose ancestors change when the edges of the changed ones do: these and all below them."""
    below = ancestors.join(changed.select(F.col("concept_id").alias("ancestor_id")), "ancestor_id", "left_semi").select("concept_id")
    return changed.select("concept_id").union(below).distinct()


def refreshed(ancestors: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """ancestors (as of before) after the edges of the changed concepts did: only affected concepts are walked again.

    The edges above an affected concept are reached from it, so the walk starts at these concepts alone.
    """
    todo = cut(affected(ancestors, changed))
    stays = ancestors.join(todo, "concept_id", "left_anti")
    return stays.unionByName(closure(edges, only=todo).select(*ancestors.columns))


def search_fields(ancestors: DataFrame) -> DataFrame:
    """Per concept: ancestor ids nearest first, and the greatest depth."""
    return ancestors.groupBy("concept_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "ancestor_id"))), lambda x: x["ancestor_id"]).alias("ancestor_ids"), F.max("depth").alias("hierarchy_depth"))


def inherited_context(ancestors: DataFrame, descriptions: DataFrame, budget: int = 500) -> DataFrame:
    """Ancestors' descriptions, nearest first, while their words stay within the budget."""
    d = ancestors.join(descriptions.select(F.col("concept_id").alias("ancestor_id"), "description"), "ancestor_id")
    w = W.partitionBy("concept_id").orderBy("depth", "ancestor_id").rowsBetween(W.unboundedPreceding, 0)
    kept = d.withColumn("words", F.sum(F.size(F.split("description", "\\s+"))).over(w)).filter(F.col("words") <= budget)
    lines = F.array_sort(F.collect_list(F.struct("depth", "ancestor_id", "description")))
    return kept.groupBy("concept_id").agg(F.array_join(F.transform(lines, lambda x: x["description"]), "\n").alias("context"), F.max("words").alias("words"))


def _on_cycles(edges: DataFrame, rounds: int) -> DataFrame:
    """The edges without most of those that lie on no cycle: where nothing leads to the child or on from the parent."""
    n = edges.count()
    for _ in range(rounds):
        children, parents = edges.select(F.col("child_id").alias("parent_id")).distinct(), edges.select(F.col("parent_id").alias("child_id")).distinct()
        edges = cut(edges.join(children, "parent_id", "left_semi").join(parents, "child_id", "left_semi"))
        n, before = edges.count(), n
        if n in (0, before):
            break
    return edges


def without_cycles(candidates: DataFrame, edges: DataFrame, max_depth: int = 10) -> DataFrame:
    """The candidate edges that are taken if they come one after the other, by seq (if there is one), child and parent:
    an edge is rejected if it is a loop, or if its parent reaches its child in at most max_depth steps over the old edges
    and the candidates taken before it.

    Candidates wait for one another only where old and new edges form cycles; all others are taken at once. In each round,
    every waiting edge looks for the way from its parent to its child whose latest waiting edge is earliest. If there is
    none before it, it is taken; if there is one without waiting edges, it is rejected; else it waits for that edge. So the
    first waiting edge of each cyclic part is decided in each round, most often nearly all of them.
    """
    order = [c for c in ("seq", "child_id", "parent_id") if c in candidates.columns]
    rows = numbered(candidates.filter("child_id <> parent_id"), *(F.asc_nulls_last(c) for c in order))
    edge = ["position", "child_id", "parent_id"]
    old = edges.select(F.lit(0).alias("position"), "child_id", "parent_id").distinct()
    graph = _on_cycles(cut(old.unionByName(rows.select(*edge))), max_depth)
    decided, waiting, rejected = graph.filter("position = 0"), graph.filter("position > 0"), None
    while not waiting.isEmpty():
        start = waiting.select("position", F.col("child_id").alias("goal"), F.col("parent_id").alias("node"), F.lit(0).alias("latest"), F.lit(0).alias("hop"))
        # an edge can only wait for earlier ones; decided edges have no time
        way = decided.unionByName(waiting).select(F.col("position").alias("time"), F.col("child_id").alias("node"), F.col("parent_id").alias("next"))
        best = cut(start)
        for hop in range(1, max_depth + 1):
            on = best.filter((F.col("hop") == hop - 1) & (F.col("node") != F.col("goal")))
            step = on.join(way, "node").select("position", "goal", F.col("next").alias("node"), F.greatest("latest", "time").alias("latest"), F.lit(hop).alias("hop")).filter("latest < position")
            # the earlier hop stays where both are as good
            best = cut(best.unionByName(step).groupBy("position", "goal", "node").agg(F.min(F.struct("latest", "hop")).alias("m")).select("position", "goal", "node", "m.*"))
            if best.filter(F.col("hop") == hop).isEmpty():
                break
        closed = best.filter("node = goal").select("position", "latest")
        told = cut(waiting.join(closed, "position", "left"))
        gone = told.filter("latest = 0").select("position")
        rejected = gone if rejected is None else rejected.unionByName(gone)
        decided = decided.unionByName(told.filter("latest IS NULL").select(F.lit(0).alias("position"), "child_id", "parent_id"))
        waiting = told.filter("latest > 0").select(*edge)
    taken = rows if rejected is None else rows.join(rejected, "position", "left_anti")
    return taken.select(*candidates.columns)


def replacements(links: DataFrame) -> DataFrame:
    """(id, final_id) from (id, next_id): pointer jumping, so a chain of n links takes log n rounds.

    An id whose chain runs into a cycle has no last one and keeps itself; links without a target are left out.
    """
    now = cut(links.select("id", F.col("next_id").alias("final_id")).filter("id <> final_id"))
    for _ in range(now.count().bit_length() + 1):
        now = cut(now.alias("a").join(now.alias("b"), F.col("a.final_id") == F.col("b.id"), "left").select(F.col("a.id").alias("id"), F.coalesce("b.final_id", "a.final_id").alias("final_id"), F.col("b.final_id").isNotNull().alias("moved")))
        if not now.filter("moved").limit(1).count():
            break
    return now.select("id", F.when(F.col("moved"), F.col("id")).otherwise(F.col("final_id")).alias("final_id"))
