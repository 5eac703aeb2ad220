"""Dependency impact: who is reached from an entity that fails, how badly, and what mitigates it.

nodes: node, entity_type, status, criticality, client_tier, sla_hours, ... ; edges: src, dst, edge_type, criticality,
mitigated. Where only nodes, hops and tiers are asked for, a frontier is a row per node with the set of its origins as
bitmaps, ORed hop by hop (`frontiers`). Where the ways are, it is a row per origin and node with its parent (`hops`); paths
are put together at the end. A hop joins the frontier with the edges; a frontier that is small on disk is broadcast by
Spark, so the edges stay where they are, and in a shuffle the edges of a hub are dealt over many keys, to which the
hub's rows are copied (`dealt`). Candidates are reduced by an aggregate, which combines before the shuffle. `links`
prepares edges once for many traversals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.plans.lineage import cut, drop

# Edge types that carry impact; ranks of criticality.
IMPACT_EDGES = ["HOSTS", "RUNS", "OPERATES", "SERVES", "USES", "FEEDS", "STAFFED_BY"]
RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3, "NEGLIGIBLE": 4}
HALTING = ["PLANNED", "SUSPENDED"]


def criticality_rank(level: Column) -> Column:
    """Rank of a level; anything else counts as MEDIUM."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[level], F.lit(2))


#: A source with more than this share of all edges is a hub; there are fewer than 1 / HUB_SHARE of them.
HUB_SHARE = 0.001
#: Edges that a task takes of one source in any case.
HUB_EDGES = 20_000


def dealt(links: DataFrame) -> DataFrame:
    """links with fan and deal: the edges of a hub are dealt over `fan` keys (src, deal), in order of these keys."""
    at_least = max(HUB_EDGES, int(links.count() * HUB_SHARE))
    hubs = links.groupBy("src").count().filter(F.col("count") > at_least).select("src", F.ceil(F.col("count") / at_least).cast("int").alias("fan"))
    e = links.join(F.broadcast(hubs), "src", "left").withColumn("fan", F.coalesce("fan", F.lit(1)))
    return e.withColumn("deal", F.pmod(F.xxhash64("dst", "edge_type"), F.col("fan")).cast("int")).repartition("src", "deal").sortWithinPartitions("src")


def links(edges: DataFrame, edge_types: list[str] | None = IMPACT_EDGES, nodes: DataFrame | None = None, reverse: bool = False) -> DataFrame:
    """src, dst, edge_type, rank, mitigated, recovery_hours, mode, fan, deal of the edges that carry impact, dealt by `dealt`,
    and with nodes also halted: whether a traversal that halts does not leave src. Edges need not have recovery_hours and
    propagation_mode; a missing mode is DIRECT. reverse: the edges lead back."""
    e = edges if edge_types is None else edges.filter(F.col("edge_type").isin(edge_types))
    own = lambda c, kind: F.col(c).cast(kind) if c in edges.columns else F.lit(None).cast(kind)
    src, dst = ("dst", "src") if reverse else ("src", "dst")
    e = e.select(
        F.col(src).alias("src"), F.col(dst).alias("dst"), "edge_type", criticality_rank(F.col("criticality")).alias("rank"), F.coalesce("mitigated", F.lit(False)).alias("mitigated"),
        own("recovery_hours", "int").alias("recovery_hours"), F.coalesce(own("propagation_mode", "string"), F.lit("DIRECT")).alias("mode"))
    return dealt(cut(with_halted(e, nodes) if nodes is not None else e))


def with_halted(links: DataFrame, nodes: DataFrame) -> DataFrame:
    waiting = nodes.filter((F.col("entity_type") == "PROJECT") & F.col("status").isin(HALTING)).select(F.col("node").alias("src"), F.lit(True).alias("halted")).distinct()
    return links.drop("halted").join(waiting, "src", "left").withColumn("halted", F.coalesce("halted", F.lit(False)))


def _prepared(edges: DataFrame, nodes: DataFrame | None, edge_types: list[str] | None, halt: bool, reverse: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Edges for the first hop, for the later ones, and the hubs among their sources, if there are any."""
    if "fan" not in edges.columns:
        e = cut(links(edges, edge_types, nodes if halt else None, reverse))
    elif reverse:
        e = cut(dealt(edges.drop("fan", "deal", "halted").withColumns({"src": F.col("dst"), "dst": F.col("src")})))
    else:
        e = edges
    later = e
    if halt and nodes is not None:
        later = (e if "halted" in e.columns else with_halted(e, nodes)).filter("NOT halted")
    hubs = e.filter("fan > 1")
    return e, later, None if hubs.isEmpty() else cut(hubs.groupBy(F.col("src").alias("node")).agg(F.first("fan").alias("fan")))


def _step(frontier: DataFrame, links: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """The frontier with the edges that leave it; a hub's row goes to each part of its edges."""
    here = F.col("node") == F.col("src")
    if hubs is None:
        return frontier.join(links.drop("fan", "deal"), here)
    plain = frontier.join(links.filter("fan = 1").drop("fan", "deal"), here)
    # fewer than 1 / HUB_SHARE hubs
    copies = frontier.join(F.broadcast(hubs), "node").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("fan") - 1))).drop("fan")
    return plain.unionByName(copies.join(links.filter("fan > 1").drop("fan"), here & (F.col("part") == F.col("deal"))).drop("part", "deal"))


def hops(origins: DataFrame, edges: DataFrame, nodes: DataFrame | None = None, max_depth: int = 5, edge_types: list[str] | None = IMPACT_EDGES, halt: bool = True, reverse: bool = False, grand: bool = False) -> list[DataFrame]:
    """One table per hop of the nodes first reached there: origin, node, parent, edge_type, rank, mitigated,
    recovery_hours, mode, any_mitigated.

    origins: origin and, where the traversal does not start at the node of that name, node. edges: as they come, or
    prepared by `links`. halt: a PROJECT that is PLANNED or SUSPENDED is reached but not left,
    unless it is the origin. Among ways of equal length the one with the most critical last edge is taken, then an
    unmitigated one, then the first parent and edge type by name. grand: the parent's parent, too.
    """
    if not 1 <= max_depth <= 10:
        raise ValueError("max_depth is 1 to 10")
    first, later, hubs = _prepared(edges, nodes, edge_types, halt, reverse)
    start = F.col("node" if "node" in origins.columns else "origin")
    before = ["parent"] if grand else []
    frontier = cut(origins.select("origin", start.alias("node"), F.lit(False).alias("any_mitigated"), *[F.lit(None).cast("string").alias(c) for c in before]).distinct())
    out, seen = [], frontier.select("origin", "node")
    for hop in range(1, max_depth + 1):
        way = F.min(F.struct("rank", "mitigated", F.col("node").alias("parent"), "edge_type", "recovery_hours", "mode", (F.col("any_mitigated") | F.col("mitigated")).alias("any_mitigated"), *[F.col(c).alias("grand") for c in before]))
        best = _step(frontier.select("origin", "node", "any_mitigated", *before), first if hop == 1 else later, hubs).groupBy("origin", "dst").agg(way.alias("way")).select("origin", F.col("dst").alias("node"), "way.*")
        frontier = cut(best.join(seen, ["origin", "node"], "left_anti"))
        out.append(frontier)
        if hop == max_depth or frontier.isEmpty():
            return out
        seen = seen.unionByName(frontier.select("origin", "node"))


#: Last edges from the best one to be hit by to the worst: rank of criticality twice, plus one if mitigated.
LEVELS = 2 * len(RANK)


def frontiers(origins: DataFrame, edges: DataFrame, nodes: DataFrame | None = None, max_depth: int = 5, edge_types: list[str] | None = IMPACT_EDGES, halt: bool = True, reverse: bool = False, levels: bool = False) -> tuple[DataFrame, DataFrame]:
    """Which origins reach which nodes at which hop, as bitmaps: (numbers, reached).

    numbers: origin, word, bit: origins by sixty-three bits of a word. reached: word, node, hop, and bits: the origins of that
    word that first reach the node there. With `levels`, bits is an array with a bitmap for each value of 2 x rank +
    mitigated of the last edge; an origin is in the lowest one that its shortest ways give. A hop ORs the bitmaps of a
    node's predecessors, so its rows are words and nodes, whatever the number of origins in a word.
    """
    if not 1 <= max_depth <= 10:
        raise ValueError("max_depth is 1 to 10")
    first, later, hubs = _prepared(edges, nodes, edge_types, halt, reverse)
    # numbers follow one another within a partition only; one that holds few origins leaves bits of its last word unused
    known = cut(origins.select("origin").distinct().withColumn("number", F.monotonically_increasing_id()).selectExpr("origin", "number div 63 AS word", "cast(number % 63 AS int) AS bit"))
    start = origins.select("origin", F.col("node" if "node" in origins.columns else "origin").alias("node")).distinct()
    level = [f"b{k}" for k in range(LEVELS if levels else 1)]
    anyone = F.expr(" | ".join(level))
    # known: all origins that have reached the node; b0, b1, ...: those that did with the last hop
    state = start.join(known, "origin").groupBy("word", "node").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("known"))
    state = cut(state.withColumns({c: F.col("known") if c == "b0" else F.lit(0).cast("long") for c in level}))
    none, out = F.lit(0).cast("long"), []
    for hop in range(1, max_depth + 1):
        found = _step(state.select("word", "node", anyone.alias("bits")).filter("bits <> 0"), (first if hop == 1 else later).select("src", "dst", "deal", "fan", (2 * F.col("rank") + F.col("mitigated").cast("int")).alias("level")), hubs)
        new = [F.when(F.col("level") == k, F.col("bits")).otherwise(none).alias(c) for k, c in enumerate(level)] if levels else [F.col("bits").alias("b0")]
        # one aggregate combines what is known with what is found
        merged = state.select("word", "node", "known", *[none.alias(c) for c in level]).unionByName(found.select("word", F.col("dst").alias("node"), none.alias("known"), *new))
        merged = merged.groupBy("word", "node").agg(*[F.expr(f"bit_or({c})").alias(c) for c in ("known", *level)])
        fresh = [F.expr(f"{c} & ~({' | '.join(['known', *level[:k]])})").alias(c) for k, c in enumerate(level)]
        state = cut(merged.select("word", "node", *fresh, F.expr(" | ".join(["known", *level])).alias("known")))
        last = state.filter(anyone != 0)
        out.append(last.select("word", "node", F.lit(hop).alias("hop"), F.array(*level).alias("bits") if levels else F.col("b0").alias("bits")))
        if hop == max_depth or last.isEmpty():
            return known, reduce(DataFrame.unionByName, out)


def of_origins(numbers: DataFrame, rows: DataFrame, levels: bool = False) -> DataFrame:
    """rows (word, bits, ...) as one row per origin in their bitmaps; with `levels` also level. A word has 63 origins at most."""
    if levels:
        rows = rows.select("*", F.posexplode("bits").alias("level", "at")).drop("bits").withColumnRenamed("at", "bits").filter("bits <> 0")
    each = rows.withColumn("bit", F.explode(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.getbit("bits", k) == 1)))
    return each.drop("bits").join(numbers, ["word", "bit"]).drop("word", "bit")


def reach(origins: DataFrame, edges: DataFrame, nodes: DataFrame | None = None, max_depth: int = 5, edge_types: list[str] | None = IMPACT_EDGES, halt: bool = True, reverse: bool = False) -> DataFrame:
    """origin, node, hop (fewest), edge_criticality, edge_mitigated: as `traverse` without ways, by bitmaps."""
    numbers, reached = frontiers(origins, edges, nodes, max_depth, edge_types, halt, reverse, levels=True)
    names = F.array(*[F.lit(k) for k in RANK])
    return of_origins(numbers, reached, levels=True).select("origin", "node", "hop", F.element_at(names, F.shiftright("level", 1) + 1).alias("edge_criticality"), (F.col("level") % 2 == 1).alias("edge_mitigated"))


def traverse(origins: DataFrame, edges: DataFrame, nodes: DataFrame | None = None, max_depth: int = 5, edge_types: list[str] | None = IMPACT_EDGES, halt: bool = True, reverse: bool = False, paths: bool = True, tail: bool = False) -> DataFrame:
    """Nodes reached from each origin: origin, node, hop (fewest), edge_criticality, edge_mitigated, any_mitigated,
    recovery_hours and propagation_mode of the last edge, and with `paths` also path and edge_path, or with `tail` a path of the last three nodes only, which the hops carry along
    and no join puts together. See `hops` for the other arguments."""
    names = F.array(*[F.lit(k) for k in RANK])
    found, before = [], None
    for hop, rows in enumerate(hops(origins, edges, nodes, max_depth, edge_types, halt, reverse, tail), 1):
        if tail:
            rows = rows.withColumn("path", F.array_compact(F.array("grand", "parent", "node")))
        elif paths:
            if before is None:
                rows = rows.withColumns({"path": F.array("parent", "node"), "edge_path": F.array("edge_type")})
            else:
                way = before.select("origin", F.col("node").alias("parent"), F.col("path").alias("path_before"), F.col("edge_path").alias("edge_path_before"))
                rows = rows.join(way, ["origin", "parent"]).withColumns({"path": F.array_append("path_before", F.col("node")), "edge_path": F.array_append("edge_path_before", F.col("edge_type"))})
            before = rows
        shown = ["path"] if tail else ["path", "edge_path"] if paths else []
        found.append(rows.select("origin", "node", F.lit(hop).alias("hop"), *shown, F.element_at(names, F.col("rank") + 1).alias("edge_criticality"), F.col("mitigated").alias("edge_mitigated"), "any_mitigated", "recovery_hours", F.col("mode").alias("propagation_mode")))
    return reduce(DataFrame.unionByName, found)


def tier(status: Column, edge_criticality: Column, mitigated: Column, client_tier: Column, sla_hours: Column) -> Column:
    """CRITICAL, HIGH or MONITOR. Waiting projects come first, then urgent first-tier clients, then the edge."""
    free = F.when(mitigated, "HIGH").otherwise("CRITICAL")
    return (
        F.when(status.isin(HALTING), "MONITOR")
        .when((client_tier == "TIER_1") & (sla_hours <= 24), free)
        .when(edge_criticality == "CRITICAL", free)
        .when(edge_criticality == "HIGH", "HIGH")
        .otherwise("MONITOR")
    )


def entity_ids(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, node): the nodes whose id, name or Hebrew name is the given name in any case; nodes need not have names."""
    keys = [c for c in ("node", "name", "name_he") if c in nodes.columns]
    known = nodes.select(F.col("node").alias("found"), F.explode(F.array_distinct(F.array(*[F.lower(c) for c in keys]))).alias("key"))
    return names.select("name", F.lower("name").alias("key")).distinct().join(known, "key").select("name", F.col("found").alias("node")).distinct()


def propagate(triggers: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int = 5, along_path: bool = False, simulation: bool = False, paths: bool = True, limit: int | None = None, ways: bool = True, tail: bool = False) -> DataFrame:
    """Impacted entities of each trigger (column origin, a name in any case) with tier.

    along_path: any mitigated edge on the way counts. ways: False leaves out paths, recovery_hours and propagation_mode, so
    that bitmaps are enough. tail: a path has its last three nodes only, and there is no edge_path. limit: at most so many entities per trigger, by hop, then the
    most critical ones, then name."""
    known = entity_ids(triggers.select(F.col("origin").alias("name")), nodes).select(F.col("name").alias("origin"), "node")
    if along_path and not ways:
        raise ValueError("mitigation along the path needs the ways")
    paths = paths and ways
    reached = traverse(known, edges, nodes, max_depth, paths=paths, tail=tail) if ways else reach(known, edges, nodes, max_depth)
    reached = reached.join(nodes, "node", "left")
    mitigated = F.col("any_mitigated") if along_path else F.col("edge_mitigated")
    status = F.coalesce("status", F.lit("ACTIVE"))
    shown = [F.array_join(c, " > ").alias(c) for c in (("path",) if tail else ("path", "edge_path"))] if paths else []
    level = [criticality_rank(F.col("criticality")).alias("level")] if limit else []
    out = reached.select(
        "origin", "node", "entity_type", "hop", *shown, "edge_criticality", mitigated.alias("mitigated"), *(["recovery_hours", "propagation_mode"] if ways else []), status.alias("status"),
        tier(status, F.col("edge_criticality"), mitigated, F.col("client_tier"), F.col("sla_hours")).alias("tier"), F.lit(simulation).alias("simulation"), *level)
    if not limit:
        return out
    w = W.partitionBy("origin").orderBy("hop", "level", "node")
    return out.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit).drop("level", "position")


def roll_up(triggers: DataFrame, impacted: DataFrame, max_depth: int) -> DataFrame:
    """One row per trigger, unknown ones too: counts by tier, depth, whether the traversal ended by itself."""
    n = lambda t: F.coalesce(F.sum((F.col("tier") == t).cast("long")), F.lit(0)).alias(f"n_{t.lower()}")
    found = impacted.groupBy("origin").agg(n("CRITICAL"), n("HIGH"), n("MONITOR"), F.count(F.lit(1)).alias("total"), F.max("hop").alias("deepest"))
    out = triggers.select("origin").distinct().join(found, "origin", "left").na.fill(0)
    return out.withColumn("complete", F.col("deepest") < max_depth)


def dependents(targets: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int = 3) -> DataFrame:
    """Who depends on each target, with the fewest hops. edges: as they come, or prepared by `links` with reverse."""
    numbers, found = frontiers(targets, edges, None, max_depth, halt=False, reverse="fan" not in edges.columns)
    return of_origins(numbers, found).join(nodes.select("node", "entity_type"), "node", "left").select("origin", "node", "entity_type", "hop")


def dependent_kinds(found: DataFrame) -> DataFrame:
    """Per target: number of dependents, and whether they span more than one entity type."""
    return found.groupBy("origin").agg(F.count(F.lit(1)).alias("n_dependents"), (F.count_distinct("entity_type") > 1).alias("spans_types"))


def counted(origins: DataFrame, edges: DataFrame, max_depth: int, nodes: DataFrame | None = None, **flags: Column) -> DataFrame:
    """Per origin: downstream, the distinct nodes that it reaches, itself excluded, and how many of them have each flag
    (conditions on columns of nodes); 0 where there are none. Nodes of equal bitmaps are counted before bitmaps are opened."""
    numbers, found = frontiers(origins, edges, None, max_depth, halt=False)
    if flags:
        found = found.join(nodes, "node", "left")
    sums = {"downstream": F.count(F.lit(1))} | {name: F.sum(F.when(f, 1).otherwise(0)) for name, f in flags.items()}
    alike = found.groupBy("word", "bits").agg(*[c.alias(name) for name, c in sums.items()])
    each = of_origins(numbers, alike).groupBy("origin").agg(*[F.sum(name).alias(name) for name in sums])
    return origins.select("origin").distinct().join(each, "origin", "left").na.fill(0, list(sums))


#: A node whose walks, each one counted, have more ends than this is broad.
BROAD = 20_000


def _steps(one: DataFrame, first: DataFrame, depth: int) -> list[DataFrame]:
    """The edges (src, dst) that walks over `one` may take as their first, second, ... step, if `first` has the first ones."""
    steps, n = [first], first.count()
    while len(steps) < depth:
        rest = cut(one.join(steps[-1].select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        before, n = n, rest.count()
        if n == before and rest.join(steps[-1], ["src", "dst"], "left_anti").isEmpty():  # from here on, walks stay where they are
            drop(rest)
            return steps + [steps[-1]] * (depth - len(steps))
        steps.append(rest)
    return steps


def _numbers(names: DataFrame) -> DataFrame:
    """(node, number): the distinct names (node), numbered from 0 without gaps."""
    at = cut(names.select("node").distinct().withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    sizes = at.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    # a row per partition
    before = sizes.select("part", "first", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    kind = "int" if at.count() < 2**31 else "long"  # sets of four bytes a node as long as they do
    out = cut(at.join(F.broadcast(before), "part").select("node", (F.col("at") - F.col("first") + F.col("before")).cast(kind).alias("number")))
    drop(at)
    return out


def _numbered(e: DataFrame, *more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, number) of the ends of edges and of `more` nodes, and the distinct edges (src, dst) by numbers."""
    ends = reduce(DataFrame.unionByName, [e.select(F.col("src").alias("node")), e.select(F.col("dst").alias("node")), *more])
    numbers = _numbers(ends)
    number = lambda end: numbers.select(F.col("node").alias(end), F.col("number").alias(f"{end}_number"))
    return numbers, cut(e.select("src", "dst").join(number("src"), "src").join(number("dst"), "dst").select(F.col("src_number").alias("src"), F.col("dst_number").alias("dst")).distinct())


def _walk_ends(steps: list[DataFrame]) -> DataFrame:
    """(node, ends): how many ends the walks from a node have, each walk counted: at least as many as the nodes it reaches."""
    ends = None
    for step in reversed(steps):
        if ends is None:
            found = step.withColumn("more", F.lit(0).cast("long"))
        else:
            found = step.join(ends.select(F.col("node").alias("dst"), F.col("ends").alias("more")), "dst", "left")
        total = F.least(F.sum(1 + F.coalesce("more", F.lit(0))), F.lit(BROAD + 1)).alias("ends")
        made = cut(found.groupBy(F.col("src").alias("node")).agg(total))
        if ends is not None:
            drop(ends)
        ends = made
    return ends


def _union_step(step: DataFrame, before: DataFrame | None) -> DataFrame:
    """(src, nodes): the successors of each source and what `before` (node, nodes) has of them, each once."""
    if before is None:
        found = step.select("src", F.array("dst").alias("nodes"))
    else:
        own = F.coalesce(F.array_append("nodes", F.col("dst")), F.array("dst"))
        found = step.join(before.select(F.col("node").alias("dst"), "nodes"), "dst", "left").select("src", own.alias("nodes"))
    return found.groupBy("src").agg(F.array_distinct(F.flatten(F.collect_list("nodes"))).alias("nodes"))


def _narrow_counts(steps: list[DataFrame]) -> DataFrame:
    """(node, downstream) of all sources in the edges (src, dst) of `steps`, whose sets must be small (see BROAD).

    Sets are made from the ends of walks upwards, a hop a level, so what many nodes reach is put together once. A level holds
    the sets that the next one takes: those of nodes where a walk can be after so many steps."""
    before = None
    for step in reversed(steps[1:]):
        made = cut(_union_step(step, before).select(F.col("src").alias("node"), "nodes"))
        if before is not None:
            drop(before)
        before = made
    counts = cut(_union_step(steps[0], before).select(F.col("src").alias("node"), F.size(F.array_remove("nodes", F.col("src"))).cast("long").alias("downstream")))
    if before is not None:
        drop(before)
    return counts


def downstream_counts(origins: DataFrame, edges: DataFrame, max_depth: int = 10) -> DataFrame:
    """Distinct nodes that each origin reaches, itself excluded; 0 where there are none. origins: as for `hops`.

    Origins with few walks get sets of node numbers from below (`_narrow_counts`), so that origins, of which there may be as
    many as nodes, share them; the others get bitmaps (`counted`)."""
    if "node" in origins.columns:  # an origin may start at many nodes
        return counted(origins, edges, max_depth)
    asked = origins.select(F.col("origin").alias("node")).distinct()
    e = edges if "fan" in edges.columns else cut(links(edges))
    numbers, one = _numbered(e)
    steps = _steps(one, cut(one.join(asked.join(numbers, "node").select(F.col("number").alias("src")), "src", "left_semi")), max_depth)
    ends = _walk_ends(steps)
    _drop_steps(steps)
    known = cut(asked.join(numbers, "node").join(ends.withColumnRenamed("node", "number"), "number"))
    drop(ends)
    steps = _steps(one, cut(one.join(known.filter(F.col("ends") <= BROAD).select(F.col("number").alias("src")), "src", "left_semi")), max_depth)
    few = _narrow_counts(steps)
    _drop_steps(steps)
    drop(one, numbers)
    many = counted(known.filter(F.col("ends") > BROAD).select(F.col("node").alias("origin")), e, max_depth)
    named = known.select("number", F.col("node").alias("origin")).join(few.withColumnRenamed("node", "number"), "number").select("origin", "downstream")
    return asked.withColumnRenamed("node", "origin").join(named.unionByName(many), "origin", "left").na.fill(0, ["downstream"])


def _drop_steps(steps: list[DataFrame]) -> None:
    drop(*{id(s): s for s in steps}.values())


def _level(own: DataFrame, one: DataFrame, before: DataFrame) -> DataFrame:
    """(node, sketch) of a level: own sketches (node, sketch) with those of the level before of the successors."""
    taken = one.join(before.select(F.col("node").alias("dst"), "sketch"), "dst").select(F.col("src").alias("node"), "sketch")
    return own.select("node", "sketch").unionByName(taken).groupBy("node").agg(F.hll_union_agg("sketch").alias("sketch"))


def _own_sketches(nodes: DataFrame, lg_k: int) -> DataFrame:
    return nodes.groupBy("node").agg(F.hll_sketch_agg(F.col("node"), F.lit(lg_k)).alias("sketch"))


def downstream_sketches(nodes: DataFrame, edges: DataFrame, max_depth: int = 10, lg_k: int = 12) -> DataFrame:
    """(node, level, sketch): for each node and number of hops up to max_depth, a sketch of the distinct nodes that it reaches
    with so many, itself included. Sketches have a fixed size, so a level costs the edges, however many nodes are reached."""
    e = edges if "rank" in edges.columns else cut(links(edges))
    own, one = cut(_own_sketches(nodes, lg_k)), e.select("src", "dst").distinct()
    levels = [own.withColumn("level", F.lit(0))]
    for level in range(1, max_depth + 1):
        levels.append(cut(_level(levels[-1], one, levels[-1]).withColumn("level", F.lit(level))))
    return reduce(DataFrame.unionByName, levels).select("node", "level", "sketch")


def estimates(sketches: DataFrame, max_depth: int = 10) -> DataFrame:
    """(node, downstream) from the last level of `downstream_sketches`."""
    return sketches.filter(F.col("level") == max_depth).select("node", F.greatest(F.hll_sketch_estimate("sketch") - 1, F.lit(0)).alias("downstream"))


#: Sources with more edges than this are taken in a few slices, so that one slice's rows are on disk at a time.
SLICE_EDGES, SLICES = 2_000_000, 4


def downstream_estimates(nodes: DataFrame, edges: DataFrame, max_depth: int = 10, lg_k: int = 12) -> DataFrame:
    """(node, downstream): estimates for all nodes at once, by the last level of `downstream_sketches`.

    A level before it holds only the sketches that the next one takes, those of nodes where a walk can be after so many
    steps, and goes when the next one is there."""
    e = edges if "rank" in edges.columns else cut(links(edges))
    every = nodes.select("node").distinct()
    numbers, one = _numbered(e, every)
    own = cut(every.join(numbers, "node").groupBy(F.col("number").alias("node")).agg(F.hll_sketch_agg(F.col("node"), F.lit(lg_k)).alias("sketch")))
    steps, before = _steps(one, one, max_depth), own
    for level in range(1, max_depth + 1):
        at, last = max_depth - level, level == max_depth
        here = own if last else own.join(steps[at - 1].select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
        slices, made = min(SLICES, steps[at].count() // SLICE_EDGES + 1), []
        for k in range(slices):
            of = lambda c: F.pmod(F.xxhash64(c), F.lit(slices)) == k  # noqa: B023, E731
            part = _level(here.filter(of("node")), steps[at].filter(of("src")), before)
            made.append(cut(estimates(part.withColumn("level", F.lit(level)), level) if last else part))
        if before is not own:
            drop(*parts)
        before, parts = reduce(DataFrame.unionByName, made), made
    _drop_steps(steps)
    out = cut(before.withColumnRenamed("node", "number").join(numbers, "number").select("node", "downstream"))
    drop(own, numbers, *parts)
    return out


def refreshed_sketches(sketches: DataFrame, nodes: DataFrame, edges: DataFrame, changed: DataFrame, max_depth: int = 10, lg_k: int = 12) -> DataFrame:
    """sketches (as of before) after the edges that leave the changed nodes (column node) did.

    A node that is k hops above a changed one has other sketches from level k + 1 on only, and no other node has any: these
    sketches are made anew from the level before, the others stay. nodes: all nodes now; edges: all edges now."""
    e = edges if "rank" in edges.columns else cut(links(edges))
    one = cut(e.select("src", "dst").distinct())
    changed = changed.select("node").distinct()
    _, above = frontiers(changed.select(F.lit("changed").alias("origin"), "node"), e, None, max(1, max_depth - 1), halt=False, reverse=True)
    affected = cut(changed.withColumn("hop", F.lit(0)).unionByName(above.select("node", "hop").filter(F.col("hop") < max_depth)))
    known = sketches.filter("level = 0").select("node")
    new = cut(_own_sketches(nodes.select("node").unionByName(changed).join(known, "node", "left_anti"), lg_k))
    old = sketches.unionByName(new.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(max_depth)))).select("node", "level", "sketch"))
    stays = cut(old.join(affected, "node", "left").filter("hop IS NULL OR level <= hop").select("node", "level", "sketch"))
    out, before = stays, stays.filter("level = 0")
    for level in range(1, max_depth + 1):
        todo = affected.filter(F.col("hop") < level).select("node")
        same = before.join(todo, "node", "left_semi")
        made = cut(_level(same, one.join(todo.withColumnRenamed("node", "src"), "src", "left_semi"), before).withColumn("level", F.lit(level)).select("node", "level", "sketch"))
        out = out.unionByName(made)
        before = stays.filter(F.col("level") == level).unionByName(made)
    return out


def single_points(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """Nodes with something downstream and neither backup, failover nor backup location."""
    n = nodes.join(counts.withColumnRenamed("origin", "node"), "node")
    safe = F.coalesce("has_backup", F.lit(False)) | F.coalesce("has_failover", F.lit(False)) | F.col("backup_location").isNotNull()
    return n.select("node", "entity_type", "downstream", ((F.col("downstream") > 0) & ~safe).alias("is_spof"))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with their position in the given order. Each sorted partition counts its rows; the counts, one per partition,
    tell where the next one begins, so no task holds more than its range."""
    in_order = cut(rows.sort(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    sizes = in_order.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = sizes.select("part", "first", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return in_order.join(F.broadcast(before), "part").withColumn("position", (F.col("at") - F.col("first") + F.col("before") + 1).cast("int")).drop("part", "at", "first", "before")


def compare(locations: DataFrame, nodes: DataFrame, edges: DataFrame, metric: str = "total_downstream", max_depth: int = 5) -> DataFrame:
    """Downstream totals of each location, ranked by a metric, ties by name. Short and long metric names are accepted."""
    metric = {"critical_project_count": "critical_projects", "tier1_client_count": "tier1_clients"}.get(metric, metric)
    safe = F.col("has_backup") | F.col("has_failover") | F.col("backup_location").isNotNull()
    flags = {"critical_projects": (F.col("entity_type") == "PROJECT") & (F.col("criticality") == "CRITICAL"), "tier1_clients": F.col("client_tier") == "TIER_1", "unprotected_systems": (F.col("entity_type") == "SYSTEM") & ~safe}
    all_of = counted(locations, edges, max_depth, nodes, **flags).withColumnRenamed("downstream", "total_downstream")
    return numbered(all_of, F.desc(metric), F.asc("origin"))


def coverage(nodes: DataFrame, edges: DataFrame, ready_at: float = 0.85) -> DataFrame:
    """Share of locations with at least one HOSTS edge."""
    hosts = edges.filter("edge_type = 'HOSTS'").select(F.col("src").alias("node")).distinct().withColumn("has", F.lit(1))
    at = nodes.filter("entity_type = 'LOCATION'").select("node").join(hosts, "node", "left")
    out = at.agg(F.count(F.lit(1)).alias("locations"), F.count("has").alias("covered"))
    ratio = F.coalesce(F.try_divide(F.col("covered").cast("double"), F.col("locations")), F.lit(0.0))
    return out.select("locations", "covered", F.round(ratio * 100, 1).alias("percent"), (ratio >= ready_at).alias("ready"))


def mitigations(entities: DataFrame, nodes: DataFrame, edges: DataFrame, departments: int = 3) -> DataFrame:
    """Options per entity (column node): node, option_type, source, recovery_hours, confidence."""
    own = entities.select("node").distinct().join(nodes, "node")
    row = lambda df, kind, source, hours, conf: df.select("node", F.lit(kind).alias("option_type"), source.alias("source"), hours.cast("int").alias("recovery_hours"), F.lit(conf).alias("confidence"))
    none = F.lit(None)
    backup = edges.filter("edge_type = 'BACKUP_FOR'").select(F.col("dst").alias("node"), F.col("src").alias("by")).distinct().join(own.select("node"), "node")
    location = own.join(nodes.filter("entity_type = 'LOCATION'").select(F.col("node").alias("backup_location")), "backup_location", "left_semi")
    first = nodes.filter("entity_type = 'DEPARTMENT' AND remote AND status = 'ACTIVE'").select(F.col("node").alias("dept")).orderBy("dept").limit(departments + 1)
    # departments + 1 rows at most, so that each entity has enough besides itself
    others = own.select("node").crossJoin(F.broadcast(first)).filter("node <> dept").withColumn("k", F.row_number().over(W.partitionBy("node").orderBy("dept"))).filter(F.col("k") <= departments)
    return reduce(DataFrame.unionByName, [
        row(backup, "redundant_asset", F.col("by"), none, 0.95),
        row(location, "backup_location", F.col("backup_location"), none, 0.9),
        row(own.filter("has_failover"), "documented_fallback", F.lit("documented_failover"), F.col("failover_hours"), 0.9),
        row(own.filter("remote"), "documented_fallback", F.lit("remote_capability"), none, 0.85),
        row(others, "alternative_dept", F.col("dept"), none, 0.7),
    ])


def precedents(entities: DataFrame, incidents: DataFrame, limit: int = 2) -> DataFrame:
    """Options like those of `mitigations` from the newest incidents of each entity: the first two actions of each of its
    `limit` newest ones that have actions. incidents: as for `history`, with actions, recovery_hours, confidence, source."""
    names = entities.select(F.col("node").alias("name")).distinct()
    told = incidents.select("incident_id", "actions", "recovery_hours", "confidence", "source")
    hit = history(incidents, names, limit=limit).join(told, "incident_id").filter(F.size("actions") > 0)
    note = F.concat(F.lit("Historical precedent ("), F.coalesce(F.col("incident_date").cast("string"), F.lit("date unknown")), F.lit("): "), F.array_join(F.slice("actions", 1, 2), "; "))
    return hit.select(F.col("name").alias("node"), F.lit("historical_precedent").alias("option_type"), "source", F.col("recovery_hours").cast("int").alias("recovery_hours"), "confidence", note.alias("description"))


def first_mitigations(impacted: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 5) -> DataFrame:
    """Options for the first `limit` entities of each origin that are CRITICAL, then HIGH, by hop and name."""
    w = W.partitionBy("origin").orderBy(F.col("tier") != "CRITICAL", "hop", "node")
    first = impacted.filter(F.col("tier").isin("CRITICAL", "HIGH")).withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)
    first = cut(first.select("origin", "node", "position"))
    return first.join(mitigations(first, nodes, edges), "node").select("origin", "node", "position", "option_type", "source", "recovery_hours", "confidence")


def has_backup(options: DataFrame) -> DataFrame:
    return options.groupBy("node").agg(F.bool_or(F.col("option_type").isin("redundant_asset", "backup_location")).alias("has_backup"), F.count(F.lit(1)).alias("n_options"))


def history(incidents: DataFrame, names: DataFrame, since: str | None = None, limit: int = 10) -> DataFrame:
    """Newest incidents whose references meet a name, per name; the date filter comes before the limit."""
    rows = incidents if since is None else incidents.filter(F.col("incident_date") >= F.to_date(F.lit(since)))
    refs = rows.select("incident_id", "incident_date", F.explode(F.array_union("location_refs", "entity_refs")).alias("ref")).withColumn("ref", F.lower("ref")).distinct()
    hit = refs.join(names.select("name", F.lower("name").alias("ref")), "ref")
    w = W.partitionBy("name").orderBy(F.desc_nulls_last("incident_date"), "incident_id")
    return hit.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit).select("name", "incident_id", "incident_date", "position")


def visible(nodes: DataFrame, edges: DataFrame, keep: Column) -> DataFrame:
    """Edges with both ends among the visible nodes."""
    seen = nodes.filter(keep).select("node")
    return edges.join(seen.withColumnRenamed("node", "src"), "src", "left_semi").join(seen.withColumnRenamed("node", "dst"), "dst", "left_semi")


def locations(nodes: DataFrame, region: str | None = None, criticality: str | None = None, status: str | None = None) -> DataFrame:
    """Locations whose region has the given text in any case, of a criticality and a status, as far as these are given."""
    out = nodes.filter("entity_type = 'LOCATION'")
    if region is not None:
        out = out.filter(F.contains(F.lower("region"), F.lit(region.lower())))
    for column, value in (("criticality", criticality), ("status", status)):
        out = out if value is None else out.filter(F.col(column) == value)
    return out


def grounding(mentioned: DataFrame, impacted: DataFrame) -> DataFrame:
    """mentioned: report, name. Each name with whether the result holds it."""
    known = impacted.select(F.lower("node").alias("key"), F.lit(True).alias("hit")).distinct()
    return mentioned.withColumn("key", F.lower("name")).join(known, "key", "left").select("report", "name", F.coalesce("hit", F.lit(False)).alias("grounded"))


#: Lines of a report that are put together at a time.
PIECE_LINES = 10_000


def report_lines(impacted: DataFrame) -> DataFrame:
    """Text per origin and tier: one line per entity with the last three nodes of its path, by hop and name.

    Lines are sorted over all tasks and put together in pieces, so a text's task holds its pieces, not its entities."""
    line = F.concat(F.lit("- "), F.col("node"), F.lit(" ("), F.col("entity_type"), F.lit(") via "), F.array_join(F.slice(F.split("path", " > "), F.greatest(F.size(F.split("path", " > ")) - 2, F.lit(1)), 3), " > "), F.when(F.col("mitigated"), " [mitigated]").otherwise(""))
    most = PIECE_LINES

    def pieces(batches):
        import pyarrow as pa

        def row(key, first, lines, n):
            values = [*key, *first, n, "\n".join(lines) if lines else None]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string()))], ["origin", "tier", "hop", "node", "n", "text"])

        key, first, lines, n = None, None, [], 0
        for b in batches:
            for origin, tier, hop, node, text in zip(*(c.to_pylist() for c in b.columns)):
                if n == most or n and (origin, tier) != key:
                    yield row(key, first, lines, n)
                    n = 0
                if not n:
                    key, first, lines = (origin, tier), (hop, node), []
                n += 1
                if text is not None:
                    lines.append(text)
        if n:
            yield row(key, first, lines, n)

    rows = cut(impacted.select("origin", "tier", F.col("hop").cast("int").alias("hop"), "node", line.alias("line")))
    made = cut(rows.sort("origin", "tier", "hop", "node", "line").mapInArrow(pieces, "origin string, tier string, hop int, node string, n long, text string"))
    drop(rows)
    in_order = F.array_sort(F.collect_list(F.struct("hop", "node", "text")))
    return made.groupBy("origin", "tier").agg(F.array_join(F.transform(in_order, lambda x: x["text"]), "\n").alias("text"), F.sum("n").alias("n"))


# The sentences of a report.
HISTORY_TITLE = "=== HISTORICAL CONTEXT ==="
MOST_RECENT, OUTCOME = "  Most recent: ", "\n  Outcome: "
UNKNOWN_TITLE, UNKNOWN_DATE, UNKNOWN_OUTCOME = "unknown", "date unknown", "not recorded"
NO_HISTORY = "  No closely matching historical incidents found in knowledge base."
CONFIDENCE_LINE, LOW_COVERAGE_LINE = "COVERAGE_CONFIDENCE: ", "\nLOW_COVERAGE_ENTITIES: "
SITUATION_DISRUPTION, SITUATION_COUNT = " is unavailable (disruption: ", " entities affected. Report generated from structured data — LLM unavailable."
CRITICAL_NOTE, HIGH_NOTE, MONITOR_NOTE = "CRITICAL impact, no mitigation available", "HIGH impact", "MONITOR level"
HISTORY_FAILED, REASON_FAILED = "Historical context unavailable — LLM call failed.", "LLM call failed during report generation: "


def report_context(triggers: DataFrame, past: DataFrame, confidence: Column, low_coverage: Column) -> DataFrame:
    """The last lines of a report per origin: its most recent incident, and how far the graph covers it.

    past: name, title, incident_date, outcome, position (see `history`)."""
    latest = past.filter("position = 1").select(F.col("name").alias("origin"), "title", "incident_date", "outcome")
    told = F.concat(F.lit(MOST_RECENT), F.coalesce("title", F.lit(UNKNOWN_TITLE)), F.lit(" | "), F.coalesce(F.col("incident_date").cast("string"), F.lit(UNKNOWN_DATE)), F.lit(OUTCOME), F.coalesce("outcome", F.lit(UNKNOWN_OUTCOME)))
    out = triggers.select("origin").distinct().join(latest.withColumn("told", told), "origin", "left")
    none = F.lit(NO_HISTORY)
    covered = F.concat(F.lit(CONFIDENCE_LINE), confidence.cast("string"), F.when(F.size(low_coverage) > 0, F.concat(F.lit(LOW_COVERAGE_LINE), F.array_join(low_coverage, ", "))).otherwise(""))
    return out.select("origin", F.concat_ws("\n", F.lit(HISTORY_TITLE), F.coalesce("told", none), F.lit(""), covered).alias("text"))


def report_record(triggers: DataFrame, impacted: DataFrame, disruption: str = "UNAVAILABLE", simulation: bool = False, reason: str = "") -> DataFrame:
    """The report that needs no model, one per trigger: situation, a list per tier by hop and name, named entities."""
    at = F.struct("hop", "node")
    of = lambda t: F.array_sort(F.collect_list(F.when(F.col("tier") == t, at)))["node"]
    found = impacted.groupBy("origin").agg(of("CRITICAL").alias("critical"), of("HIGH").alias("high"), of("MONITOR").alias("monitor"), F.count(F.lit(1)).alias("total"))
    none = F.array().cast("array<string>")
    r = triggers.select("origin").distinct().join(found, "origin", "left").withColumns({c: F.coalesce(c, none) for c in ("critical", "high", "monitor")}).na.fill(0, ["total"])
    line = lambda c, note: F.transform(c, lambda n: F.concat(n, F.lit(f" — {note}")))
    return r.select(
        F.col("origin").alias("location_name"), F.lit(simulation).alias("is_simulation"),
        F.concat(F.col("origin"), F.lit(f"{SITUATION_DISRUPTION}{disruption}). "), F.col("total").cast("string"), F.lit(SITUATION_COUNT)).alias("situation"),
        line("critical", CRITICAL_NOTE).alias("critical_immediate"), line("high", HIGH_NOTE).alias("high_time_sensitive"), line("monitor", MONITOR_NOTE).alias("monitor_no_action"),
        F.lit(HISTORY_FAILED).alias("historical_context"), F.lit("LOW").alias("confidence"), F.lit(REASON_FAILED + reason).alias("confidence_reason"), F.concat("critical", "high", "monitor").alias("named_entities"))
