"""Entity resolution by normalised names, exactly and by similarity."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.functions.text import similarity
from gridloom.plans.lineage import cut


def _check(threshold: float) -> None:
    if not 2 / 3 < threshold <= 1:
        raise ValueError("threshold must be above 2/3")


def _segments(n: str, threshold: float) -> str:
    """SQL: into how many segments a name of n characters is cut.

    Names of n and m characters at similarity t or more leave at most (1 - t) (n + m) characters unmatched in both, and m is
    at most n (2 - t) / t. Each unmatched character breaks one segment at most, so one segment more than that many, and one
    stays whole. Where a name has fewer characters, its single characters do: nothing can be put into them, and one of
    them is matched.
    """
    most = f"floor({n} * {(2 - threshold) / threshold} + 1e-6)"
    return f"cast(least({n}, floor({1 - threshold} * ({n} + {most}) + 1e-6) + 1) as int)"


def _place(n: str, k: str, i: str) -> tuple[str, str]:
    """SQL: where segment i of k of a name of n characters begins, from 0, and its length; the last ones are the longer ones."""
    return f"({i} * ({n} div {k}) + greatest(0, {i} - ({k} - {n} % {k})))", f"({n} div {k} + if({i} >= {k} - {n} % {k}, 1, 0))"


def segment_index(names: DataFrame, threshold: float) -> DataFrame:
    """(norm, n, i, seg): the segments of each name (norm, unique) of n characters."""
    x = names.filter("norm <> ''").withColumn("n", F.length("norm")).withColumn("k", F.expr(_segments("n", threshold))).withColumn("i", F.explode(F.expr("sequence(0, k - 1)")))
    at, size = _place("n", "k", "i")
    return x.selectExpr("norm", "n", "i", f"substring(norm, cast({at} as int) + 1, cast({size} as int)) AS seg")


def segment_probes(names: DataFrame, threshold: float) -> DataFrame:
    """(norm, n, i, seg): for each length n that a similar name can have, the stretches of norm (unique) where that name's
    segments may stand: shifted by as many characters as may be missing or added before it."""
    t = threshold
    x = names.filter("norm <> ''").withColumn("m", F.length("norm"))
    lengths = f"sequence(cast(greatest(1, ceil(m * {t / (2 - t)} - 1e-6)) as int), cast(floor(m * {(2 - t) / t} + 1e-6) as int))"
    x = x.withColumn("n", F.explode(F.expr(lengths))).withColumn("k", F.expr(_segments("n", t))).withColumn("d", F.expr(f"floor({1 - t} * (n + m) + 1e-6)"))
    at, size = _place("n", "k", "i")
    x = x.withColumn("i", F.explode(F.expr("sequence(0, k - 1)"))).selectExpr("norm", "m", "n", "i", f"cast({at} as int) AS at", f"cast({size} as int) AS size", "cast(floor((d - (m - n)) / 2) as int) AS gone", "cast(floor((d + (m - n)) / 2) as int) AS added")
    x = x.selectExpr("norm", "n", "i", "size", "greatest(0, at - gone) AS low", "least(m - size, at + added) AS high").filter("low <= high")
    return x.withColumn("q", F.explode(F.expr("sequence(low, high)"))).selectExpr("norm", "n", "i", "substring(norm, q + 1, size) AS seg")


def similar_names(left: DataFrame, right: DataFrame, threshold: float = 0.88) -> DataFrame:
    """(left_norm, right_norm, score) of names (norm, unique) with score >= threshold, which must be above 2/3.

    A similar name holds one of the other's segments at a shifted place. The segment's number and the name's length are
    part of the key, so a segment that many names have, such as a common word, meets only those of fitting length and
    place. Nothing is compared but names that share a key."""
    _check(threshold)
    total = F.length("left_norm") + F.length("right_norm")
    pairs = segment_probes(left, threshold).withColumnRenamed("norm", "left_norm").join(segment_index(right, threshold).withColumnRenamed("norm", "right_norm"), ["n", "i", "seg"]).select("left_norm", "right_norm").distinct()
    apart = math.ceil(round(100 * (1 - threshold), 6))
    close = F.expr(f"levenshtein(left_norm, right_norm, cast(({apart} * (length(left_norm) + length(right_norm))) div 100 as int)) >= 0")
    near = F.least(F.length("left_norm"), F.length("right_norm")) * 2 >= F.lit(threshold) * total - 1e-6
    scored = pairs.filter("left_norm <> right_norm").filter(near & close).withColumn("score", similarity(F.col("left_norm"), F.col("right_norm"))).filter(F.col("score") >= threshold)
    same = left.select(F.col("norm").alias("left_norm")).join(right.select(F.col("norm").alias("left_norm")), "left_norm")
    return scored.unionByName(same.select("left_norm", F.col("left_norm").alias("right_norm"), F.lit(1.0).alias("score")))


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float = 0.88) -> DataFrame:
    """(left_id, right_id, left_norm, right_norm, score) with score >= threshold, which must be above 2/3. Inputs: id, norm.

    Distinct names are compared, and rows meet their name's similar ones. Null names have no pair."""
    l, r = left.filter("norm IS NOT NULL"), right.filter("norm IS NOT NULL")  # noqa: E741
    found = similar_names(l.select("norm").distinct(), r.select("norm").distinct(), threshold)
    rows = lambda df, side: df.select(F.col("id").alias(f"{side}_id"), F.col("norm").alias(f"{side}_norm")).distinct()
    return found.join(rows(l, "left"), "left_norm").join(rows(r, "right"), "right_norm").select("left_id", "right_id", "left_norm", "right_norm", "score")


def clusters(links: DataFrame) -> DataFrame:
    """(id, cluster) for the ends of links (a, b): the smallest id of their connected component.

    Each round moves links to the smallest neighbour, first from larger ends and then from smaller ones, until every
    component is a star around its smallest id.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            ends = edges.select(F.col("a").alias("id"), F.col("b").alias("cluster"))
            return ends.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("cluster")).distinct())
        before = now


def duplicates(names: DataFrame, threshold: float = 0.88) -> DataFrame:
    """id, norm, cluster: the smallest id among the names that chains of similar names join. Input: id (unique), norm."""
    pairs = similar_pairs(names, names, threshold).filter("left_id <> right_id").select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    return names.select("id", "norm").join(clusters(pairs), "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))


def first_of_similar(rows: DataFrame, threshold: float = 0.88) -> DataFrame:
    """seq, id, norm of the rows that stay, if in order of seq each row goes that is equal or similar to an earlier one
    that stays. Input: seq (unique), id, norm; rows with a null norm go."""
    one = rows.filter("norm IS NOT NULL").groupBy("norm").agg(F.min(F.struct("seq", "id")).alias("o")).select("o.seq", "o.id", "norm")
    ids = one.select(F.col("seq").alias("id"), "norm")
    pairs = cut(similar_pairs(ids, ids, threshold).filter("right_id < left_id").select(F.col("left_id").alias("later"), F.col("right_id").alias("earlier")))
    while not pairs.isEmpty():
        # a row without an earlier one stays, so rows similar to it go, and no longer count against others
        stay = pairs.select("earlier").distinct().join(pairs.select(F.col("later").alias("earlier")).distinct(), "earlier", "left_anti")
        gone = cut(pairs.join(stay, "earlier", "left_semi").select("later").distinct())
        one = one.join(gone.withColumnRenamed("later", "seq"), "seq", "left_anti")
        pairs = cut(pairs.join(gone, "later", "left_anti").join(gone.withColumnRenamed("later", "earlier"), "earlier", "left_anti"))
    return one.select("seq", "id", "norm")


def suggestions(asked: DataFrame, known: DataFrame, limit: int = 5, threshold: float = 0.75) -> DataFrame:
    """norm, position, concept_id, score: for each asked norm that is not known, up to `limit` concepts by similarity,
    ties to the smaller id. Inputs: norm; norm, concept_id."""
    new = asked.select("norm").distinct().join(known.select("norm").distinct(), "norm", "left_anti")
    pairs = similar_pairs(new.select(F.col("norm").alias("id"), "norm"), known.select(F.col("concept_id").alias("id"), "norm").distinct(), threshold)
    best = pairs.groupBy(F.col("left_norm").alias("norm"), F.col("right_id").alias("concept_id")).agg(F.max("score").alias("score"))
    ranked = best.withColumn("position", F.row_number().over(W.partitionBy("norm").orderBy(F.desc("score"), "concept_id")))
    return ranked.filter(F.col("position") <= limit).select("norm", "position", "concept_id", "score")


def registry(rows: DataFrame) -> DataFrame:
    """norm, concept_id, reg_seq from norm, concept_id, seq: the last id, in the place of the first."""
    return rows.groupBy("norm").agg(F.max(F.struct("seq", "concept_id"))["concept_id"].alias("concept_id"), F.min("seq").alias("reg_seq"))


def resolve(mentions: DataFrame, known: DataFrame, threshold: float = 0.88, best: bool = False) -> DataFrame:
    """mention id, concept_id, score, how: exact, else the first registered that is similar enough (or the best), else none."""
    exact = mentions.join(known.select("norm", "concept_id"), "norm").select("id", "concept_id", F.lit(1.0).alias("score"), F.lit("exact").alias("how"))
    rest = mentions.join(exact.select("id"), "id", "left_anti")
    pairs = similar_pairs(rest.select("id", "norm").distinct(), known.select(F.col("reg_seq").alias("id"), "norm"), threshold)
    order = F.struct((-F.col("score")).alias("s"), "right_id") if best else F.struct("right_id", (-F.col("score")).alias("s"))
    found = pairs.groupBy("left_id").agg(F.min(order).alias("o")).select(F.col("left_id").alias("id"), F.col("o.right_id").alias("reg_seq"), (-F.col("o.s")).alias("score"))
    fuzzy = found.join(known.select("reg_seq", "concept_id"), "reg_seq").select("id", "concept_id", "score", F.lit("similar").alias("how"))
    hit = exact.unionByName(fuzzy)
    return hit.unionByName(mentions.join(hit.select("id"), "id", "left_anti").select("id", F.lit(None).cast("string").alias("concept_id"), F.lit(None).cast("double").alias("score"), F.lit("none").alias("how")))


def outcomes(mentions: DataFrame, known: DataFrame, threshold: float | None = 0.88) -> DataFrame:
    """id, n_candidates, outcome of each mention (id, norm): how many concepts of known (norm, concept_id) have its name or,
    with a threshold, one that similar: none is new, one matched, more ambiguous. A null name is new."""
    names = mentions.select("norm").filter("norm IS NOT NULL").distinct()
    found = names.join(known.select("norm", "concept_id"), "norm").select("norm", "concept_id")
    if threshold is not None:
        near = similar_pairs(names.select(F.col("norm").alias("id"), "norm"), known.select(F.col("concept_id").alias("id"), "norm").distinct(), threshold)
        found = found.unionByName(near.select(F.col("left_id").alias("norm"), F.col("right_id").alias("concept_id")))
    counts = found.distinct().groupBy("norm").agg(F.count(F.lit(1)).alias("n_candidates"))
    n = F.coalesce("n_candidates", F.lit(0))
    return mentions.select("id", "norm").join(counts, "norm", "left").select("id", n.alias("n_candidates"), F.when(n == 0, "new").when(n == 1, "matched").otherwise("ambiguous").alias("outcome"))
