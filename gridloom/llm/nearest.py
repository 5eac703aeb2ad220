"""Approximate nearest neighbours by few stable projections, a kd-tree and a chi-square stopping test.

Vectors are scaled to length one, so the largest cosine is the smallest Euclidean distance, and projected to `DIM`
numbers by a fixed Gaussian matrix. The squared projected distance of two vectors at distance r is r**2 times a
chi-square variable with DIM degrees of freedom. A query meets projected neighbours in order of their distance, verifies
them on the original vectors, and stops where the next projected distance is so large that a vector as near as the
k-th found would lie beyond it with a probability of at most 1 - `confidence`.

The kd-tree is fitted on a bounded sample of projections (SAMPLE_ROWS) and has leaves of about LEAF_ROWS vectors, which
are the groups that Spark deals out; a leaf that turns out larger is divided by hash, so no group grows with the input.
A query first searches its own leaf (FIRST_LEAVES). The k-th distance found there and the stopping test
tell which other leaves it must visit, and within each leaf it goes on from the nearest projection, with the k-th
distance tightened after every BITE verified vectors. Only queries, not pairs, are sent to leaves.

How much the test saves depends on the data: vectors without any structure in 64 dimensions have their 5th neighbour
almost as far away as all others, so every leaf is visited and about half of all vectors are verified there;
`shares` measures it.

Equal vectors are searched once: a distinct vector is one point with its k + 1 smallest ids, which are all that
can be among k nearest with ties to the smaller id, and so is each distinct query vector. Scores are sums in a fixed
order, so they do not depend on where a vector lies.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; neither do null ids,
nor vectors of another length than most. Rows are told apart by id; a row repeated with the same vector counts once.
With fewer than k candidates all are returned. An empty input gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.llm.shared import cut, join_unique

DIM = 16
CONFIDENCE = 0.9
LEAF_ROWS = 2_048
#: Leaves of the fitted tree; the sample has some tens of rows for each.
MAX_LEAVES = 8_192
SAMPLE_ROWS = 200_000
FIRST_LEAVES = 1
#: Vectors verified between two tests.
BITE = 128
#: Squared distance that rounding of the projections may hide.
ROUNDING = 1e-5
KEY = ["h1", "h2"]


def chi_square_limit(confidence: float, dim: int) -> float:
    """Quantile for an even number of degrees of freedom, by bisection on the closed form."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(dim // 2))
        low, high = (x, high) if 1 - tail < confidence else (low, x)
    return high


def projection(size: int, dim: int = DIM) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((size, dim))


def leaves(points: np.ndarray, n: int) -> list[tuple[int, float, int, int]]:
    """kd-tree as (dimension, cut, left, right) nodes; a negative child -1 - c is leaf c. At most n leaves."""
    nodes: list = []
    number = [0]

    def grow(p: np.ndarray, n: int) -> int:
        spread = p.max(0) - p.min(0) if len(p) else np.zeros(1)
        if n < 2 or len(p) < 2 or spread.max() == 0:
            number[0] += 1
            return -number[0]
        d = int(spread.argmax())
        at = len(nodes)
        nodes.append(None)
        where = float(np.quantile(p[:, d], (n // 2) / n))
        if where <= p[:, d].min():
            where = float(np.nextafter(p[:, d].min(), np.inf))
        left = grow(p[p[:, d] < where], n // 2)
        right = grow(p[p[:, d] >= where], n - n // 2)
        nodes[at] = (d, where, left, right)
        return at

    root = grow(points, n)
    return nodes if root >= 0 else []


def leaf_of(nodes: list, p: np.ndarray) -> np.ndarray:
    out = np.zeros(len(p), np.int64)
    todo = [(0, np.arange(len(p)))] if nodes else []
    while todo:
        at, rows = todo.pop()
        d, where, left, right = nodes[at]
        low = p[rows, d] < where
        for child, part in ((left, rows[low]), (right, rows[~low])):
            if child < 0:
                out[part] = -1 - child
            else:
                todo.append((child, part))
    return out


def nearest_leaves(nodes: list, q: np.ndarray, radius2: float = math.inf):
    """(squared projected distance, leaf) in order of distance, as far as radius2."""
    if not nodes:
        yield 0.0, 0
        return
    heap = [(0.0, 0, (0.0,) * len(q))]
    while heap:
        near2, at, gap = heapq.heappop(heap)
        if near2 > radius2:
            return
        if at < 0:
            yield near2, -1 - at
            continue
        d, where, left, right = nodes[at]
        near, far = (left, right) if q[d] < where else (right, left)
        heapq.heappush(heap, (near2, near, gap))
        beyond = max(gap[d], (q[d] - where) ** 2)
        heapq.heappush(heap, (near2 - gap[d] + beyond, far, (*gap[:d], beyond, *gap[d + 1 :])))


def scores(v: np.ndarray, norm: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines; each row is summed on its own, in the same order."""
    return (v * q).sum(1) / (norm * math.sqrt((q * q).sum()))


def search(d2: np.ndarray, first_id: np.ndarray, v: np.ndarray, norm: np.ndarray, q: np.ndarray, n: int, kth: float, limit: float) -> tuple[list[tuple[float, int, int]], int]:
    """The n best (-score, smallest id, row) of a leaf whose projections have the squared distances d2, and how many
    vectors were verified. kth: the score to reach."""
    best: list[tuple[float, int, int]] = []
    within = np.flatnonzero(d2 <= limit * max(0.0, 2 - 2 * kth) + ROUNDING)
    order = within[np.argsort(d2[within], kind="stable")]
    at = 0
    while at < len(order) and d2[order[at]] <= limit * max(0.0, 2 - 2 * kth) + ROUNDING:
        rows = order[at : at + BITE]
        at += len(rows)
        s = scores(v[rows], norm[rows], q)
        take = s >= kth
        if take.any():
            rows, s = rows[take], s[take]
            best = sorted([*best, *zip((-s).tolist(), first_id[rows].tolist(), rows.tolist())])[:n]
            if len(best) == n:
                kth = max(kth, -best[-1][0])
    return best, at


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, size) of the vectors that take part; float components stay float, which double holds exactly."""
    kind = "float" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    bad = F.exists("v", lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf")))
    some = F.exists("v", lambda a: a != 0)
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & some).withColumn("size", F.size("v"))


def _matrix(column) -> np.ndarray:
    """List column of one width as a double matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _lists(m: np.ndarray) -> pa.Array:
    m = m.astype(np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def _projected(points: DataFrame, matrix: np.ndarray, kind: str) -> DataFrame:
    def project(batches):
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column(3))
                p = (v / np.sqrt((v * v).sum(1, keepdims=True))) @ matrix
                yield pa.RecordBatch.from_arrays([*b.columns, _lists(p)], ["h1", "h2", "ids", "v", "p"])

    return points.mapInArrow(project, f"h1 long, h2 long, ids array<long>, v array<{kind}>, p array<float>")


def _leaf_sizes(points: DataFrame, tree) -> dict[int, int]:
    """Points of each leaf; at most a row per leaf and task."""

    def count(batches):
        for b in batches:
            if b.num_rows:
                leaf, n = np.unique(leaf_of(tree.value, _matrix(b.column(0))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(n, pa.int64())], ["leaf", "n"])

    return {r.leaf: r.n for r in points.select("p").mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()}


class _Groups:
    """Leaves as groups of at most about 2 LEAF_ROWS points: leaf c has `parts[c]` groups from `first[c]` on."""

    def __init__(self, sizes: dict[int, int]):
        n = max(sizes, default=0) + 1
        self.parts = np.maximum(1, -(-np.array([sizes.get(c, 0) for c in range(n)]) // (2 * LEAF_ROWS)))
        self.first = np.concatenate([[0], np.cumsum(self.parts)[:-1]])

    def of(self, leaf: np.ndarray, h: np.ndarray) -> np.ndarray:
        return self.first[leaf] + h % self.parts[leaf]

    def all(self, leaf: int) -> range:
        return range(self.first[leaf], self.first[leaf] + self.parts[leaf]) if leaf < len(self.first) else range(0)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, confidence: float = CONFIDENCE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by `every`."""
    spark, out_schema = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    searched = _search(vectors, every, k, confidence, id_col, vector_col)
    if searched is None:
        return spark.createDataFrame([], out_schema)
    query_rows, lists, _ = searched
    n_queries = query_rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_queries"))
    unique = cut(lists.join(n_queries, KEY), "nearest")
    answers = join_unique(query_rows.select(*KEY, F.col("vec_id").alias("query_id")), unique, KEY, "n_queries", query_rows.count())
    each = F.flatten(F.transform("near", lambda x: F.transform(x["ids"], lambda i: F.struct(x["s"].alias("s"), i.alias("vec_id")))))
    others = F.slice(F.filter(F.array_sort(each), lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def shares(vectors: DataFrame, every: int = 50, k: int = 5, confidence: float = CONFIDENCE, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[float, float]:
    """Parts of all (query, vector) pairs whose leaf was visited and whose vector was verified."""
    query_rows, _, tried = _search(vectors, every, k, confidence, id_col, vector_col)
    pairs = query_rows.select(*KEY).distinct().count() * valid(vectors, id_col, vector_col).count()
    got = tried.agg(F.sum("visited").alias("visited"), F.sum("verified").alias("verified")).first()
    return got.visited / pairs, got.verified / pairs


def _search(vectors: DataFrame, every: int, k: int, confidence: float, id_col: str, vector_col: str):
    """Query rows (vec_id, h1, h2), the k + 1 nearest points of each distinct query, and what was visited; None if empty."""
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vector_col)
    kind = rows.schema["v"].dataType.elementType.typeName()
    sizes = rows.groupBy("size").count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not sizes:
        return None
    size = sizes[0]["size"]
    same = F.transform("v", lambda a: F.when(a == 0, F.lit(0.0).cast(kind)).otherwise(a))  # one zero
    rows = rows.filter(F.col("size") == size).select("vec_id", "v", F.xxhash64(same).alias("h1"), F.xxhash64(F.lit(1), same).alias("h2")).dropDuplicates([*KEY, "vec_id"])
    few = rows.withColumn("n", F.row_number().over(W.partitionBy(*KEY).orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    points = few.groupBy(*KEY).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v"))  # k + 1 ids at most
    points = cut(_projected(points, projection(size), kind), "points")
    total = points.count()
    share = SAMPLE_ROWS / max(1, total)
    sample = points.filter(F.col("h1") / 2.0**64 + 0.5 <= share).select("p").toArrow()  # about SAMPLE_ROWS projections
    tree = spark.sparkContext.broadcast(leaves(_matrix(sample["p"]) if sample.num_rows else np.zeros((0, DIM)), int(min(MAX_LEAVES, max(1, total // LEAF_ROWS)))))
    groups = spark.sparkContext.broadcast(_Groups(_leaf_sizes(points, tree)))
    limit = chi_square_limit(confidence, DIM)

    def place(batches):
        for b in batches:
            if b.num_rows:
                g = groups.value.of(leaf_of(tree.value, _matrix(b.column(4))), b.column(0).to_numpy())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(g, pa.int64())], ["h1", "h2", "ids", "v", "p", "leaf"])

    placed = points.mapInArrow(place, f"h1 long, h2 long, ids array<long>, v array<{kind}>, p array<float>, leaf long")
    query_rows = cut(rows.filter(F.col("vec_id") % every == 0).select("vec_id", *KEY), "query-rows")
    queries = cut(points.join(query_rows.select(*KEY).distinct(), KEY).select(*KEY, "v", "p"), "query-vectors")
    asked = f"h1 long, h2 long, v array<{kind}>, p array<float>, kth double, leaf long"

    def route(skip: int, stop: int | None):
        def send(batches):
            for b in batches:
                at, to = [], []
                for j, (p, kth) in enumerate(zip(_matrix(b.column(3)) if b.num_rows else [], b.column(4).to_pylist())):
                    for rank, (_, leaf) in enumerate(nearest_leaves(tree.value, p, limit * max(0.0, 2 - 2 * kth) + ROUNDING)):
                        if rank == stop:
                            break
                        if rank >= skip:
                            own = groups.value.all(leaf)
                            at += [j] * len(own)
                            to += own
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(at, pa.int64())).columns, pa.array(to, pa.int64())], [x.split()[0] for x in asked.split(", ")])

        return send

    found = "h1 long, h2 long, visited long, verified long, found array<struct<s: double, ids: array<long>>>"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("s", pa.float64()), ("ids", pa.list_(pa.int64()))]))]

    def in_leaf(qs: pa.Table, ps: pa.Table) -> pa.Table:
        out = []
        if ps.num_rows and qs.num_rows:
            p, v, ids = _matrix(ps["p"]), _matrix(ps["v"]), ps["ids"].to_pylist()
            norm, first_id, p2 = np.sqrt((v * v).sum(1)), np.array([x[0] for x in ids]), (p * p).sum(1)
            q, pq = _matrix(qs["v"]), _matrix(qs["p"])
            for j, (h1, h2, kth) in enumerate(zip(*(qs[c].to_pylist() for c in ("h1", "h2", "kth")))):
                best, n = search(p2 - 2 * (p @ pq[j]) + pq[j] @ pq[j], first_id, v, norm, q[j], k + 1, kth, limit)
                out.append((h1, h2, len(p), n, [{"s": s, "ids": ids[row]} for s, _, row in best]))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], [x.split()[0] for x in found.split(", ", 4)])

    by_leaf = placed.groupBy("leaf")

    def visit(state: DataFrame, skip: int, stop: int | None) -> DataFrame:
        return state.mapInArrow(route(skip, stop), asked).groupBy("leaf").cogroup(by_leaf).applyInArrow(in_leaf, found)

    def best(rounds: DataFrame) -> DataFrame:
        each = rounds.select(*KEY, F.explode("found").alias("f")).select(*KEY, "f.s", "f.ids")
        near = each.withColumn("n", F.row_number().over(W.partitionBy(*KEY).orderBy("s", F.col("ids")[0]))).filter(F.col("n") <= k + 1)
        return near.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("s", "ids"))).alias("near"))  # at most k + 1 each

    first = cut(visit(queries.withColumn("kth", F.lit(-2.0)), 0, FIRST_LEAVES), "first-leaves")
    kth = F.when(F.size("near") > k, -F.col("near")[k]["s"]).otherwise(F.lit(-2.0))
    state = cut(queries.join(best(first).select(*KEY, kth.alias("kth")), KEY).select(*KEY, "v", "p", "kth"), "first-bounds")
    rounds = first.unionByName(cut(visit(state, FIRST_LEAVES, None), "other-leaves"))
    return query_rows, best(rounds), rounds
