"""Codes of vectors: each part is named by its nearest codebook entry, found in a GNAT over the entries.

Components become integers floor(256 x); a vector is cut into equal parts, each with its own codebook. A codebook starts
as that part of the vectors of smallest id and is moved to the mean of its parts in a few rounds, in integers throughout.

A GNAT holds the entries of a codebook: a node has split points chosen far apart, each other entry is a child of the
nearest one, and for each pair of split point and child the node keeps the smallest and largest distance from that
point to the child's entries. A part measures its distance to a split point, and every child whose range that distance
and the best one so far rule out, by the triangle inequality, is left with its whole subtree. Only strictly worse
subtrees go: lower bounds are rounded down and upper bounds up by more than the error of the square roots, and what
stays is compared in exact integers, ties to the lower index.

Vectors stay where they are: a round reads them once and each task returns a sum per part and entry, so what is
shuffled and what the driver takes is bounded by the codebooks.

Defined results: rows whose vector is null or holds null, NaN or infinite components are left out, and so are those
whose length is not that of the kept vector with the smallest id. Lengths that are no multiple of the parts are filled
up with zeros. Null ids come after all others; equal ids are ordered by their vectors. Repeated rows pass through. An
error, or a sum of a label's errors, beyond 64 bits is null. Null labels are one label. An empty table gives an empty
result; other columns are not read. Components of extreme size go through Python's integers, by comparing with all entries.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import cut, join_unique

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Split points of a node, and entries up to which a node is a plain list.
SPLITS, LEAF = 6, 5
#: More than the relative error of a distance that is a square root of an integer.
MARGIN = 1e-12


class Gnat:
    """The entries (rows of an integer table) of one codebook."""

    def __init__(self, entries: np.ndarray, own: np.ndarray | None = None):
        self.entries, self.own = entries, np.arange(len(entries)) if own is None else own
        if len(self.own) <= LEAF:
            return
        points = entries[self.own].astype(np.float64)
        to = lambda k: np.sqrt(((entries[self.own] - entries[self.own[k]]) ** 2).sum(1).astype(np.float64))
        picked, distances = [0], [to(0)]
        while len(picked) < min(SPLITS, len(points)):
            k = int(np.min(distances, axis=0).argmax())
            if k in picked:
                break  # all others equal a split point
            picked.append(k)
            distances.append(to(k))
        distances = np.array(distances)
        child_of = distances.argmin(0)
        child_of[picked] = range(len(picked))
        self.splits = self.own[picked]
        self.low, self.high = np.empty((2, len(picked), len(picked)))
        self.children: list[Gnat | None] = []
        for j in range(len(picked)):
            inside = np.flatnonzero(child_of == j)
            self.low[:, j], self.high[:, j] = distances[:, inside].min(1) * (1 - MARGIN), distances[:, inside].max(1) * (1 + MARGIN)
            rest = self.own[inside[self.own[inside] != self.splits[j]]]
            self.children.append(Gnat(entries, rest) if len(rest) else None)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part, and the squared distance."""
        index, best = np.full(len(parts), len(self.entries)), np.full(len(parts), np.iinfo(np.int64).max)
        self._search(parts, np.arange(len(parts)), index, best)
        return index, best

    def _measure(self, parts, rows, k, index, best) -> np.ndarray:
        d = ((parts[rows] - self.entries[k]) ** 2).sum(1)
        better = (d < best[rows]) | ((d == best[rows]) & (k < index[rows]))
        at = rows[better]
        best[at], index[at] = d[better], k
        return np.sqrt(d.astype(np.float64))

    def _search(self, parts, rows, index, best) -> None:
        if len(self.own) <= LEAF:
            for k in self.own:
                self._measure(parts, rows, k, index, best)
            return
        open_ = np.ones((len(rows), len(self.splits)), bool)  # of each row: the children that may hold its nearest
        for i, k in enumerate(self.splits):
            asked = np.flatnonzero(open_[:, i])
            d = self._measure(parts, rows[asked], k, index, best)[:, None]
            r = np.sqrt(best[rows[asked]].astype(np.float64))[:, None] * (1 + MARGIN)
            beyond = (d * (1 - MARGIN) - r > self.high[i]) | (d * (1 + MARGIN) + r < self.low[i])
            open_[asked] &= ~beyond
        for j, child in enumerate(self.children):
            if child and len(asked := np.flatnonzero(open_[:, j])):
                child._search(parts, rows[asked], index, best)


def _plain_nearest(entries: list[list[int]], part: list[int]) -> tuple[int, int]:
    """In Python's integers: index and squared distance."""
    d, k = min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(entries))
    return k, d


def _integers(x: float) -> int:
    return math.floor(256 * x) if abs(x) < 2**52 else 256 * int(x)


class Codebooks:
    """A codebook for each part, and the search in it."""

    def __init__(self, books: list[list[list[int]]]):
        self.books = books
        self.width = len(books[0][0])
        #: Squared distances of components below it fit into 64 bits.
        self.limit = math.isqrt(2**62 // max(1, self.width)) // 2
        self.small = all(abs(c) < self.limit for book in books for e in book for c in e)
        self.trees = [Gnat(np.array(book, np.int64).reshape(len(book), -1)) for book in books] if self.small else None

    def assign(self, vectors: pa.Array):
        """Yields (rows, integers (rows, parts, width), indexes (rows, parts), squared distances), first what fits into 64 bits."""
        n, parts = len(vectors), len(self.books)
        x = np.zeros((n, parts * self.width))
        if n:
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            x[:, : len(flat) // n] = flat.reshape(n, -1)
        with np.errstate(over="ignore"):
            fits = (np.abs(256 * x) < self.limit - 1).all(1) if self.small else np.zeros(n, bool)
        rows = np.flatnonzero(fits)
        if len(rows):
            c = np.floor(256 * x[rows]).astype(np.int64).reshape(len(rows), parts, self.width)
            found = [tree.nearest(c[:, j]) for j, tree in enumerate(self.trees)]
            yield rows, c, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)
        for row in np.flatnonzero(~fits):
            c = [_integers(v) for v in x[row].tolist()]
            c = [c[j * self.width : (j + 1) * self.width] for j in range(parts)]
            k, d = zip(*(_plain_nearest(book, part) for book, part in zip(self.books, c)))
            yield np.array([row]), np.array([c], object), np.array([k]), np.array([d], object)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(c) for book in self.books for e in book for c in e).encode()).hexdigest()


def usable(vector: Column) -> Column:
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))), F.lit(False))


def first_books(vectors: DataFrame, parts: int, entries: int) -> tuple[int | None, list]:
    """Length of the vector of the smallest id, and codebooks from the first vectors of that length."""
    order = [F.asc_nulls_last("vec_id"), F.col("vector")]
    first = vectors.orderBy(*order).limit(entries).collect()
    if not first:
        return None, []
    size = len(first[0].vector)
    if any(len(r.vector) != size for r in first):
        first = vectors.filter(F.size("vector") == size).orderBy(*order).limit(entries).collect()
    width = -(-size // parts)
    rows = [[_integers(x) for x in r.vector] + [0] * (width * parts - size) for r in first]
    return size, [[row[j * width : (j + 1) * width] for row in rows] for j in range(parts)]


def moved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round: each entry is the floor of the mean of the parts nearest to it."""

    def sums(batches):
        total: dict[tuple[int, int], list[int]] = {}
        for b in batches:
            for _, c, k, _ in books.assign(b.column(0)):
                for j in range(k.shape[1]):
                    order = np.argsort(k[:, j], kind="stable")
                    entry, start = np.unique(k[order, j], return_index=True)
                    s = np.add.reduceat(c[order, j], start, axis=0)
                    for e, n, row in zip(entry.tolist(), np.diff(np.r_[start, len(order)]).tolist(), s.tolist()):
                        old = total.setdefault((j, e), [0] * (1 + len(row)))
                        total[j, e] = [a + x for a, x in zip(old, [n, *row])]
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([[str(x) for x in total[k]] for k in keys], pa.list_(pa.string()))], ["part", "entry", "sums"])

    def added(table: pa.Table) -> pa.Table:
        rows = [[int(x) for x in row] for row in table.column("sums").to_pylist()]
        return pa.table({"part": table.column("part")[:1], "entry": table.column("entry")[:1], "sums": pa.array([[str(sum(c)) for c in zip(*rows)]], pa.list_(pa.string()))})

    schema = "part int, entry int, sums array<string>"
    each = vectors.select("vector").mapInArrow(sums, schema).groupBy("part", "entry").applyInArrow(added, schema)
    new = [[list(e) for e in book] for book in books.books]
    for r in each.collect():  # at most one row an entry
        n, *s = (int(x) for x in r.sums)
        new[r.part][r.entry] = [x // n for x in s]
    return Codebooks(new)


def encode(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256."""
    if entries > 256:
        raise ValueError("a code has two hex digits, so a codebook has at most 256 entries")
    label = F.coalesce(F.concat(F.lit("="), F.col(label_col).cast("string")), F.lit(""))
    kept = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), label.alias("label_key")).filter(usable(F.col("vector")))
    size, first = first_books(kept, parts, entries)
    if not first:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    kept, books = kept.filter(F.size("vector") == size), Codebooks(first)
    for _ in range(rounds):
        books = moved(kept, books)

    def scan(batches):
        for b in batches:
            code, error = [None] * b.num_rows, [None] * b.num_rows
            for rows, _, k, d in books.assign(b.column(2)):
                for row, ks, e in zip(rows.tolist(), k.tolist(), d.sum(1).tolist()):
                    code[row], error[row] = bytes(ks).hex(), e if e < 2**63 else None
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label_key", "code", "error"])

    coded = cut(kept.select("vec_id", "label_key", "vector").mapInArrow(scan, "vec_id long, label_key string, code string, error long"), "vector-codes")
    # a label with an error beyond 64 bits has such a sum, too
    total = F.when(F.count("error") == F.count(F.lit(1)), F.expr("try_cast(sum(cast(error as decimal(38, 0))) as bigint)"))
    sums = coded.groupBy("label_key").agg(total.alias("label_error"), F.count(F.lit(1)).alias("n"))
    return join_unique(coded, sums, ["label_key"], "n", coded.count()).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """CTEs a<k> (nearest entry of each part) and c<k> (codebooks after it)."""
    return f"""
a{k} AS MATERIALIZED (SELECT p.row, p.part, min({{'d': list_sum(list_transform(list_zip(p.xs, c.xs), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'k': c.k}}) AS m FROM p JOIN c{k - 1} c USING (part) GROUP BY ALL),
s{k} AS (SELECT part, m.k AS k, i, sum(xs[i])::BIGINT AS s, count(*) AS n FROM a{k} JOIN p USING (row, part), unnest(range(1, len(xs) + 1)) u(i) GROUP BY ALL),
n{k} AS (SELECT part, k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS xs FROM s{k} GROUP BY ALL),
c{k} AS MATERIALIZED (SELECT c.part, c.k, coalesce(n.xs, c.xs) AS xs FROM c{k - 1} c LEFT JOIN n{k} n ON n.part = c.part AND n.k = c.k),"""


SQL = f"""WITH v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS row, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
 FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT row, part, e[part * (len(e) // {PARTS}) + 1 : (part + 1) * (len(e) // {PARTS})] AS xs FROM v, unnest(range({PARTS})) u(part)),
c0 AS MATERIALIZED (SELECT part, row AS k, xs FROM p WHERE row < {ENTRIES}),{"".join(_round(k) for k in range(1, ROUNDS + 2))}
o AS (SELECT row, string_agg(printf('%02x', m.k), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{ROUNDS + 1} GROUP BY row)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
 (SELECT sha256(string_agg(array_to_string(xs, ','), ',' ORDER BY part, k)) FROM c{ROUNDS}) AS codebooks_sha256 FROM v JOIN o USING (row)"""
