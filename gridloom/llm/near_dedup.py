"""Near-duplicate detection by order MinHash, verified by banded alignment.

Two texts are linked if an alignment matches at least SIMILARITY of the words of the longer one, in order. Texts that
share 0.8 of their five-word shingles in order always do. The alignment runs in a band, which is widened up to the width
beyond which SIMILARITY cannot be reached. A class is a connected component of links. Texts with the same words are one
node from the start.

Candidates come from order MinHash of a text's k-mers of KMER words, which are labelled with their occurrence number, so
repeats differ. Each of SKETCHES hash functions picks the PICKS labelled k-mers with the smallest values and keeps them in
text order: two texts share the sketch only if they share the k-mers and their order, so sketches are sensitive to edit
similarity. Two-word k-mers survive one changed word in seven; five-word ones mostly do not. Linked texts of up to
SHORT words differ by one word at most; they share an exact key, the words with one of them left out.

In each bucket of equal sketches a member is first paired with one node, the first member by digest of most of its
buckets. Buckets whose members are not yet all of one class go on in rounds: the members with the most and the fewest
links are the bucket's ends, more of them in each round, and meet every member that has not been an end and is of another
class. From the second round on, buckets of up to WHOLE members have all of them as ends and are done with it. A bucket
is done when the members that were no end are of one class, so no link within a bucket is missed, while n copies of one
text make about n pairs. Before a pair becomes a row, two bitmaps of the texts' words tell whether it can
be linked at all: a word whose bit the other text lacks is unmatched. That rules out most texts that only share a passage,
and no link. A pair that shares the part J of its k-mers has no bucket in common with probability (1 - J**PICKS)**SKETCHES:
0.5 % with one word in ten changed (J = 2/3), 5 % measured with one in seven.

Defined results: a null text is the empty text. Texts without a word are equal if identical. A null id counts as larger
than any other: a class with null ids only has the class id null. Repeated rows are members like any other. An empty
input gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.llm.shared import HOT_SHARE, cut
from gridloom.llm.words import balanced

KMER = 2
#: Least share of the longer text's words that match in order.
SIMILARITY = 0.85
SKETCHES = 24
PICKS = 4
#: Texts of as many words may be linked with one word changed, the longer ones with more: floor((1 - SIMILARITY) n) is 1.
LEAST_SHORT, SHORT = 6, 13
#: Bits of a text's words, 64 in a number.
BITS = 2048
WORD = re.compile(r"\w+")
SIGNATURE = "doc_id long, text_hash long, node binary, n_words long, bits array<long>, sketches array<long>"
PRIME = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(11)
MULTIPLY = _RNG.integers(1, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FLIP = _RNG.integers(0, 1 << 63, SKETCHES, dtype=np.uint64)
#: Numbers in the largest array of hash values; longer texts take several rounds of hash functions.
ROOM = 1 << 21
KEEP = 300_000
#: Rows of the alignment table between two shifts of the band.
BAND_ROWS = 2048
#: Links that one task joins into classes; more links take rounds of joins.
FEW_LINKS = 200_000
#: Most parts of a bucket that give an end of either kind in a round; larger buckets take more rounds.
FIRST_SLOTS, MOST_SLOTS = 8, 1024
#: From the second round on, all members of buckets of up to as many are ends, so these need no further round.
WHOLE = 1024
#: Bytes of an end, and of the ends of all hot buckets, which are broadcast.
END_BYTES, ENDS_BYTES = 600, 64 << 20


class Hasher:
    """Words to 64-bit hashes; a worker keeps the first KEEP words it meets."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def words(self, text: str) -> list[str]:
        return WORD.findall(text.lower())

    def hashes(self, words: list[str]) -> np.ndarray:
        import xxhash

        known = self.known
        for w in set(words).difference(known):
            if len(known) < KEEP:
                known[w] = xxhash.xxh3_64_intdigest(w)
        get = known.get
        return np.fromiter((h if (h := get(w)) is not None else xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * PRIME
    return x ^ (x >> np.uint64(29))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of successive KMER words; one for a shorter text; none for no words."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(KMER, n)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out = mix(out + hashes[k : n - width + 1 + k])
    return out


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingles mixed with their occurrence number."""
    order = np.argsort(s, kind="stable")
    ordered = s[order]
    begin = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    at = np.arange(len(s))
    number = np.empty(len(s), np.uint64)
    number[order] = at - np.maximum.accumulate(np.where(begin, at, 0))
    return mix(s + number * PRIME)


def sketches(s: np.ndarray) -> np.ndarray:
    """One signed 64-bit hash per hash function, of its smallest labelled shingles in text order."""
    x = labelled(s)
    picks = min(PICKS, len(x))
    step = max(1, ROOM // len(x))
    out = np.empty(SKETCHES, np.uint64)
    for a in range(0, SKETCHES, step):
        b = min(a + step, SKETCHES)
        values = (x[None] ^ FLIP[a:b, None]) * MULTIPLY[a:b, None]
        at = np.sort(np.argpartition(values, picks - 1, axis=1)[:, :picks], axis=1) if picks < len(x) else np.tile(np.arange(picks), (b - a, 1))
        key = np.arange(a, b, dtype=np.uint64)
        for k in range(picks):
            key = mix(key + x[at[:, k]])
        out[a:b] = key
    return out.view(np.int64)


def left_out(h: np.ndarray) -> list[int]:
    """Keys of a short text: its words, and its words without each one of them."""
    if not LEAST_SHORT <= len(h) <= SHORT:
        return []

    def key(words: np.ndarray) -> np.uint64:
        x = np.uint64(len(words))
        for w in words:
            x = mix(x + w)
        return x

    with np.errstate(over="ignore"):
        return np.unique(np.array([key(h), *(key(np.delete(h, k)) for k in range(len(h)))], np.uint64)).view(np.int64).tolist()


def bits_of(h: np.ndarray) -> np.ndarray:
    """A bit for each of the words; a word's second occurrence is another word."""
    held = np.zeros(BITS, bool)
    if len(h):
        held[(labelled(h) >> np.uint64(20)) % np.uint64(BITS)] = True
    return np.packbits(held).view(np.int64)


def node_of(words: list[str], text: str) -> bytes:
    """16 bytes that stand for the words in order, or for the text if it has none."""
    return hashlib.blake2b(("\x01" + " ".join(words) if words else "\x02" + text).encode(), digest_size=16).digest()


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def scan(batches):
        hasher = Hasher()
        pairs = (pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([b.column(0), b.column(2)], ["i", "h"]), b.column(1)], ["id", "text"]) for b in batches)
        for ids, texts in balanced(pairs):
            nodes, sizes, bits, keys = [], [], [], []
            for t in texts:
                words = hasher.words(t)
                h = hasher.hashes(words)
                nodes.append(node_of(words, t))
                sizes.append(len(h))
                bits.append(bits_of(h))
                keys.append([*sketches(shingles(h)).tolist(), *left_out(h)] if len(h) else [])
            yield pa.RecordBatch.from_arrays(
                [pa.array([x["i"] for x in ids], pa.int64()), pa.array([x["h"] for x in ids], pa.int64()), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "node", "n_words", "bits", "sketches"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(scan, SIGNATURE)


def band_lcs(a: np.ndarray, b: np.ndarray, width: int, need: int = 0) -> int:
    """Longest common subsequence whose matches stay within `width` of the diagonals between the two corners.

    A row of the table is a bit vector (bit j is 0 where the row grows at b[j]), held as an integer. Blocks of
    BAND_ROWS rows see only the columns of their part of the band, so the work is rows times band / 64. Returns -1 as
    soon as `need` is out of reach."""
    n, m = len(a), len(b)
    low, high = min(0, m - n) - width, max(0, m - n) + width  # column minus row within the band
    row = (1 << m) - 1
    for i in range(0, n, BAND_ROWS):
        part = a[i : i + BAND_ROWS].tolist()
        first, last = max(0, i + low), min(m, i + len(part) + high)
        if first >= last:
            continue
        places: dict[int, int] = {}
        for j, x in enumerate(b[first:last].tolist()):
            places[x] = places.get(x, 0) | 1 << j
        inside = (1 << (last - first)) - 1
        v = (row >> first) & inside
        for k, x in enumerate(part, i):
            hit = places.get(x)
            if hit:
                far = max(0, k + low - first)
                hit &= (1 << max(0, k + high + 1 - first)) - 1
                hit = hit >> far << far
                u = v & hit
                v = ((v + u) | (v - u)) & inside
        row = (row >> last << last) | (v << first) | (row & ((1 << first) - 1))
        if need and m - row.bit_count() + n - i - len(part) < need:
            return -1
    return m - row.bit_count()


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether at least `least` of the words of the longer text match in order. a, b: word hashes."""
    if not len(a) or not len(b):
        return False
    need = int(np.ceil(least * max(len(a), len(b)) - 1e-9))
    if min(len(a), len(b)) < need:
        return False
    # what both have at their start and at their end is part of a best alignment
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    head = int(differ[0]) if len(differ) else m
    m -= head
    differ = np.flatnonzero(a[len(a) - m :][::-1] != b[len(b) - m :][::-1])
    tail = int(differ[0]) if len(differ) else m
    a, b, need = a[head : len(a) - tail], b[head : len(b) - tail], need - head - tail
    if need <= 0:
        return True
    if (Counter(a.tolist()) & Counter(b.tolist())).total() < need:
        return False
    widest = len(a) + len(b) - 2 * need
    width = 32
    while True:
        if band_lcs(a, b, min(width, widest), need if width >= widest else 0) >= need:
            return True
        if width >= widest:
            return False
        width *= 8


def join_unique(rows: DataFrame, unique: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Join rows to a table with one row for the key, where any share of the rows may have the same key; `size` is the
    column of `unique` that tells how many of the `total` rows have its key.

    The keys of over HOT_SHARE of all rows number fewer than 1 / HOT_SHARE. Their part of `unique` is broadcast, and a
    filter by these few keys keeps their rows from the shuffle; most often there are none, and it is one plain join."""
    (key,) = keys
    hot = unique.filter(F.col(size) > max(1.0, total * HOT_SHARE))
    found = [r[0] for r in hot.select(key).collect()]  # fewer than 1 / HOT_SHARE
    if not found:
        return rows.join(unique, key)
    rare = F.coalesce(~F.col(key).isin(found), F.lit(True))
    return rows.join(F.broadcast(hot), key).unionByName(rows.filter(rare).join(unique.filter(F.col(size) <= max(1.0, total * HOT_SHARE)), key))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are linked. texts: (node, text)."""
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def scan(batches):
        hasher, last = Hasher(), (None, None)
        for batch in batches:
            out_a, out_b = [], []
            for a, b, ta, tb in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if last[0] != b:
                    last = (b, hasher.hashes(hasher.words(tb)))
                if similar(hasher.hashes(hasher.words(ta)), last[1]):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], ["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(scan, "a binary, b binary")


def buckets(nodes: DataFrame) -> DataFrame:
    """(key, node, size, first, last, n): the members of each bucket of n > 1 nodes with its first and last node; size is the
    number of words of a member."""
    members = nodes.select("node", F.col("n_words").alias("size"), F.explode("sketches").alias("key"))
    ends = members.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    ends = cut(ends, "buckets")
    return join_unique(members, ends, ["key"], "n", max(1, members.count()))


def candidates(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of the first round: all pairs of buckets of two or three; else each node with that first node
    which most of its buckets begin with, so n copies of one text make n pairs."""
    small = members.filter("n <= 3").select(F.col("node").alias("a"), "last", F.explode(F.array_distinct(F.array("first", "last"))).alias("b"))
    small = small.filter("a <> b AND a <> last").select("a", "b")
    large = members.filter("n > 3 AND node <> first").groupBy("node", "first").agg(F.count(F.lit(1)).alias("shared"))
    large = large.groupBy("node").agg(F.max(F.struct("shared", "first")).alias("most")).select(F.col("node").alias("a"), F.col("most.first").alias("b"))
    return small.unionByName(large).distinct()


def linkable(size_a: Column, bits_a: Column, size_b: Column, bits_b: Column) -> Column:
    """Whether texts of these numbers and bitmaps of words can be linked: at most size - need of a text's words are unmatched,
    and a word is if the other text lacks its bit."""
    need = F.ceil(SIMILARITY * F.greatest(size_a, size_b) - 1e-9)
    lacking = lambda a, b: sum((F.bit_count(F.get(a, F.lit(k)).bitwiseAND(F.bitwise_not(F.get(b, F.lit(k))))) for k in range(BITS // 64)), F.lit(0))
    return (F.least(size_a, size_b) >= need) & (lacking(bits_a, bits_b) <= size_a - need) & (lacking(bits_b, bits_a) <= size_b - need)


def possible(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (a, b) that can be linked. words: (node, size, bits, sketches)."""
    of = lambda end: words.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}"), F.col("bits").alias(f"bits_{end}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a")
    return both.filter(linkable(F.col("size_a"), F.col("bits_a"), F.col("size_b"), F.col("bits_b"))).select("a", "b")


def new_candidates(members: DataFrame, tested: DataFrame) -> DataFrame:
    """Pairs (a, b) of members (key, node, size, bits, sketches, root, ends, is_end) of another class than the end b, with which
    they can be linked, that are not in tested, with the classes root_a and root_b. Of the buckets that two nodes share,
    the one of the smallest key makes their pair."""
    before = lambda keys: F.filter(keys, lambda k: k < F.col("key"))
    meet = F.filter("ends", lambda e: (e["root"] != F.col("root")) & (~F.col("is_end") | (F.col("node") < e["node"])) & linkable(e["size"], e["bits"], F.col("size"), F.col("bits")) & ~F.arrays_overlap(before(e["sketches"]), before(F.col("sketches"))))
    pairs = members.select(F.col("node").alias("a"), "root", F.explode(meet).alias("end"))
    pairs = pairs.select("a", F.col("end.node").alias("b"), F.col("root").alias("root_a"), F.col("end.root").alias("root_b"))
    pairs = pairs.withColumn("low", F.least("a", "b")).withColumn("high", F.greatest("a", "b")).dropDuplicates(["low", "high"])
    return pairs.join(tested.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")), ["low", "high"], "left_anti").drop("low", "high")


def with_links(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root, degree) of the nodes that have links."""
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    degrees = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return cut(degrees.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "linked")


def linked(members: DataFrame, pairs: DataFrame, texts: DataFrame, words: DataFrame) -> DataFrame:
    """(node, root) of the nodes with a link to another in their bucket. pairs: the candidates of the first round; words: as
    for `possible`.

    A pair that is left untested joins two nodes of one class."""
    links = cut(verified(possible(pairs.select("a", "b"), words), texts), "verified")
    roots, tested, slots, whole = components(links), pairs, FIRST_SLOTS, 0
    state = with_links(roots, links)
    left = members.filter("n > 3").select("key", "node", "size")
    while True:
        left = left.select("key", "node", "size").join(state, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"), F.coalesce("degree", F.lit(0)).alias("degree"))
        left = cut(left, "members-left")
        several = cut(left.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high").select("key", "n"), "open-buckets")
        if several.isEmpty():
            return roots
        total = left.count()
        left = cut(join_unique(left, several, ["key"], "n", total).join(words.select("node", "bits", "sketches"), "node"), "open-members")
        rank = F.struct("degree", "node", "root", "size", "bits", "sketches")
        is_hot, is_whole = F.col("n") > total * HOT_SHARE, F.col("n") <= whole
        n_hot, n_whole, largest = several.agg(F.count_if(is_hot & ~is_whole), F.coalesce(F.sum(F.when(is_hot & is_whole, F.col("n"))), F.lit(0)), F.max("n")).first()
        if n_whole * END_BYTES > ENDS_BYTES // 2:  # too many for a broadcast
            whole, n_hot = 0, several.filter(is_hot).count()
        slots = min(slots, max(8, ENDS_BYTES // (4 * END_BYTES * max(1, n_hot))))
        slot = F.xxhash64("node", "key")
        ends = left.groupBy("key", F.when(F.col("n") <= whole, slot).otherwise(F.pmod(slot, F.lit(slots))).alias("slot")).agg(F.max(rank).alias("most"), F.min(rank).alias("least"), F.first("n").alias("n"))
        ends = ends.select("key", "n", F.explode(F.array_distinct(F.array("most", "least"))).alias("end"))
        ends = cut(ends.groupBy("key").agg(F.collect_list("end").alias("ends"), F.first("n").alias("n")), "new-ends")
        met = join_unique(left.drop("n"), ends, ["key"], "n", total).withColumn("is_end", F.exists("ends", lambda e: e["node"] == F.col("node")))
        # one pair of each node and class first: where it is a link, the node's other pairs with that class need no test
        first = F.row_number().over(W.partitionBy("a", "root_b").orderBy("b")) == 1
        pairs = cut(new_candidates(met, tested).withColumn("first", first), "candidates")
        found = cut(verified(pairs.filter("first").select("a", "b"), texts), "verified")
        rest = pairs.filter("NOT first")
        if not found.isEmpty():
            links, roots = links.unionByName(found), joined(roots, found)
            for end in ("a", "b"):
                rest = rest.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"new_{end}")), end, "left").withColumn(f"root_{end}", F.coalesce(f"new_{end}", f"root_{end}"))
            rest = rest.filter("root_a <> root_b")
        rest = cut(rest.select("a", "b"), "candidates")
        more = None if rest.isEmpty() else cut(verified(rest, texts), "verified")
        if more is not None and not more.isEmpty():
            links, roots = links.unionByName(more), joined(roots, more)
        if largest <= whole:
            return roots
        left = met.filter("NOT is_end").select("key", "node", "size")
        slots, whole = min(8 * slots, MOST_SLOTS), WHOLE
        state = with_links(roots, links)


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after further links (a, b): only the classes that a new link joins are worked on."""
    ends = links
    for end in ("a", "b"):
        ends = ends.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    new = components(ends.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).filter("a <> b"))
    moved = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("new_root")), "root", "left").select("node", F.coalesce("new_root", "root").alias("root"))
    # nodes that were a class of their own, or the root of one, have no row in roots
    return cut(moved.unionByName(new.join(roots.select("node"), "node", "left_anti")), "roots")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of links (a, b): the smallest node of their component.

    Up to FEW_LINKS links are worked on in one task. Beyond, large-star and small-star steps in turn: each moves links to the smallest neighbour, so a component becomes a star
    around its smallest node in a few rounds. The links of a node with very many of them stay where they are: its
    smallest neighbour is broadcast to them.
    """
    links = cut(links.select("a", "b").distinct(), "links")
    if links.count() <= FEW_LINKS:
        return cut(links.coalesce(1).mapInArrow(_union_find, "node binary, root binary"), "roots")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "least")
        large = cut(join_unique(both.filter("b > a"), least, ["a"], "n", 2 * links.count()).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large-star")
        least = cut(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")  # b < a holds in large
        small = join_unique(large, least, ["a"], "n", large.count()).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        links = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _union_find(batches):
    parent: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([find(x) for x in nodes], pa.binary())], ["node", "root"])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash (xxhash64 of the text), class_id, class_size, n_texts, kept.

    class_id is the smallest id of the class. kept marks the document that stays: the one with that id (if rows repeat
    that id, those with the class's first text of that id).
    """
    rows = cut(signatures(docs, id_col, text_col), "signatures")
    nodes = cut(rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("rep"), F.count(F.lit(1)).alias("n"), F.first("n_words").alias("n_words"), F.first("bits").alias("bits"), F.first("sketches").alias("sketches")).select("node", F.col("rep.doc_id").alias("rep"), F.col("rep.text_hash").alias("rep_hash"), "n", "n_words", "bits", "sketches"), "nodes")
    members = cut(buckets(nodes.filter("n_words > 0")), "members")
    pairs = cut(candidates(members), "candidates")
    needed = members.select("node").distinct()
    reps = nodes.select("node", "rep", "rep_hash").join(needed, "node")
    texts = cut(_texts_of(docs, reps, id_col, text_col), "candidate-texts")
    roots = linked(members, pairs, texts, nodes.select("node", F.col("n_words").alias("size"), "bits", "sketches"))
    each = nodes.select("node", "rep", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = each.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node")).alias("first"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("n_texts"))
    unique = cut(join_unique(each, by_root, ["root"], "n_texts", nodes.count()).select("node", "n", F.col("first.rep").alias("class_id"), "class_size", "n_texts", (F.col("first.node") == F.col("node")).alias("stays")), "classes")
    out = join_unique(rows.select("doc_id", "text_hash", "node"), unique, ["node"], "n", rows.count())
    return out.select("doc_id", "text_hash", "class_id", "class_size", "n_texts", (F.col("stays") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))


def _texts_of(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text): the text of each node's first document. reps: (node, rep, rep_hash).

    Rows without an id are reduced to one per text first, so that no join has more rows than distinct texts and ids."""
    plain = docs.select(F.col(id_col).cast("long").alias("rep"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("rep_hash", F.xxhash64("text"))
    named = plain.filter("rep IS NOT NULL").join(reps.filter("rep IS NOT NULL"), ["rep", "rep_hash"]).select("node", "text")
    nameless = reps.filter("rep IS NULL").select("node", "rep_hash")
    unnamed = plain.filter("rep IS NULL").groupBy("rep_hash").agg(F.first("text").alias("text")).join(nameless, "rep_hash").select("node", "text")
    return named.unionByName(unnamed).dropDuplicates(["node"])


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class, all columns as they were."""
    kept = cut(classes(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct(), "kept")
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    found = row.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")), "left_semi")
    return found.dropDuplicates(["id", "hash"]).select("row.*")
