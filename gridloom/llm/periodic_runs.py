"""Periodic runs of words in a text, by the branching-tandem test on an enhanced suffix array.

A run is a stretch of words with smallest period q, at least max(24, 3 q) words long, that no neighbouring word
extends. Every run, from length 2 q up, ends with a square whose next word breaks the period: the suffixes at its two
halves lie in one LCP interval of depth q, in different children. So for each LCP interval, the suffixes i of all
children but the largest are taken and the inverse suffix array tells whether i + depth or i - depth lies in the same
interval and another child. Intervals are met bottom-up on a stack of open ones; no tree is built. The squares found are
rotated to the left while the period holds and merged into runs; a square whose root is a power of a shorter one that
ends at the same word is part of that one's run.

A run of at least max(24, 3 q) words has each of its words in a window of 16 words that stands twice in the document.
So one hash per window finds the stretches that can hold runs, for many documents at once, and only these stretches get
suffix arrays; equal hashes of different windows only add stretches.

Each document is read by one task, whose memory follows the longest text, nothing is shuffled.

Defined results: a null, empty or blank text has no words and no run: the four columns of the best run are null, the
hashes are those of the empty string. A document with a null id is not rewritten by `repeated_tail`. Repeated rows pass
through, one row per input row; an empty input gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.words import balanced

#: Least length of a run in words, and in periods.
LEAST, TIMES = 24, 3
#: Every word of a run lies in a window of so many words that stands twice: the least of max(2 q, LEAST - q) over all q.
WINDOW = 16

SCHEMA = "doc_id long, n_words long, n_dropped long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten with a tail that repeats; the others as they are."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def repeated_stretches(codes: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of stretches that windows cover which stand twice in one document. owner: the document of each word."""
    n = len(codes) - WINDOW + 1
    if n < 2:
        return []
    h, wide = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    while wide < WINDOW:
        h = (h[:-wide] ^ (h[:-wide] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (h[wide:] ^ (h[wide:] >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        wide *= 2
    inside = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    h = h[inside] + owner[inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = inside[twice]
    if not len(at):
        return []
    new = np.flatnonzero((at[1:] > at[:-1] + WINDOW) | (owner[at[1:]] != owner[at[:-1]])) + 1
    return list(zip(at[np.r_[0, new]].tolist(), (at[np.r_[new - 1, len(at) - 1]] + WINDOW).tolist()))


def suffix_array(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, its inverse, and the words that each suffix has in common with the one before it; by doubling."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int32)
    levels, h = [rank], 1
    while True:
        key = rank.astype(np.int64) * (n + 1)
        key[: max(n - h, 0)] += rank[h:] + 1
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int32)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        rank, h = new, 2 * h
        if rank[order[-1]] == n - 1:
            break
        levels.append(rank)
    a, b, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(n, np.int64)
    for k in reversed(range(len(levels))):
        level, fit = levels[k], np.flatnonzero((a < n) & (b < n))
        fit = fit[level[a[fit]] == level[b[fit]]]
        a[fit] += 1 << k
        b[fit] += 1 << k
        lcp[1 + fit] += 1 << k
    return order, rank, lcp


def squares(x: np.ndarray) -> set[tuple[int, int]]:
    """(end, period) of all squares that the next word breaks."""
    order, inverse, lcp = (v.tolist() for v in suffix_array(x))
    n, out = len(order), set()
    lcp.append(0)
    depths, lefts, splits = [0], [0], [[]]  # open intervals
    for k in range(1, n + 1):
        here, left = lcp[k], k - 1
        while depths[-1] > here:
            d, left, cuts = depths.pop(), lefts.pop(), splits.pop()
            if 2 * d <= n:
                ends = [*cuts, k]
                starts = [left, *cuts]
                largest = max(range(len(ends)), key=lambda c: ends[c] - starts[c])
                for c in range(len(ends)):
                    if c != largest:
                        lo, hi = starts[c], ends[c]
                        for i in order[lo:hi]:
                            j = i + d
                            if j < n and left <= (r := inverse[j]) < k and not lo <= r < hi:
                                out.add((j + d, d))
                            j = i - d
                            if j >= 0 and left <= (r := inverse[j]) < k and not lo <= r < hi:
                                out.add((i + d, d))
        if depths[-1] == here:
            splits[-1].append(k)
        else:
            depths.append(here)
            lefts.append(left)
            splits.append([k])
    return out


def _holds_back(x: np.ndarray, at: int, period: int) -> int:
    """The first position from which x up to `at` has the period."""
    step = 32
    while at:
        lo = max(0, at - step)
        bad = np.flatnonzero(x[lo:at] != x[lo + period : at + period])
        if len(bad):
            return lo + int(bad[-1]) + 1
        at, step = lo, step * 4
    return 0


def runs(x: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of x, by start and period."""
    if len(x) < 2:
        return []
    out, last, here = [], -1, []
    for end, d in sorted(squares(x)):
        if end != last:
            last, here = end, []
        if any(d % q == 0 and end - 2 * d >= s for s, q in here):
            continue  # the root is a power of a shorter one
        start = _holds_back(x, end - 2 * d, d)
        here.append((start, d))
        if end - start >= max(least, times * d):
            out.append((start, end - start, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_of(documents: list[list[bytes]]) -> dict[int, list[tuple[int, int, int]]]:
    """The runs of each of the documents that have any, by its number."""
    known: dict[bytes, int] = {}
    codes = np.array([known.setdefault(w, len(known)) for words in documents for w in words], np.int64)
    first = np.cumsum([0, *(len(words) for words in documents)])
    owner = np.repeat(np.arange(len(documents)), np.diff(first))
    parts: dict[int, list[tuple[int, int]]] = {}
    for lo, hi in repeated_stretches(codes, owner):
        parts.setdefault(int(owner[lo]), []).append((lo, hi))
    out = {}
    for k, stretches in parts.items():
        borders = range(len(known), len(known) + len(stretches))  # each stands once, so nothing holds across it
        joined = np.concatenate([np.append(codes[lo:hi], b) for (lo, hi), b in zip(stretches, borders)])
        began = np.cumsum([0, *(hi - lo + 1 for lo, hi in stretches)])
        found = []
        for start, length, period in runs(joined):
            s = int(np.searchsorted(began, start, "right")) - 1
            found.append((start - int(began[s]) + stretches[s][0] - int(first[k]), length, period))
        if found:
            out[k] = found
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def find_runs(docs: DataFrame, rewrite=repeated_tail, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: number of its runs, the one of the greatest exponent, and digests of all runs and of the
    text without repetitions. rewrite: (id, words) -> words, applied first."""

    def scan(batches):
        for ids, texts in balanced(batches):
            documents = [rewrite(i, t.encode().split()) for i, t in zip(ids, texts)]
            found = runs_of(documents)
            rows = []
            for k, (i, words) in enumerate(zip(ids, documents)):
                own = found.get(k, [])
                kept = collapsed(words, own)
                best = max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                told = "".join(f"{s},{n},{q}\n" for s, n, q in own)
                rows.append((i, len(words), len(words) - len(kept), len(own), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
            kinds = [pa.int64()] * 8 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(scan, SCHEMA)
