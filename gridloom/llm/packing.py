"""Hierarchical packing of documents into sequences of several context sizes, the tiers.

Each task encodes its documents and fills a pool of bounded size. A document's full windows become sequences of
their own; its rest is routed to the shortest tier that holds it. Tiers are packed from the longest to the shortest: the
pieces of a tier open windows of its own length, longest first and each where it fits best, and the gaps that are
left in these windows are filled with the longest pieces of shorter tiers that fit. Windows that still have gaps are filled
by cutting pieces of the tier's emptiest windows; what these windows lose last goes on to the next tier. So every
sequence is exactly as long as its tier, a power of two, and needs no padding, and a short document stays in a short
context unless it fills a gap. The pieces left of the shortest tier go to the next pool; a task's last ones are dealt
into sequences of power-of-two lengths. The sequences of each tier are dealt to step groups of equal numbers, balanced by
attention cost (the squared piece lengths).

Nothing is shuffled and no key decides where a document goes, so no source or group of copies can be hot; a task
holds one pool. Sequence ids are the partition's number times 2**33 plus a count, so a task that runs again gives
the same ids.

Defined results: a null text is the empty text; each document has at least its end token. Null and repeated ids pass
through; repeated rows are packed as separate documents. An empty input gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.words import WordIds, balanced

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window int, tier int, step_group long"
TIERS = (256, 512, 1024, 2048)
END = 1
#: Tokens in a task's pool.
POOL = 1 << 21
#: Sequences in a step group.
STEP = 8


class Piece:
    """Tokens start .. start + length of a document."""

    __slots__ = ("doc_id", "ids", "start", "length")

    def __init__(self, doc_id, ids: np.ndarray, start: int, length: int):
        self.doc_id, self.ids, self.start, self.length = doc_id, ids, start, length

    def split(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.ids, self.start, n), Piece(self.doc_id, self.ids, self.start + n, self.length - n)


def tier_of(length: int, tiers: tuple[int, ...]) -> int:
    return next(t for t in tiers if t >= length)


def best_fit(pieces: list[Piece], window: int, packs: list[list[Piece]] = (), grow: bool = True) -> tuple[list[list[Piece]], list[Piece]]:
    """Put pieces, longest first, each into the pack whose gap it fits best; a piece that fits none opens a pack, or is
    returned if `grow` is false. Bit g of `gaps` is set while a pack with g free tokens exists."""
    by_gap: list[list[list[Piece]]] = [[] for _ in range(window + 1)]
    gaps, left = 0, []
    for pack in packs:
        gap = window - sum(p.length for p in pack)
        by_gap[gap].append(pack)
        gaps |= 1 << gap
    for p in sorted(pieces, key=lambda p: -p.length):
        fits = gaps >> p.length
        if fits:
            gap = p.length + (fits & -fits).bit_length() - 1
            pack = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps &= ~(1 << gap)
        elif grow:
            gap, pack = window, []
        else:
            left.append(p)
            continue
        pack.append(p)
        by_gap[gap - p.length].append(pack)
        gaps |= 1 << (gap - p.length)
    return [pack for packs in by_gap for pack in packs], left


def pack_tiers(pieces: list[Piece], tiers: tuple[int, ...]) -> tuple[dict[int, list[list[Piece]]], list[Piece]]:
    """Full windows of each tier, and the pieces left of the shortest tier."""
    routed: dict[int, list[Piece]] = {t: [] for t in tiers}
    for p in pieces:
        routed[tier_of(p.length, tiers)].append(p)
    out, left = {}, []
    for k in range(len(tiers) - 1, -1, -1):
        tier = tiers[k]
        packs, _ = best_fit(routed[tier], tier)
        for t in reversed(tiers[:k]):
            packs, routed[t] = best_fit(routed[t], tier, packs, grow=False)
        out[tier], left = close_gaps(packs, tier)
        if k:
            for p in left:  # of fewer than `tier` tokens in all
                while p.length > tiers[k - 1]:
                    p, rest = p.split(tiers[k - 1])
                    routed[tiers[k - 1]].append(p)
                    p = rest
                routed[tier_of(p.length, tiers)].append(p)
    return out, left


def close_gaps(packs: list[list[Piece]], window: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Fill gaps with pieces of the emptiest windows, cut where needed. Returns the full windows and the pieces left."""
    size = [sum(p.length for p in pack) for pack in packs]
    order = sorted(range(len(packs)), key=lambda k: -size[k])
    first, last = 0, len(order) - 1
    while first < last:
        k, donor = order[first], order[last]
        if size[k] == window:
            first += 1
            continue
        if not packs[donor]:
            last -= 1
            continue
        p = packs[donor].pop()
        gap = window - size[k]
        if p.length > gap:
            p, rest = p.split(gap)
            packs[donor].append(rest)
        packs[k].append(p)
        size[k] += p.length
        size[donor] -= p.length
    full = [packs[k] for k in order if packs[k] and size[k] == window]
    return full, [p for k in order if packs[k] and size[k] < window for p in packs[k]]


def powers_of_two(pieces: list[Piece], window: int) -> list[list[Piece]]:
    """Deal fewer than `window` tokens into sequences of power-of-two lengths, the longest first."""
    left, todo, out = sum(p.length for p in pieces), pieces[::-1], []
    while left:
        need = 1 << (left.bit_length() - 1)
        left -= need
        pack = []
        while need:
            p = todo.pop()
            if p.length > need:
                p, rest = p.split(need)
                todo.append(rest)
            pack.append(p)
            need -= p.length
        out.append(pack)
    return out


def step_groups(packs: list[list[Piece]], first: int) -> list[int]:
    """Group number of each sequence: dealt to and fro in order of attention cost."""
    n = -(-len(packs) // STEP)
    order = sorted(range(len(packs)), key=lambda k: -sum(p.length**2 for p in packs[k]))
    out = [0] * len(packs)
    for rank, k in enumerate(order):
        lap, at = divmod(rank, n)
        out[k] = first + (at if lap % 2 == 0 else n - 1 - at)
    return out


class Packer:
    """Pool of one task. Emits rows of SCHEMA as Arrow batches."""

    def __init__(self, tiers: tuple[int, ...], base: int):
        self.window, self.tiers, self.next, self.group = tiers[-1], tiers, base, base
        self.full: list[list[Piece]] = []
        self.rests: list[Piece] = []
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        whole = len(ids) // self.window * self.window
        self.full += [[Piece(doc_id, ids, k, self.window)] for k in range(0, whole, self.window)]
        if len(ids) > whole:
            self.rests.append(Piece(doc_id, ids, whole, len(ids) - whole))
        self.held += len(ids)

    def flush(self, final: bool = False) -> pa.RecordBatch:
        by_tier, left = pack_tiers(self.rests, self.tiers)
        by_tier[self.window] += self.full
        self.full, self.rests, self.held = [], left, sum(p.length for p in left)
        if final:
            for pack in powers_of_two(left, self.window):
                by_tier.setdefault(sum(p.length for p in pack), []).append(pack)
        rows = []
        for tier in sorted(by_tier, reverse=True):
            groups = step_groups(by_tier[tier], self.group)
            self.group += -(-len(groups) // STEP)
            for pack, group in zip(by_tier[tier], groups):
                at = 0
                for p in pack:
                    crc = zlib.crc32(p.ids[p.start : p.start + p.length].astype("<u4").tobytes())
                    rows.append((p.doc_id, p.start, p.length, crc, len(p.ids), self.next, at, tier, tier_of(p.length, self.tiers), group))
                    at += p.length
                self.next += 1
        kinds = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.int64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)


def pack_documents(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; `window` is the sequence's own length, `tier` the shortest context size that holds the piece."""
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers are rising powers of two")

    def scan(batches):
        table = WordIds(tokenizer_path)
        end = np.array([END], table.dtype).tobytes()
        packer = Packer(tiers, TaskContext.get().partitionId() << 33)
        for ids, texts in balanced(batches):
            for doc_id, data in zip(ids, table.encode(texts), strict=True):
                packer.add(doc_id, np.frombuffer(data + end, table.dtype))
            if packer.held >= POOL:
                yield packer.flush()
        yield packer.flush(final=True)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(scan, SCHEMA)
