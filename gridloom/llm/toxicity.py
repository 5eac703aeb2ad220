"""Toxicity of documents behind a noisy channel.

A character trigram model is counted over all texts. Words that may be disguised (signs beside letters, letters twice or
more in a row, single letters set apart by anything) are character lattices: each sign stands for itself, the letters it
imitates or nothing, a run of a letter for one or two of it, a gap between single letters for nothing. A Viterbi search
picks the most likely reading under the model. The text with its restored words is then scored. A text is read in pieces
between blanks, each distinct one once; tokens that letters set apart by blanks may span are one piece.

The score is a decision list: each five-character gram of a word (with blanks at the word's ends) has the lower limit
of the share of toxic documents among the labelled documents that contain it; a document scores the highest limit of
its grams, or the rate of documents without any listed gram. The list is learned by separate-and-conquer from a bounded
sample: the `SAMPLE_DOCS` labelled documents with the smallest hash of their id.

Defined results: a null text is the empty text and scores the rate of documents without known grams (0 if nothing
could be learned). A document with several labels counts as toxic if one says so; null labels and null ids are no
labels. Repeated rows are scored each; an empty input gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import cut

# Signs and the letters they imitate.
IMITATES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou", "#": "h"}
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâäæçèéêëíîïñòóôöùúûüœ"
SIGNS = re.escape("".join(IMITATES))
LETTER = "a-zß-öø-ÿœ"
#: Places where a word may be disguised: single letters (or signs) set apart, a sign beside a letter, a run of a letter.
SUSPECT = re.compile(
    rf"(?P<apart>(?<![{LETTER}])[{LETTER}](?:[^{LETTER}\s]+[{LETTER}]){{2,}}(?![{LETTER}])|(?<!\S)[{LETTER}{SIGNS}](?:[^\w{SIGNS}]+[{LETTER}{SIGNS}]|_+[{LETTER}{SIGNS}]){{2,}}(?![\w{SIGNS}]))"
    rf"|[{LETTER}][{SIGNS}]|[{SIGNS}][{LETTER}]|([{LETTER}])\2"
)
THRICE = re.compile(r"(.)\1\1", re.S)
ITEM = re.compile(rf"[{LETTER}{SIGNS}]")
WORD = re.compile(rf"[{LETTER}]{{2,}}")
#: The beginning of a token in which no two letters or signs meet; letters set apart by blanks span such tokens only.
LOOSE = re.compile(rf"(?:[^\w{SIGNS}]|_|[{LETTER}{SIGNS}](?![{LETTER}{SIGNS}]))*")
RUN = re.compile(r"(.)\1*", re.S)
TWICE = re.compile(r"(.)\1", re.S)
#: Letters or signs set apart, where they begin a token.
SPREAD = re.compile(rf"\s[{LETTER}{SIGNS}](?:[^\w{SIGNS}]+[{LETTER}{SIGNS}]|_+[{LETTER}{SIGNS}]){{2,}}(?![\w{SIGNS}])")
GRAM = 5
SAMPLE_DOCS = 15_000
#: Standard deviations below the observed share at which the limit lies.
Z2 = 4.0
MIN_LIMIT = 0.3
CACHE = 300_000
NOTHING = (0.0, 0)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_restored int"
#: Bits that a reading costs: a letter for its sign, a shortened run.
SIGN_COST, RUN_COST = 1.0, 0.5
#: Bits for a sign that is itself, a sign that is nothing and one of two letters that is nothing: at least what the
#: letter that is saved would take, so that common words with two of a letter stay as they are.
ITSELF_COST, NOTHING_COST, TWICE_COST = 4.0, 8.0, 6.0
#: How many times the bits a letter that the same word takes with two of a letter, if one of them is a disguise.
CLEARLY = 1.35
N = len(LETTERS) + 2  # 0: outside a word; last: any other letter
CODE = np.full(1 << 16, 0, np.int64)
for _c in range(1 << 16):
    if chr(_c).isalpha():
        CODE[_c] = N - 1
for _k, _ch in enumerate(LETTERS, 1):
    CODE[ord(_ch)] = _k


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def codes(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return CODE[np.minimum(x, 65535)]


def character_counts(texts: DataFrame) -> np.ndarray:
    """Trigram counts over all texts: each task adds up its own, at most N**3 rows a task."""

    def scan(batches):
        total = np.zeros(N**3, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                for at in range(0, len(t or ""), 1 << 20):
                    c = codes(" " + t[max(0, at - 2) : at + (1 << 20)].lower() + " ")
                    total += np.bincount(c[:-2] * N * N + c[1:-1] * N + c[2:], minlength=N**3)
        (at,) = total.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    out = np.zeros(N**3)
    for r in texts.mapInArrow(scan, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # at most N**3 rows
        out[r.gram] = r.n
    return out.reshape(N, N, N)


def trigram_bits(counts: np.ndarray) -> np.ndarray:
    """-log2 P(c | a, b), each order interpolated with the next lower one."""
    one = (counts.sum((0, 1)) + 1) / (counts.sum() + N)
    two = counts.sum(0)
    two = (two + 8 * one) / (two.sum(1, keepdims=True) + 8)
    three = (counts + 8 * two[None]) / (counts.sum(2, keepdims=True) + 8)
    return -np.log2(three).astype(np.float32)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Readings of each run of equal characters with their costs."""
    out = []
    for m in RUN.finditer(token):
        c, n = m[1], len(m[0])
        if c in IMITATES:
            out += [[*((x, SIGN_COST) for x in IMITATES[c]), (c, ITSELF_COST), ("", NOTHING_COST)]] * min(n, 2)
        elif n == 1:
            out.append([(c, 0.0)])
        else:
            out.append([(c, TWICE_COST), (c + c, 0.0)] if n == 2 else [(c, RUN_COST), (c + c, RUN_COST)])
    return out


@lru_cache(1 << 14)
def coded(run: str) -> list[list[tuple[str, float, tuple[int, ...]]]]:
    """The lattice of a run of equal characters, with the codes of its readings."""
    return [[(x, cost, tuple(codes(x).tolist())) for x, cost in readings] for readings in lattice(run)]


def set_apart(text: str) -> list[str]:
    """Letters set apart: with the signs among them, and without these, which may be what sets them apart."""
    return sorted({"".join(ITEM.findall(text)), "".join(c for c in text if c.isalpha())})


def viterbi(token: str, bits: np.ndarray, table: list[float] | None = None) -> str:
    """The reading with the fewest bits; states are the last two letters. table: the bits as a plain list."""
    table = bits.ravel().tolist() if table is None else table
    steps = [step for m in RUN.finditer(token) for step in coded(m[0][:3])]  # three stand for more
    best: dict[int, tuple[float, int]] = {0: (0.0, -1)}
    trail: list[tuple[int, str]] = []  # (place of the reading before, what this one added)
    for readings in [*steps, *coded(" ")]:
        after: dict[int, tuple[float, int]] = {}
        for state, (cost, at) in best.items():
            for letters, extra, added in readings:
                to, total = state, cost + extra
                for z in added:
                    k = to * N + z
                    total += table[k]
                    to = k % (N * N)
                if to not in after or total < after[to][0]:
                    trail.append((at, letters))
                    after[to] = (total, len(trail) - 1)
        best = after
    at = min(best.values())[1]
    out = []
    while at >= 0:
        at, letters = trail[at]
        out.append(letters)
    return "".join(reversed(out)).strip()


def bits_a_letter(word: str, bits: np.ndarray) -> float:
    c = codes(f"  {word} ")
    return float(bits[c[:-2], c[1:-1], c[2:]].mean())


@dataclass
class Model:
    bits: np.ndarray
    limits: dict[str, float] = field(default_factory=dict)
    base: float = 0.0


class Restorer:
    """Disguised words of a lower-cased text, restored."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.table, self.known, self.loose, self.seen = bits, bits.ravel().tolist(), {}, {}, {}

    def stays(self, word: str) -> bool:
        """Whether a word of letters, none more than twice in a row, surely reads as it stands: no two of a letter takes
        more bits than one of it. Each changes the three bits around it only, if no other two follow at once."""
        c, table, last = [0, *codes(word).tolist(), 0], self.table, -1
        for m in TWICE.finditer(word):
            k = m.start()
            b, x, d = c[k], c[k + 1], c[k + 3]
            if k == last or table[(b * N + x) * N + x] + table[(x * N + x) * N + d] + 1e-6 > TWICE_COST + table[(b * N + x) * N + d]:
                return False
            last = k + 2
        return True

    def restored(self, token: str) -> str:
        got = self.known.get(token)
        if got is None:
            plain = token.isalpha() and not THRICE.search(token)
            got = viterbi(token, self.bits, self.table) if any(c.isalpha() for c in token) and not (plain and self.stays(token)) else token
            if got != token and plain and bits_a_letter(token, self.bits) < CLEARLY * bits_a_letter(got, self.bits):
                got = token  # two of a letter are common; the shorter word has to be clearly the likelier one
            if len(self.known) < CACHE and len(token) < 100:
                self.known[token] = got
        return got

    def words(self, text: str) -> list[str]:
        out, after = [], -1
        for m in SUSPECT.finditer(text):
            if m.start() < after:
                continue
            a, b = m.span()
            apart = m["apart"]
            while not apart and a and not text[a - 1].isspace():
                a -= 1
            while not apart and b < len(text) and not text[b].isspace():
                b += 1
            after = b
            token = text[a:b].lstrip(".,;:?\"')(").rstrip(".,;:?!\"'()")
            if apart:
                out += {self.restored(t): 0 for t in set_apart(m["apart"])}
            elif SUSPECT.search(token) and (got := self.restored(token)) != token:
                out.append(got)
        return out

    def items(self, token: str) -> tuple[int, bool]:
        """How many letters and signs the token begins with, none beside another, and whether that is all of it."""
        got = self.loose.get(token)
        if got is None:
            m = LOOSE.match(token)
            got = len(ITEM.findall(m[0])), m.end() == len(token)
            if len(self.loose) < CACHE and len(token) < 100:
                self.loose[token] = got
        return got

    def pieces(self, lower: str) -> Counter[str]:
        """The parts of a text that can be read on their own, and how often each occurs: its tokens; or all tokens that
        three letters or signs set apart may span, which are loose but for the last one."""
        tokens = lower.split()
        out = Counter(tokens)
        if not SPREAD.search(" " + lower):
            return out
        loose = {t for t in out if self.items(t)[1]}
        at = [k for k, t in enumerate(tokens) if t in loose] if loose else []
        i = 0
        while i < len(at):
            first = at[i]
            while i + 1 < len(at) and at[i + 1] == at[i] + 1:
                i += 1
            part = tokens[first : at[i] + 2]
            i += 1
            if len(part) > 1 and sum(self.items(t)[0] for t in part) >= 3:
                out.subtract(part)
                out[" ".join(part)] += 1
        return +out

    def read(self, piece: str) -> tuple[list[str], int]:
        """(words of a piece as they stand and restored, number of restored ones)"""
        restored = self.words(piece) if SUSPECT.search(piece) else []
        if not restored:
            return WORD.findall(piece), 0
        return list(dict.fromkeys(w for t in (piece, *restored) for w in WORD.findall(t))), len(restored)


def grams_of(word: str) -> list[str]:
    w = f" {word} "
    return [w[k : k + GRAM] for k in range(len(w) - GRAM + 1)]


def all_words(text: str, restorer: Restorer) -> tuple[set[str], int]:
    found, n, seen = set(), 0, restorer.seen
    for piece, times in restorer.pieces(text.lower()).items():
        got = seen.get(piece)
        if got is None:
            got = restorer.read(piece)
            if len(seen) < CACHE // 4 and len(piece) < 100:
                seen[piece] = got
        found.update(got[0])
        n += got[1] * times
    return found, n


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(toxic, text) of the documents learned from; the sample's ids, at most `limit`, are broadcast."""
    each = labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = each.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.join(F.broadcast(chosen), "doc_id").select("toxic", "text")


def gram_table(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """(gram, toxic, clean): documents of either kind that contain the gram."""
    held = rows.sparkSession.sparkContext.broadcast(bits)

    def scan(batches):
        restorer, counts = Restorer(held.value), ({}, {})
        def flush():
            for kind in (0, 1):
                k, v = list(counts[kind]), list(counts[kind].values())
                zero = [0] * len(k)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(v if kind else zero, pa.int64()), pa.array(zero if kind else v, pa.int64())], ["gram", "toxic", "clean"])
                counts[kind].clear()
        for b in batches:
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                grams = {g for w in all_words(text or "", restorer)[0] for g in grams_of(w)}
                own = counts[int(toxic > 0)]
                for g in grams:
                    own[g] = own.get(g, 0) + 1
                if len(counts[0]) > 1_000_000:
                    yield from flush()
        yield from flush()

    return rows.mapInArrow(scan, "gram string, toxic long, clean long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def lower_limit(t: Column, n: Column) -> Column:
    """Wilson's lower limit of t / n."""
    p = t / n
    return (p + Z2 / (2 * n) - F.sqrt(Z2 * (p * (1 - p) + Z2 / (4 * n)) / n)) / (1 + Z2 / n)


def evidence(rows: DataFrame, bits: np.ndarray, candidates: list[str]) -> DataFrame:
    """(toxic, grams): the candidate grams of each document of the sample, as numbers."""
    held = rows.sparkSession.sparkContext.broadcast((bits, {g: k for k, g in enumerate(candidates)}))

    def scan(batches):
        restorer, number = Restorer(held.value[0]), held.value[1]
        for b in batches:
            found = []
            for text in b.column(1).to_pylist():
                found.append(sorted({number[g] for w in all_words(text or "", restorer)[0] for g in grams_of(w) if g in number}))
            yield pa.RecordBatch.from_arrays([pa.array([x > 0 for x in b.column(0).to_pylist()], pa.bool_()), pa.array(found, pa.list_(pa.int32()))], ["toxic", "grams"])

    return rows.mapInArrow(scan, "toxic boolean, grams array<int>")


def wilson(t: float, n: float) -> float:
    p = t / n
    return (p + Z2 / (2 * n) - (Z2 * (p * (1 - p) + Z2 / (4 * n)) / n) ** 0.5) / (1 + Z2 / n)


def decision_list(rows: list[tuple[bool, list[int]]], n_candidates: int) -> tuple[dict[int, float], float]:
    """Separate and conquer: take the candidate with the highest limit among the documents that no earlier one
    covers, until none reaches MIN_LIMIT. Grams that are toxic only by the company they keep are thus left out."""
    docs_of: list[list[int]] = [[] for _ in range(n_candidates)]
    for d, (_, grams) in enumerate(rows):
        for g in grams:
            docs_of[g].append(d)
    left = [True] * len(rows)
    counts = np.array([[sum(rows[d][0] for d in docs), len(docs)] for docs in docs_of] or np.zeros((0, 2)), float)
    whole = counts.copy()
    chosen: dict[int, float] = {}
    while len(counts):
        n = np.maximum(counts[:, 1], 1e-9)
        p = counts[:, 0] / n
        low = np.where(counts[:, 1] > 0, (p + Z2 / (2 * n) - np.sqrt(Z2 * (p * (1 - p) + Z2 / (4 * n)) / n)) / (1 + Z2 / n), 0)
        g = int(low.argmax())
        if low[g] < MIN_LIMIT:
            break
        chosen[g] = wilson(*whole[g])
        for d in docs_of[g]:
            if left[d]:
                left[d] = False
                for other in rows[d][1]:
                    counts[other] -= (rows[d][0], 1)
    rest = [t for (t, _), x in zip(rows, left) if x]
    return chosen, (sum(rest) + 0.5) / (len(rest) + 1) if rows else 0.0


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """What comes to the driver: N**3 counts, the grams of the bounded sample that reach MIN_LIMIT, and these grams of
    each of the sample's documents."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bits = trigram_bits(character_counts(rows.select("text")))
    chosen = cut(labelled_sample(rows, labels, limit), "toxicity-sample")
    low = lower_limit(F.col("toxic"), F.col("toxic") + F.col("clean"))
    top = gram_table(chosen, bits).withColumn("low", low).filter(F.col("low") >= MIN_LIMIT).orderBy(F.col("low").desc(), "gram").select("gram").collect()
    candidates = [r.gram for r in top]
    seen = [(r.toxic, r.grams) for r in evidence(chosen, bits, candidates).toLocalIterator()]
    limits, base = decision_list(seen, len(candidates))
    return Model(bits, {candidates[g]: w for g, w in limits.items()}, min(base, 0.49))


class Scorer:
    """Scores whole texts in a task."""

    def __init__(self, model: Model):
        self.model, self.restorer, self.seen = model, Restorer(model.bits), {}

    def of(self, word: str) -> float:
        limits = self.model.limits
        return max([limits[g] for g in grams_of(word) if g in limits], default=0.0)

    def score(self, text: str) -> tuple[float, int]:
        """(score, number of restored words)"""
        best, n, seen = self.model.base, 0, self.seen
        for piece, times in self.restorer.pieces(text.lower()).items():
            got = seen.get(piece)
            if got is None:
                words, restored = self.restorer.read(piece)
                got = max(map(self.of, words), default=0.0), restored
                if len(seen) < CACHE and len(piece) < 100:
                    seen[piece] = got if any(got) else NOTHING
            if got is not NOTHING:
                best, n = max(best, got[0]), n + got[1] * times
        return best, n


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_restored."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        scorer = Scorer(held.value)
        for b in batches:
            out = [scorer.score(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([s for s, _ in out], pa.float64()), pa.array([int(s >= 0.5) for s, _ in out], pa.int32()), pa.array([n for _, n in out], pa.int32())],
                ["doc_id", "held_out", "score", "predicted", "n_restored"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    return rows.mapInArrow(scan, SCHEMA)


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below 0.5, all columns as they were. Nothing is shuffled."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def scan(batches):
        scorer = Scorer(held.value)
        for b in batches:
            yield b.filter(pa.array([scorer.score(t or "")[0] < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)


def score(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    return predict(docs, fit(docs, labels, **columns), **columns)
