"""Whole texts to tokens through a table of their words, for executors' Arrow functions.

Byte-pair encoding never crosses the borders that a tokenizer's word pattern draws, so a text's tokens are those of
its words in order. Each worker encodes a word when it first meets it, many new words in one call of the library,
and looks it up from then on. The word patterns below are used for texts of plain Western characters only, where they
agree with the library's; any other text goes through the library as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow.compute as pc

# Letters and further characters of the plain range.
LETTER = "A-Za-zÀ-ÖØ-öø-ÿŒœ"
NOT_PLAIN = re.compile("[^\t-\r\x20-\x7eÀ-ÿŒœ–—‘’“”…€]")
#: The word pattern of a lower-casing tokenizer with word ends, on lower-cased plain text.
WORD = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{LETTER}]+|[0-9]|[^\s0-9{LETTER}]+")
#: A single blank between two other characters: no word of either pattern crosses its left side.
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters after which a long text is cut at the next safe place.
LONG = 1 << 20
#: Words that a worker keeps; a batch's further words are encoded for that batch alone.
KEEP = 300_000
BATCH_BYTES = 4 << 20


def chunks(text: str, size: int = LONG) -> Iterator[str]:
    """The text in parts of about `size` characters, cut where no word crosses; whole where there is no such place."""
    at = 0
    while len(text) - at > size and (m := SAFE_CUT.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def balanced(batches, size: int = BATCH_BYTES) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of Arrow batches with columns id and text, regrouped by bytes of UTF-8; null texts are empty. Only
    the rows of one group are Python objects at a time."""
    ids, texts, held = [], [], 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, done = 0, 0
        while at < b.num_rows:
            stop = min(int(np.searchsorted(ends, done + size - held)) + 1, b.num_rows)
            part = b.slice(at, stop - at)
            ids += part.column(0).to_pylist()
            texts += [t or "" for t in part.column(1).to_pylist()]
            held += int(ends[stop - 1]) - done
            at, done = stop, int(ends[stop - 1])
            if held >= size:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def tokenizer(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


class _Table:
    """Word -> value, filled on demand."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = tokenizer(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.known: dict = {}

    def plain(self, text: str) -> bool:
        return (text.isascii() and text.isprintable() or not NOT_PLAIN.search(text)) and not any(s in text for s in self.special)

    def lookup(self, words: list[list[str]]) -> dict:
        new = list(set().union(*words).difference(self.known)) if words else []
        if not new:
            return self.known
        found = {}
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            found.update(zip(part, self.values(part), strict=True))
        if len(self.known) + len(found) <= KEEP:
            self.known.update(found)
            return self.known
        return _Both(self.known, found)


class _Both(dict):
    """The kept words and those of one batch."""

    def __init__(self, known: dict, found: dict):
        super().__init__(found)
        self.known = known

    def __missing__(self, word):
        return self.known[word]


class WordIds(_Table):
    """Ids of whole texts, as little-endian bytes, for a tokenizer whose words end in a marked token."""

    def __init__(self, path: str):
        super().__init__(path)
        size = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)
        self.ends[[i for w, i in self.tok.get_vocab().items() if w.endswith("</w>")]] = True

    def values(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tok.encode(" ".join(words), add_special_tokens=False).ids, self.dtype)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return [self.whole(w) for w in words]
        data, width = ids.tobytes(), self.dtype.itemsize
        at = [0, *(ends * width).tolist()]
        return [data[a:b] for a, b in zip(at, at[1:])]

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        todo, words = [], []
        for k, t in enumerate(texts):
            if self.plain(t):
                for part in chunks(t):
                    todo.append(k)
                    words.append(WORD.findall(part.lower()))
            else:
                out[k] = self.whole(t)
        get = self.lookup(words).__getitem__
        for k, w in zip(todo, words):
            got = b"".join(map(get, w))
            out[k] = got if out[k] is None else out[k] + got
        return out
