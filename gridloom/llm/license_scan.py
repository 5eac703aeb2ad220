"""License scans: an exact set-similarity join of text blocks with license templates.

Blocks are the lines and the blank-line paragraphs of a text; a template is a set of words. A block meets a template if
it contains at least `threshold` of the template's words. The words of all templates are ordered by their frequency
over all texts, rarest first (ties by word). A block that meets a template of n words has at least m = ceil(threshold
n) of them, so it has one of the first n - m + 1 (prefix filter) and it has m words at all (length filter). The block's
words that templates have are put in the same order: where the first word that both have is number i of the template
and number j of the block's b words, they share at most 1 + min(n - i - 1, b - j - 1), which has to reach m (positional
filter). An index from prefix words to (template, position) gives candidates, which are counted exactly. Only templates
are indexed; what is broadcast is as large as they are.

Besides, places where the words of a base phrase stand in a row are reported.

Defined results: a null text is the empty text with no words; labels are the empty string and the score is 0 where
nothing is found. Null and repeated ids pass through, one row per input row; an empty input gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.words import balanced

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TO_LOWER = {c: c + 32 for c in range(65, 91)}
THRESHOLD = 0.8

# Phrases with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Words of common license notices, with the label of each.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "this work is licensed under the creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under the creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under the creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("reserved", "all rights reserved"),
]

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(TO_LOWER) if not text.isascii() else text.lower())


def word_frequency(texts: DataFrame, vocabulary: frozenset[str]) -> dict[str, int]:
    """Occurrences over all texts of the templates' words; at most one row per word and task is shuffled."""

    def scan(batches):
        counts: dict[str, int] = defaultdict(int)
        for b in batches:
            for t in b.column(0).to_pylist():
                for w in words_of(t or ""):
                    if w in vocabulary:
                        counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    counted = texts.mapInArrow(scan, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in counted.collect()}  # at most the templates' words


class Index:
    """Templates behind the three filters."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[str, int], threshold: float):
        self.templates = []
        self.prefix: dict[str, list[tuple[int, int]]] = defaultdict(list)
        vocabulary = {w for _, text in templates for w in text.split()}
        self.rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
        for k, (label, text) in enumerate(templates):
            tokens = sorted(set(text.split()), key=self.rank.__getitem__)
            need = math.ceil(threshold * len(tokens) - 1e-9)
            self.templates.append((label, frozenset(tokens), need))
            for i, w in enumerate(tokens[: len(tokens) - need + 1]):
                self.prefix[w].append((k, i))
        self.first = frozenset(self.prefix)

    def candidates(self, block: set[str]) -> list[int]:
        """Templates that pass all three filters."""
        own = sorted(self.rank.keys() & block, key=self.rank.__getitem__)
        out, seen = [], set()
        for j, w in enumerate(own):
            for k, i in self.prefix.get(w, ()):
                if k in seen:
                    continue
                seen.add(k)  # w is the first word in order that both have
                _, tokens, need = self.templates[k]
                if len(own) >= need and 1 + min(len(tokens) - i - 1, len(own) - j - 1) >= need:
                    out.append(k)
        return out

    def matches(self, block: set[str]) -> dict[int, float]:
        """Containment of each template that the block meets."""
        out = {}
        for k in self.candidates(block):
            _, tokens, need = self.templates[k]
            shared = len(tokens & block)
            if shared >= need:
                out[k] = shared / len(tokens)
        return out

    def scan(self, text: str) -> dict[int, float]:
        best: dict[int, float] = {}
        for part in paragraphs(text):
            if self.first.isdisjoint(words_of(part)):
                continue
            for block in dict.fromkeys([part, *part.split("\n")]):
                for k, c in self.matches(set(words_of(block))).items():
                    best[k] = max(c, best.get(k, 0.0))
        return best


def paragraphs(text: str) -> list[str]:
    return re.split(r"\n[ \t\r]*\n", text)


def places(words: list[str], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(index of the first word, label) of each place of a phrase."""
    out = []
    for phrase, label in phrases.items():
        p = phrase.split()
        at = -1
        if p[-1] not in words:
            continue
        while True:
            try:
                at = words.index(p[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(p)] == p:
                out.append((at, label))
    return out


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = BASE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document of SCHEMA. score: 1 where a phrase stands, else the best containment of a met template."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    vocabulary = frozenset(w for _, t in templates for w in t.split())
    index = Index(templates, word_frequency(docs.select(text_col), vocabulary), threshold)
    held = docs.sparkSession.sparkContext.broadcast(index)

    def scan(batches):
        ix = held.value
        for ids, texts in balanced(batches):
            out = []
            for doc_id, text in zip(ids, texts):
                words = words_of(text)
                base = places(words, phrases)
                met = {} if ix.first.isdisjoint(words) else ix.scan(text)
                own = {label for _, label in base}
                labels = own | {ix.templates[k][0] for k in met}
                at = [a for a, _ in base]
                score = 1.0 if base else max(met.values(), default=0.0)
                out.append((doc_id, len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), score))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    return rows.mapInArrow(scan, SCHEMA)
