"""License scans by a positional index of rare words.

A template is a label, the words of a notice and the phrases that it can't be without. The corpus gives each template
word its inverse document frequency. The index has postings (template, position) of every template word. Of each file
its licence words are looked up from the rarest on, until every template of which it has words has ANCHORS of them:
each place of such a word, with each of its postings, says where the template would begin. There the postings of all
words around are intersected by their relative positions, with some slack in long notices; a place counts if they have
most of the template's IDF and the mandatory phrases stand there word for word.

Base phrases are templates whose phrase is the whole notice; they count wherever they stand.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.llm.shared import bounded_batches
from kilnwork.llm.textops import ALNUM, Words, slices, words

#: Base labels and phrases (fixed values).
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

#: Labels, notices and mandatory phrases of further templates (fixed values: the notices' own words).
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["licensed under the apache license version 2 0"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license as published by the free software foundation", "version 3 of the license"]),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license as published by the free software foundation", "version 2 of the license"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute this software"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international license"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc0", "licensed under cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]
#: Words of a file that say where a notice would begin, and the share of its IDF that a place must have.
ANCHORS, LEAST = 3, 0.6
#: Words that may have come or gone between two words of a notice, one for each so many words of it.
SLACK = 8


@dataclass
class Template:
    label: str
    words: list[str]
    phrases: list[list[str]]
    base: bool


def templates() -> list[Template]:
    made = [Template(label, p.split(), [p.split()], True) for label, p in BASE]
    return made + [Template(label, n.split(), [p.split() for p in ps], False) for label, n, ps in NOTICES]


def _hashes(ws: list[str]) -> np.ndarray:
    return words(pa.array(ws), ALNUM).hash


class Index:
    """Postings of template words, given the number of documents and of those that have each template word."""

    def __init__(self, found: list[Template], n_docs: int, having: dict[str, int]) -> None:
        self.templates = found
        vocabulary = sorted({w for t in found for w in t.words})
        idf_of = {w: math.log((n_docs + 1) / (having.get(w, 0) + 1)) + 1e-3 for w in vocabulary}
        self.idf = [np.array([idf_of[w] for w in t.words]) for t in found]
        self.phrases = [[[w.encode() for w in p] for p in t.phrases] for t in found]
        # Words by number, the rarest first, and their hashes in order.
        names = sorted(vocabulary, key=lambda w: (-idf_of[w], w))
        hashes = _hashes(names)
        order = np.argsort(hashes)
        self.keys, self.number = hashes[order], order
        number = {w: i for i, w in enumerate(names)}
        self.postings: list[dict[int, list[int]]] = [{} for _ in names]
        for i, t in enumerate(found):
            for at, w in enumerate(t.words):
                self.postings[number[w]].setdefault(i, []).append(at)
        self.distinct = [len(set(t.words)) for t in found]

    def scan(self, w: Words) -> list[tuple[int, list[tuple[int, int]], dict[str, float]]]:
        """For each text: words, places (start, base template), and the score of each further label."""
        at = np.minimum(np.searchsorted(self.keys, w.hash), len(self.keys) - 1)
        hits = np.flatnonzero(self.keys[at] == w.hash)
        word = self.number[at[hits]]
        cuts = np.searchsorted(hits, w.first)
        out = []
        for t, n in enumerate(w.counts.tolist()):
            a, b = cuts[t], cuts[t + 1]
            out.append((n, *self._file(w, int(w.first[t]), int(w.first[t + 1]), hits[a:b], word[a:b])))
        return out

    def _file(self, w: Words, begin: int, end: int, places: np.ndarray, word: np.ndarray) -> tuple[list[tuple[int, int]], dict[str, float]]:
        base: list[tuple[int, int]] = []
        labels: dict[str, float] = {}
        have = np.unique(word).tolist()
        owned: dict[int, int] = {}
        for k in have:
            for i in self.postings[k]:
                owned[i] = owned.get(i, 0) + 1
        # A base phrase needs all its words, a notice most of its IDF.
        open_ = {i for i, n in owned.items() if n == self.distinct[i] or not self.templates[i].base and self._share(i, have) >= LEAST}
        left = {i: 1 if self.templates[i].base else ANCHORS for i in open_}
        starts: set[tuple[int, int]] = set()
        for k in have:
            wanted = [i for i in self.postings[k] if left.get(i, 0) > 0]
            if wanted:
                here = places[word == k].tolist()
                for i in wanted:
                    left[i] -= 1
                    starts.update((h - pos, i) for h in here for pos in (self.postings[k][i] if not self.templates[i].base else self.postings[k][i][:1]))
            if not any(left.values()):
                break
        for start, i in sorted(starts):
            m = self.templates[i]
            if m.base:
                if begin <= start and start + len(m.words) <= end and self._stands(w, start, self.phrases[i][0]):
                    base.append((start - begin, i))
            else:
                score = self._score(w, start, i, begin, end, places, word)
                if score >= LEAST:
                    labels[m.label] = max(score, labels.get(m.label, 0.0))
        return base, labels

    def _share(self, i: int, have: list[int]) -> float:
        """The share of a notice's IDF that words of a file could give."""
        own = self.idf[i]
        return sum(own[at] for k in have for at in self.postings[k].get(i, ())) / own.sum()

    def _stands(self, w: Words, start: int, phrase: list[bytes]) -> bool:
        return all(w.word(start + j).lower() == p for j, p in enumerate(phrase))

    def _score(self, w: Words, start: int, i: int, begin: int, end: int, places: np.ndarray, word: np.ndarray) -> float:
        """The share of a notice's IDF whose postings meet a place of their word within the slack, 0 unless each mandatory phrase stands there."""
        n, idf = len(self.templates[i].words), self.idf[i]
        slack = n // SLACK
        a, b = max(begin, start - slack), min(end, start + n + slack)
        low, high = np.searchsorted(places, [a, b])
        found = np.zeros(n, bool)
        for p, k in zip(places[low:high].tolist(), word[low:high].tolist(), strict=True):
            for pos in self.postings[k].get(i, ()):
                if abs(p - start - pos) <= slack:
                    found[pos] = True
        score = float(idf[found].sum() / idf.sum())
        if score < LEAST:
            return 0.0
        for phrase in self.phrases[i]:
            if not any(self._stands(w, p, phrase) for p in range(a, b - len(phrase) + 1)):
                return 0.0
        return min(1.0, score)


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """The number of rows, and of rows whose text has each word of a vocabulary of bounded size."""
    order = sorted(zip(_hashes(vocabulary).tolist(), vocabulary, strict=True))
    keys = np.array([h for h, _ in order], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, having = 0, np.zeros(len(keys), np.int64)
        for batch in batches:
            column = batch.column(0)
            total += len(column)
            for a, b in slices(column):
                w = words(column.slice(a, b - a), ALNUM)
                at = np.minimum(np.searchsorted(keys, w.hash), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == w.hash)
                pairs = np.unique((np.searchsorted(w.first, hit, "right") - 1) * len(keys) + at[hit])
                having += np.bincount(pairs % len(keys), minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(keys))], pa.int32()), pa.array([total, *having.tolist()], pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    got = {r["word"]: r["n"] for r in rows}
    return got.get(-1, 0), {w: got.get(i, 0) for i, (_, w) in enumerate(order)}


_MADE = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, found: list[Template] | None = None) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, its words, places of base phrases, the first and last of them,
    the base labels, all labels (sorted, comma-joined) and the best place's score (1 for a base phrase, 0 for none).

    A null text is empty; without places first and last are null and labels empty. Repeated rows and null ids each get
    their answer; other columns are ignored. Document frequencies are counted over all rows first.
    """
    found = templates() if found is None else found
    bounded_batches(docs.sparkSession)
    n_docs, having = document_frequencies(docs, sorted({w for t in found for w in t.words}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(found, n_docs, having)
        for batch in batches:
            rows: list[tuple] = []
            for a, b in slices(batch.column(1)):
                for n, base, labels in index.scan(words(batch.column(1).slice(a, b - a), ALNUM)):
                    own = {found[i].label for _, i in base}
                    starts = [s for s, _ in base]
                    rows.append((n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | set(labels))), 1.0 if base else max(labels.values(), default=0.0)))
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_MADE)], ["doc_id", *[n for n, _ in _MADE]])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}")
