"""Quality by ordinal cumulative-link regression on hashed text.

P(grade <= k) is the logistic of threshold k less w.x: all grades share the weights w, thresholds are ordered. Features
are hashed: the share of each word, of each word's shape (character classes, runs collapsed) and of a few traits of the
whole text, such as the shares of repeated lines and of words that repeat the one before, in steps. The expected grade and the probability of a grade or better
serve selection.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.llm.shared import bounded_batches, sample_texts
from kilnwork.llm.textops import SPACED, class_table, mix, powers, slices, words

U = np.uint64
BITS = 15
#: Labelled rows that the fit takes at most: those with the smallest hashes of their ids.
MOST_LABELLED = 6000
LINES = class_table("\n")


def _classes() -> np.ndarray:
    """Upper case, lower case and other letters, digits; every other character stands for itself."""
    t = np.arange(256, dtype=np.uint8)
    t[48:58] = ord("0")
    t[65:91] = ord("B")
    t[97:123] = ord("b")
    t[128:] = ord("b")
    return t


CLASSES = _classes()
# Not VALUES: there both cases are one.
SHAPE_VALUES = mix(np.arange(300, 556, dtype=U))


def _shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word's character classes with runs collapsed."""
    c = CLASSES[data]
    new = np.ones(len(c), bool)
    new[1:] = c[1:] != c[:-1]
    new[start] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    a, b = kept[start], kept[end]
    up, down = powers(int(kept[-1]) + 1)
    total = np.zeros(int(kept[-1]) + 1, U)
    np.cumsum(SHAPE_VALUES[c[new]] * up[: int(kept[-1])], out=total[1:])
    return mix((total[b] - total[a]) * down[a] + (b - a).astype(U))


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix(h + U(salt)) >> U(64 - BITS)).astype(np.int64)


@dataclass
class Features:
    """Sparse rows: text t has index[first[t]:first[t + 1]], each entry with a value."""

    index: np.ndarray
    value: np.ndarray
    first: np.ndarray

    def dot(self, weights: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(weights[self.index] * self.value)])
        return total[self.first[1:]] - total[self.first[:-1]]


def features(column: pa.Array) -> Features:
    w = words(column, SPACED)
    n = w.counts
    lines = words(column, LINES)
    m = lines.counts
    share = 1.0 / np.maximum(n, 1)
    of = w.text_of_word()
    index = [_bucket(w.hash, 1), _bucket(_shapes(w.data, w.start, w.end), 2)]
    value = [share[of], share[of]]
    # Traits of the whole text, each as one hashed step.
    repeated = np.array([1 - len(np.unique(lines.hash[a:b])) / max(1, b - a) for a, b in zip(lines.first[:-1].tolist(), lines.first[1:].tolist(), strict=True)])
    bytes_ = np.diff(w.offsets)
    letters = np.concatenate([[0], np.cumsum((CLASSES[w.data] == ord("b")) | (CLASSES[w.data] == ord("B")))])
    capitals = np.concatenate([[0], np.cumsum(CLASSES[w.data] == ord("B"))])
    inside = np.concatenate([[0], np.cumsum(SPACED[w.data])])
    twice = np.zeros(len(w.hash) + 1)
    twice[2:] = np.cumsum((w.hash[1:] == w.hash[:-1]) & (of[1:] == of[:-1]))
    again = (twice[w.first[1:]] - twice[w.first[:-1]]) / np.maximum(1, n - 1)
    a, b = w.offsets[:-1], w.offsets[1:]
    part = lambda total, other: (total[b] - total[a]) / np.maximum(1, other[b] - other[a])
    traits = [
        np.minimum(np.log2(n + 1).astype(int), 20), (repeated * 10).astype(int), (part(letters, inside) * 20).astype(int), (part(capitals, letters) * 10).astype(int),
        np.minimum(bytes_ / np.maximum(n, 1), 30).astype(int), np.minimum(np.log2(np.maximum(1, n / np.maximum(1, m))).astype(int), 20), np.ceil(again * 20).astype(int),
    ]
    texts = np.arange(len(n))
    for k, t in enumerate(traits):
        index.append(_bucket(t.astype(U) + U(1000 * k), 3))
        value.append(np.full(len(n), 0.25))
    row = np.concatenate([of, of] + [texts] * len(traits))
    order = np.argsort(row, kind="stable")
    sizes = np.bincount(row, minlength=len(n))
    return Features(np.concatenate(index)[order], np.concatenate(value)[order], np.concatenate([[0], np.cumsum(sizes)]))


def compact(column: pa.Array | pa.ChunkedArray) -> Features:
    """The features of many texts, a chunk at a time, with one entry for each text and feature."""
    index, value, sizes = [], [], []
    for a, b in slices(column):
        x = features(column.slice(a, b - a))
        row = np.repeat(np.arange(b - a), np.diff(x.first))
        keys, where = np.unique(row << BITS | x.index, return_inverse=True)
        index.append((keys & ((1 << BITS) - 1)).astype(np.int32))
        value.append(np.bincount(where, weights=x.value).astype(np.float32))
        sizes.append(np.bincount(keys >> BITS, minlength=b - a))
    return Features(np.concatenate(index), np.concatenate(value), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    grades: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, x: Features) -> np.ndarray:
        """P(grade > k-th grade) for each text and each threshold."""
        return _logistic(x.dot(self.weights)[:, None] - self.thresholds[None, :])

    def expected(self, above: np.ndarray) -> np.ndarray:
        return self.grades[0] + above @ np.diff(self.grades) if len(self.grades) > 1 else np.full(len(above), float(self.grades[0]))

    def tail(self, above: np.ndarray, grade: float) -> np.ndarray:
        """P(grade or better)."""
        k = int(np.searchsorted(self.grades, grade))
        return np.ones(len(above)) if k == 0 else np.zeros(len(above)) if k == len(self.grades) else above[:, k - 1]


def fit(texts: list[str | None] | pa.ChunkedArray, grades: list[float], epochs: int = 120, rate: float = 0.5, decay: float = 1e-6) -> Model:
    """By AdaGrad on the whole sample in each step. Without examples of two grades the model is constant."""
    levels = np.unique(np.array(grades, float)) if grades else np.zeros(1)
    weights = np.zeros(1 << BITS)
    if len(levels) < 2:
        return Model(levels, weights, np.zeros(0))
    x = compact(texts if isinstance(texts, pa.ChunkedArray) else pa.array(texts, pa.string()))
    y = np.searchsorted(levels, np.array(grades, float))
    row = np.repeat(np.arange(len(y)), np.diff(x.first))
    share = np.array([(y > k).mean() for k in range(len(levels) - 1)])
    thresholds = np.log((1 - share) / share)
    seen, seen_t = np.full(len(weights), 1e-8), np.full(len(thresholds), 1e-8)
    # The likelihood of a grade between two thresholds: its derivative in each threshold's argument.
    for _ in range(epochs):
        p = np.concatenate([np.ones((len(y), 1)), _logistic(x.dot(weights)[:, None] - thresholds[None, :]), np.zeros((len(y), 1))], axis=1)
        slope = p * (1 - p)
        here = np.maximum(p[np.arange(len(y)), y] - p[np.arange(len(y)), y + 1], 1e-9)
        pull = (slope[np.arange(len(y)), y] - slope[np.arange(len(y)), y + 1]) / here
        g = -np.bincount(x.index, weights=pull[row] * x.value, minlength=len(weights)) / len(y) + decay * weights
        g_t = np.array([(((y > k) & (y == k + 1)) * slope[:, k + 1] - (y == k) * slope[:, k + 1]) @ (1 / here) for k in range(len(thresholds))]) / len(y)
        seen += g * g
        seen_t += g_t * g_t
        weights -= rate * g / np.sqrt(seen)
        thresholds = np.maximum.accumulate(thresholds - 0.1 * g_t / np.sqrt(seen_t))
    return Model(levels, weights, thresholds)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Fit on at most ``most`` rows of ``labels`` (doc_id, quality) that have a grade and a document, and at most SAMPLE_BYTES of text."""
    bounded_batches(docs.sparkSession)
    some = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    found = sample_texts(docs, some, "quality").limit(2 * most).toArrow()
    return fit(found["text"], [float(g) for g in found["quality"].to_pylist()])


def score(docs: DataFrame, model: Model, grade: float, least: float) -> DataFrame:
    """doc_id, expected_grade, p_grade (of ``grade`` or better) and keep (p_grade at least ``least``) for each row of
    ``docs``. Texts that are null, empty or white space get what the traits of an empty text give. Repeated rows and
    null ids each get their answer; other columns are ignored."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for a, b in slices(batch.column(1)):
                above = m.above(features(batch.column(1).slice(a, b - a)))
                p = m.tail(above, grade)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(m.expected(above)), pa.array(p), pa.array(p >= least)], ["doc_id", "expected_grade", "p_grade", "keep"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, expected_grade double, p_grade double, keep boolean")


def selected(docs: DataFrame, model: Model, grade: float, least: float) -> DataFrame:
    """The rows of ``docs`` with a probability of ``grade`` or better of at least ``least``, unchanged."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            keep = [m.tail(m.above(features(column.slice(a, b - a))), grade) >= least for a, b in slices(column)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
