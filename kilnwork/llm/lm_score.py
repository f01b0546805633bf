"""Masked pseudo-likelihood of documents by a bidirectional window network in numpy.

For each place the network sees the SIDE words on either side, not the word itself: their learnt codes, a hidden layer,
and a softmax at each of three levels of a tree of BRANCH children, whose leaves are ids. The EXACT commonest words of
the corpus have an id each, in order of their counts; the others share OTHER ids by their hashes. An id's probability is
shared among its words by their counts in the whole corpus, n of a word in the id's N words: n / (N + 1), and 1 / (N + 1)
for all words that the corpus doesn't have. The sum of the words' log-probabilities scores a document.

The counts are a table with a row for each distinct word. The commonest words' counts go to every task; the other
words' places are joined with the table. Words are told apart by 64-bit hashes that take A-Z as a-z.

Training goes through every document once, in ROUNDS rounds that each take the documents of one remainder of a hash. A
round's documents are dealt to shards by another hash, and ordered by it; each shard goes on from the same parameters,
and the shards' parameters are averaged, weighted by their words, in a tree of groups of FAN rows, so that no group
grows with the corpus. Shards depend on the rows alone, so scores don't hang on how files or tasks are cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.llm.shared import bounded_batches, drop_stored, stored
from kilnwork.llm.textops import SPACED, Words, slices, words

U = np.uint64
BRANCH, SIDE, CODE, HIDDEN = 16, 2, 16, 16
IDS = BRANCH**3
OTHER_BITS = 9
EXACT = IDS - (1 << OTHER_BITS)
#: Words in one training step, and the step's rate.
STEP, RATE = 8_192, 0.25
#: Rounds, and the words of a shard.
ROUNDS, SHARD = 4, 1_500_000
#: Floats in one row of parameters, and rows in one group of the averaging tree.
BLOCK, FAN = 16_384, 64
#: At most so many of the commonest words have their counts sent to every task, in a table of 2**SLOT_BITS slots.
HEAD, SLOT_BITS = 1 << 18, 20
#: Bytes of text whose words are counted together before they leave a task.
COUNTED = 16 << 20

#: Logarithms of counts are added up as whole numbers of this part, so that sums don't hang on the order of rows.
_UNIT = 1 << 32
_SHAPES = [
    ("codes", (IDS + 1, CODE)), ("inner", (2 * SIDE * CODE, HIDDEN)), ("inner_bias", (HIDDEN,)),
    *[(f"{n}{level}", (BRANCH**level, BRANCH, *((HIDDEN,) if n == "out" else ()))) for level in range(3) for n in ("out", "bias")],
]
SIZE = sum(int(np.prod(s)) for _, s in _SHAPES)


@dataclass
class Vocabulary:
    """Words of a corpus (hashes) and how often each is there.

    ``counts`` (word, n) has all that are there twice or more. The commonest are besides in a table of slots, by the
    highest bits of their hashes: ``key``, ``gain`` = ln n and ``id``, -1 for those without one of the ``exact`` first.
    ``total`` has the words of each id.
    """

    counts: DataFrame | None
    exact: int
    key: np.ndarray
    gain: np.ndarray
    id: np.ndarray
    total: np.ndarray

    @classmethod
    def of(cls, word: np.ndarray, n: np.ndarray, others: np.ndarray, counts: DataFrame | None = None, exact: int = EXACT) -> Vocabulary:
        """From the commonest words, and the words of each remainder of hashes, all words counted."""
        order = np.lexsort((word, -n))
        word, n = word[order], n[order]
        slot, first = np.unique((word >> U(64 - SLOT_BITS)).astype(np.int64), return_index=True)
        key, gain, own = np.zeros(1 << SLOT_BITS, U), np.zeros(1 << SLOT_BITS, np.float32), np.full(1 << SLOT_BITS, -1, np.int16)
        key[slot], gain[slot] = word[first], np.log(n[first])
        # The commonest of those that have a slot, in order.
        chosen = np.sort(first)[:exact]
        own[(word[chosen] >> U(64 - SLOT_BITS)).astype(np.int64)] = np.arange(len(chosen))
        total = np.zeros(IDS, np.int64)
        total[: len(chosen)] = n[chosen]
        total[exact : exact + len(others)] = others
        np.subtract.at(total, exact + (word[chosen] >> U(64 - OTHER_BITS)).astype(np.int64), n[chosen])
        return cls(counts, exact, key, gain, own, total)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's id, whether the table has it, and its gain."""
        slot = (hashes >> U(64 - SLOT_BITS)).astype(np.int64)
        known = self.key[slot] == hashes
        own = np.where(known, self.id[slot], np.int16(-1)).astype(np.int64)
        return np.where(own >= 0, own, self.exact + (hashes >> U(64 - OTHER_BITS)).astype(np.int64)), known, np.where(known, self.gain[slot], np.float32(0))

    def sent(self) -> Vocabulary:
        return Vocabulary(None, self.exact, self.key, self.gain, self.id, self.total)


@dataclass
class Network:
    codes: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    out0: np.ndarray
    bias0: np.ndarray
    out1: np.ndarray
    bias1: np.ndarray
    out2: np.ndarray
    bias2: np.ndarray

    @classmethod
    def start(cls, total: np.ndarray | None = None) -> Network:
        """Fixed small random codes; biases that give each id its share of ``total``, or all the same."""
        rng = np.random.default_rng(7)
        made = {n: np.zeros(s, np.float32) for n, s in _SHAPES}
        made["codes"] = (rng.normal(size=(IDS + 1, CODE)) * 0.3).astype(np.float32)
        made["codes"][IDS] = 0
        made["inner"] = (rng.normal(size=(2 * SIDE * CODE, HIDDEN)) / math.sqrt(2 * SIDE * CODE)).astype(np.float32)
        if total is not None:
            mass = (total + 0.5).reshape(BRANCH, BRANCH, BRANCH)
            for level, m in enumerate((mass.sum(axis=(1, 2))[None, :], mass.sum(axis=2), mass.reshape(-1, BRANCH))):
                made[f"bias{level}"] = np.log(m / m.sum(axis=1, keepdims=True)).astype(np.float32)
        return cls(**made)

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        made, at = {}, 0
        for n, s in _SHAPES:
            size = int(np.prod(s))
            made[n] = flat[at : at + size].reshape(s).astype(np.float32).copy()
            at += size
        return cls(**made)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).reshape(-1) for n, _ in _SHAPES])


def contexts(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The neighbours of each place, within its text: a row of 2 * SIDE ids, IDS beyond the text."""
    counts = np.diff(first)
    # All texts in one array with SIDE places between them.
    at = np.arange(len(ids)) + np.repeat(SIDE * np.arange(1, len(counts) + 1), counts)
    spread = np.full(len(ids) + SIDE * (len(counts) + 1), IDS, np.uint16)
    spread[at] = ids
    out = np.empty((len(ids), 2 * SIDE), np.uint16)
    for k, shift in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        out[:, k] = spread[at + shift]
    return out


def _exp(z: np.ndarray) -> np.ndarray:
    """exp(z) in place, up to a factor for each row where it could overflow."""
    if len(z) and z.max() > 60:
        z -= z.max(axis=1, keepdims=True)
    return np.exp(z, out=z)


_ONES = np.ones(BRANCH, np.float32)


class Pass:
    """One step's places in order of their ids, and what the network makes of them: codes, layer, and each level's numerators and sums."""

    def __init__(self, net: Network, context: np.ndarray, target: np.ndarray) -> None:
        self.order = np.argsort(target.astype(np.uint16), kind="stable")
        self.target = target[self.order]
        # Level k's softmax is the one of the id's first k digits.
        self.groups = [(0, 0, len(target))], *([(int(g), a, b) for g, a, b in self._runs(self.target >> shift)] for shift in (8, 4))
        self.digits = [(self.target >> shift) & (BRANCH - 1) for shift in (8, 4, 0)]
        self.context = context[self.order]
        self.x = np.take(net.codes, self.context.reshape(-1), axis=0).reshape(len(target), -1)
        z = self.x @ net.inner + net.inner_bias
        self.scale = 1 / (1 + np.abs(z))
        self.h = z * self.scale
        self.level, self.total = [], []
        for k, groups in enumerate(self.groups):
            out, bias = getattr(net, f"out{k}"), getattr(net, f"bias{k}")
            p = np.empty((len(target), BRANCH), np.float32)
            for g, a, b in groups:
                np.matmul(self.h[a:b], out[g].T, out=p[a:b])
            p += bias[0] if k == 0 else np.take(bias, self.target >> (12 - 4 * k), axis=0)
            self.level.append(_exp(p))
            self.total.append(p @ _ONES)

    @staticmethod
    def _runs(group: np.ndarray) -> Iterator[tuple[int, int, int]]:
        cuts = np.flatnonzero(np.diff(group)) + 1
        begin, end = np.concatenate([[0], cuts]), np.append(cuts, len(group))
        return zip(group[begin].tolist() if len(group) else [], begin.tolist(), end.tolist(), strict=False)

    def log_probabilities(self) -> np.ndarray:
        at, total = np.arange(len(self.target)), np.zeros(len(self.target))
        for p, s, d in zip(self.level, self.total, self.digits, strict=True):
            total += np.log(np.maximum(p[at, d] / s, np.float32(1e-12)))
        out = np.empty(len(at))
        out[self.order] = total
        return out


def log_probabilities(net: Network, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """ln P(id | neighbours) at each place."""
    return np.concatenate([Pass(net, context[a : a + STEP], target[a : a + STEP]).log_probabilities() for a in range(0, len(target), STEP)] or [np.zeros(0)])


class Trainer:
    """AdaGrad steps over a stream of words."""

    def __init__(self, net: Network, seen: Network | None = None, step: int = STEP) -> None:
        self.net = net
        self.words = step
        self.seen = seen or Network(**{n: np.full(s, 1e-3, np.float32) for n, s in _SHAPES})
        self.n = 0

    def _move(self, name: str, g: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        seen = getattr(self.seen, name)
        now = seen[rows] + g * g
        seen[rows] = now
        getattr(self.net, name)[rows] -= RATE * g / np.sqrt(now)

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        net, s = self.net, Pass(self.net, context, target)
        n = len(target)
        # Sums over the step, scaled as if it had few words: AdaGrad takes the rest.
        scale = np.float32(1 / math.sqrt(n))
        back, more, at, ones = np.zeros((n, HIDDEN), np.float32), np.empty((n, HIDDEN), np.float32), np.arange(n), np.ones(n, np.float32)
        for k, groups in enumerate(s.groups):
            p, out = s.level[k], getattr(net, f"out{k}")
            p /= s.total[k][:, None]
            p[at, s.digits[k]] -= 1
            g_out, g_bias = np.zeros_like(out), np.zeros((len(out), BRANCH), np.float32)
            for g, a, b in groups:
                part = p[a:b]
                np.matmul(part.T, s.h[a:b], out=g_out[g])
                np.matmul(ones[: b - a], part, out=g_bias[g])
                np.matmul(part, out[g], out=more[a:b])
            back += more
            self._move(f"out{k}", g_out * scale)
            self._move(f"bias{k}", g_bias * scale)
        back *= s.scale * s.scale
        sent = (back @ net.inner.T).reshape(-1, CODE)
        self._move("inner", s.x.T @ back * scale)
        self._move("inner_bias", back.sum(axis=0) * scale)
        near = s.context.reshape(-1)
        order = np.argsort(near, kind="stable")
        near = near[order]
        begin = np.concatenate([[0], np.flatnonzero(np.diff(near)) + 1])
        g_codes, rows = np.add.reduceat(np.take(sent, order, axis=0), begin, axis=0), near[begin]
        inside = rows < IDS
        self._move("codes", g_codes[inside] * scale, rows[inside])
        self.n += n

    def learn(self, ids: np.ndarray, first: np.ndarray) -> None:
        around = contexts(ids, first)
        # A fixed mixed order within the chunk, so that a step doesn't hang on one text.
        mixed = np.random.default_rng(len(ids)).permutation(len(ids))
        for a in range(0, len(ids), self.words):
            self.step(around[mixed[a : a + self.words]], ids[mixed[a : a + self.words]])


def count_words(docs: DataFrame, exact: int = EXACT) -> Vocabulary:
    """The vocabulary of all rows of ``docs`` (text)."""
    bounded_batches(docs.sparkSession)

    def counted(hashes: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(hashes), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for a, b in slices(batch.column(0)):
                w = words(batch.column(0).slice(a, b - a), SPACED)
                held.append(w.hash)
                size += len(w.data)
                if size >= COUNTED:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    each = stored(docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    others = np.zeros(1 << OTHER_BITS, np.int64)
    for r in each.groupBy(F.shiftrightunsigned("word", 64 - OTHER_BITS).alias("id")).agg(F.sum("n").alias("n")).collect():
        others[r["id"]] = r["n"]
    # Words by eighths of powers of two of their counts: the highest steps that have HEAD words together.
    step = F.floor(8 * F.log2("n"))
    some, least = 0, None
    for r in each.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        some += r["count"]
        if some > HEAD:
            break
        least = r["step"]
    head = each.where(step >= least).toArrow() if least is not None else None
    word, n = (head[c].to_numpy() for c in ("word", "n")) if head else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return Vocabulary.of(word.view(U), n, others, each.where("n > 1"), exact)


@dataclass
class Model:
    net: Network
    vocabulary: Vocabulary


def train(docs: DataFrame, rounds: int = ROUNDS, shard: int = SHARD, step: int = STEP, exact: int = EXACT) -> Model:
    """The network after one way through all rows of ``docs`` (doc_id, text) in ``rounds`` rounds, with their vocabulary.
    ``shard`` is the words of a shard, ``step`` those of a training step, ``exact`` the words with their own ids. Without words it stays at its start: every id equally likely."""
    spark = docs.sparkSession
    bounded_batches(spark)
    v = count_words(docs, exact)
    n_words = int(v.total.sum())
    if not n_words:
        return Model(Network.start(), v)
    flat = np.concatenate([Network.start(v.total).flat(), np.full(SIZE, 1e-3, np.float32)])
    shards = max(1, math.ceil(n_words / rounds / shard))
    dealt = docs.where("text is not null").select("text", F.xxhash64(F.lit(5), "doc_id", "text").alias("at"))
    for r in range(rounds):
        sent = spark.sparkContext.broadcast((flat, v.sent()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            both, vocabulary = sent.value
            t, at = None, 0
            for batch in batches:
                for a, b in slices(batch.column(0)):
                    w = words(batch.column(0).slice(a, b - a), SPACED)
                    if len(w.hash):
                        t = t or Trainer(Network.of(both[:SIZE]), Network.of(both[SIZE:]), step)
                        t.learn(vocabulary.look_up(w.hash)[0], w.first)
                at = batch.column(1)[0].as_py() if len(batch) else at
            if t:
                after = np.concatenate([t.net.flat(), t.seen.flat()])
                parts = [after[a : a + BLOCK].tobytes() for a in range(0, len(after), BLOCK)]
                m = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([at] * m, pa.int64()), pa.array(range(m), pa.int32()), pa.array([t.n] * m, pa.int64()), pa.array(parts, pa.binary())], ["shard", "block", "n", "part"])

        here = dealt.where(F.pmod("at", F.lit(rounds)) == r).withColumn("shard", F.pmod(F.shiftrightunsigned("at", 20), F.lit(shards)))
        here = here.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("at", "text").select("text", "shard")
        flat = _average(here.mapInArrow(run, "shard long, block int, n long, part binary"), flat)
    return Model(Network.of(flat[:SIZE]), v)


def _mean(fan: int):
    """The mean of one group's rows, weighted by their words, in order of their shards."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["shard"].to_numpy(), kind="stable")
        n = table["n"].to_numpy().astype(float)
        parts = table["part"].to_pylist()
        total = sum(n[i] * np.frombuffer(parts[i], np.float32) for i in order) / n.sum()
        shard, block = (table[c][0].as_py() for c in ("shard", "block"))
        return pa.table({"shard": pa.array([shard // fan], pa.int64()), "block": pa.array([block], pa.int32()), "n": pa.array([int(n.sum())], pa.int64()), "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    return run


def _average(parts: DataFrame, before: np.ndarray) -> np.ndarray:
    """Shards' parameters averaged level by level until each block has one row; those, of bounded size, come to the driver."""
    level = stored(parts, "parameters")
    while True:
        last = level.agg(F.max("shard")).first()[0]
        if last is None:
            drop_stored(level)
            return before
        if last == 0:
            rows = level.orderBy("block").collect()
            drop_stored(level)
            return np.concatenate([np.frombuffer(r["part"], np.float32) for r in rows])
        up = stored(level.groupBy("block", F.floor(F.col("shard") / FAN).alias("group")).applyInArrow(_mean(FAN), "shard long, block int, n long, part binary"), "parameters")
        drop_stored(level)
        level = up


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (the sum over words of ln P(word | neighbours)), mean_log_likelihood and n_once
    (words that the corpus has only there, or not at all) for each row.

    Null, empty and white texts have no words, a sum of 0 and a null mean. Repeated rows and null ids each get their
    answer; other columns are ignored.
    """
    spark, v = docs.sparkSession, model.vocabulary
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast((model.net.flat(), v.sent()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, vocabulary = sent.value
        net, loss = Network.of(flat), np.log1p(vocabulary.total)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                w = words(batch.column(1).slice(a, b - a), SPACED)
                ids, known, gain = vocabulary.look_up(w.hash)
                each = log_probabilities(net, contexts(ids, w.first), ids) - loss[ids] + gain
                total = np.concatenate([[0.0], np.cumsum(each)])
                s = total[w.first[1:]] - total[w.first[:-1]]
                n = w.counts
                s[n == 0] = 0
                # Words of the table that the corpus has once; the others are joined with the counts.
                once = np.concatenate([[0], np.cumsum(known & (gain == 0))])
                before = np.concatenate([[0], np.cumsum(~known)])[w.first]
                rare = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(w.hash.view(np.int64)[~known]))
                columns = [batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(s), pa.array((once[w.first[1:]] - once[w.first[:-1]]).astype(np.int64)), rare]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "s", "once", "rare"])

    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, s double, once long, rare array<long>")
    if v.counts is None:
        return _answers(rows, F.col("s"), F.col("once") + F.size("rare"))
    rows = stored(rows.withColumn("key", F.monotonically_increasing_id()), "scores")
    # A word met once adds ln 1, one not met nothing: both are left out of the join.
    gains = rows.select("key", F.explode("rare").alias("word")).join(v.counts, "word").groupBy("key").agg(F.sum(F.round(F.ln("n") * _UNIT).cast("long")).alias("more"), F.count(F.lit(1)).alias("again"))
    met = rows.withColumn("alone", F.col("once") + F.size("rare")).drop("rare").join(gains, "key", "left")
    return _answers(met, F.col("s") + F.coalesce("more", F.lit(0)) / _UNIT, F.col("alone") - F.coalesce("again", F.lit(0)))


def _answers(rows: DataFrame, total: Column, once: Column) -> DataFrame:
    return rows.select("doc_id", "n_tokens", total.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_likelihood"), once.alias("n_once"))
