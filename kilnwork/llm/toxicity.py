"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

A sentence is compared with landmarks, strings that toxic documents of the training rows have and others don't. Its
kernel value with a landmark is the best of its words' windows by the gap-weighted subsequence kernel: common
subsequences of ORDER characters count less the more they are spread. Values are divided by the norms of the landmark
and of the window's letters that the landmark has, moved together: characters that were put in lower a value by their
gaps alone, missing and changed ones by the subsequences that they take away. Windows are from one character less than
the landmark to WIDER more; words of fewer than ORDER letters and values below LEAST count as 0. The Nyström map turns kernel values with the landmarks into features; a linear support vector machine is
trained on sentences, and a document's decision is its highest sentence's, turned into a probability by a curve through
decisions of machines that didn't see the document.

By the inequality of Cauchy and Schwarz, and because gaps only lower weights, a word's value with a landmark is at most the root of the share of the
landmark's squared norm that lies on subsequences that the word has. Words for which that is below LEAST are left out
before any window is compared; no value that counts is lost.
"""

from __future__ import annotations

import functools
import itertools
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.llm.shared import bounded_batches, sample_texts

#: Length of subsequences, and the weight of each character that they span.
ORDER, DECAY = 3, 0.9
#: Landmarks, and training rows of each kind: those with the smallest hashes of their ids.
MOST_LANDMARKS, MOST_TOXIC, MOST_CLEAN = 96, 1500, 3000
#: Letters of a landmark, and characters that a window may have beyond them.
SHORTEST_MARK, LONGEST_MARK, WIDER = 4, 10, 4
#: Longest word whose windows are compared; longer ones are cut into parts that overlap by the widest window.
LONGEST = 24
#: Smaller kernel values count as 0. Four characters put into five leave .74 on average, one of five missing .57 to .73.
LEAST = 0.7
_SPELT = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
#: Weight of altered landmarks beside the toxic sentences.
ALTERED = 0.05
_ENDS = re.compile(r"(?<=[.!?;])\s+|\n+")
_SPELLED = str.maketrans("01345789", "oieastbg")
_KNOWN = 250_000
#: Characters are told apart by so many classes before windows are compared.
_CLASSES = 61
#: Times that the toxic documents' sentences are chosen anew.
ROUNDS = 3
#: Parts of the training documents that are scored by machines fitted on the others.
FOLDS = 3


def plain_words(sentence: str) -> list[str]:
    """Lower-cased words with letters alone (digits within words as the letters they stand for); single letters in a row are one more word."""
    out, row = [], []
    for t in sentence.lower().split():
        w = t if t.isalpha() else bare(t)
        if len(w) == 1:
            row.append(w)
            continue
        if len(row) > 2:
            out.append("".join(row))
        row = []
        if w:
            out.append(w)
    if len(row) > 2:
        out.append("".join(row))
    return out


def bare(token: str) -> str:
    """A token's letters; digits count as the letters they resemble in short tokens that have more letters than digits."""
    letters, digits = sum(map(str.isalpha, token)), sum(map(str.isdigit, token))
    return "".join(filter(str.isalpha, token.translate(_SPELLED) if letters > digits and len(token) <= LONGEST else token))


def sentences(text: str) -> list[str]:
    return [s for s in _ENDS.split(text) if s.strip()]


def _classes(c: np.ndarray) -> np.ndarray:
    return (c * 7) % _CLASSES


def codes(strings: list[str], width: int) -> np.ndarray:
    """Code points in rows of ``width``, 0 beyond a string's end."""
    return np.frombuffer("".join(s[:width].ljust(width, "\0") for s in strings).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(strings), width).astype(np.int64)


def kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The gap-weighted subsequence kernel of each row pair of two code arrays, not normalised."""
    n, ls, lt = len(s), s.shape[1], t.shape[1]
    # inner[j]: weighted subsequences of the length so far that end at or before t's place j, each carried on to the ends.
    inner = np.ones((ls + 1, n, lt + 1))
    total = np.zeros(n)
    for length in range(1, order + 1):
        after = np.zeros((ls + 1, n, lt + 1))
        total[:] = 0
        for i in range(1, ls + 1):
            run = np.zeros(n)
            same = (s[:, i - 1, None] == t) & (t != 0)
            for j in range(1, lt + 1):
                hit = same[:, j - 1] * inner[i - 1, :, j - 1]
                total += decay * decay * hit
                run = decay * run + decay * decay * hit
                after[i, :, j] = decay * after[i - 1, :, j] + run
        inner = after
    return total


def cosine(s: list[str], t: list[str]) -> np.ndarray:
    """The normalised kernel of string pairs; subsequences of ORDER characters, of fewer for shorter strings."""
    out = np.zeros(len(s))
    orders = np.array([min(ORDER, len(a), len(b)) for a, b in zip(s, t, strict=True)], int)
    for order in np.unique(orders[orders > 0]):
        at = np.flatnonzero(orders == order)
        a, b = [s[i] for i in at], [t[i] for i in at]
        x, y = codes(a, max(map(len, a))), codes(b, max(map(len, b)))
        out[at] = kernel(x, y, order) / np.sqrt(kernel(x, x, order) * kernel(y, y, order))
    return out


def matched(s: list[str], t: list[str]) -> np.ndarray:
    """The values of windows with landmarks of at least ORDER characters."""
    if not s:
        return np.zeros(0)
    # The landmark's letters of a window, moved together.
    own = ["".join([c for c in a if c in b]) for a, b in zip(s, t, strict=True)]
    names = sorted({*own, *t})
    x = codes(names, max(map(len, names)))
    norm = dict(zip(names, np.sqrt(kernel(x, x)).tolist(), strict=True))
    value = kernel(codes(s, max(map(len, s))), codes(t, max(map(len, t))))
    return value / np.maximum(np.array([norm[a] * norm[b] for a, b in zip(own, t, strict=True)]), 1e-12)


@dataclass
class Matcher:
    """Kernel values of words with landmarks."""

    landmarks: list[str]
    known: dict[str, tuple[np.ndarray, np.ndarray] | None] = field(default_factory=dict)
    #: Tokens met, and those of them whose words have a value, or are single letters.
    met: set[str] = field(default_factory=set)
    active: set[str] = field(default_factory=set)
    single: set[str] = field(default_factory=set)

    def __getstate__(self):
        return {"landmarks": self.landmarks, "known": {}, "met": set(), "active": set(), "single": set()}

    def forget(self) -> None:
        for held in (self.known, self.met, self.active, self.single):
            held.clear()

    def meet(self, tokens: set[str]) -> None:
        """Sort tokens not met before into those whose words come near a landmark and others."""
        if len(self.met) > _KNOWN:
            self.forget()
        new = tokens - self.met
        word = {t: t if t.isalpha() else bare(t) for t in new}
        self.learn(set(word.values()) - {""})
        for t, w in word.items():
            if len(w) == 1:
                self.single.add(t)
            elif w and self.known[w] is not None:
                self.active.add(t)
        self.met |= new

    @functools.cached_property
    def _triples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For codes of three characters' classes: whether a landmark has it, and by code the landmarks with the share of their squared norm."""
        code, mark, share = [], [], []
        for k, m in enumerate(self.landmarks):
            weights: dict[str, float] = {}
            for at in itertools.combinations(range(len(m)), ORDER):
                u = "".join(m[i] for i in at)
                weights[u] = weights.get(u, 0.0) + DECAY ** (at[-1] - at[0] + 1)
            total = sum(w * w for w in weights.values())
            for u, w in weights.items():
                c = _classes(np.array([ord(x) for x in u], np.int64))
                code.append(int(c[0] * _CLASSES * _CLASSES + c[1] * _CLASSES + c[2]))
                mark.append(k)
                share.append(w * w / total)
        order = np.argsort(code, kind="stable")
        code, mark, share = np.array(code, np.int64)[order], np.array(mark, np.int64)[order], np.array(share)[order]
        first = np.searchsorted(code, np.arange(_CLASSES**ORDER + 1))
        return np.diff(first) > 0, first, mark, share

    def _candidates(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word, landmark) pairs whose value may reach LEAST."""
        some, first, mark, share = self._triples
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        sizes = np.array([len(w) for w in words])
        for size in np.unique(sizes[sizes >= ORDER]).tolist():
            rows = np.flatnonzero(sizes == size)
            i, j, k = np.array(list(itertools.combinations(range(size), ORDER))).T
            for a in range(0, len(rows), 1 + 2_000_000 // len(i)):
                part = rows[a : a + 1 + 2_000_000 // len(i)]
                c = _classes(codes([words[r] for r in part], size))
                code = (c[:, i] * _CLASSES + c[:, j]) * _CLASSES + c[:, k]
                at, which = np.nonzero(some[code])
                # Each of a word's subsequences once, and then once for each landmark that has it.
                pairs = np.unique(at * _CLASSES**ORDER + code[at, which])
                at, code = np.divmod(pairs, _CLASSES**ORDER)
                n = first[code + 1] - first[code]
                entry = np.repeat(first[code] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                key, where = np.unique(np.repeat(at, n) * len(self.landmarks) + mark[entry], return_inverse=True)
                total = np.bincount(where, weights=share[entry], minlength=len(key))
                key = key[total >= LEAST * LEAST - 1e-9]
                found.append((part[key // max(1, len(self.landmarks))], key % max(1, len(self.landmarks))))
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])

    def learn(self, words: set[str]) -> None:
        """Find the values of words not met before."""
        new = [w for w in words if w not in self.known]
        if not new:
            return
        step = LONGEST - LONGEST_MARK - WIDER
        parts, owner = [], []
        for i, w in enumerate(new):
            for a in range(0, max(1, len(w) - LONGEST + step), step) if len(w) > LONGEST else (0,):
                parts.append(w[a : a + LONGEST])
                owner.append(i)
        best: dict[tuple[int, int], float] = {}
        x, k = self._candidates(parts)
        pairs: dict[tuple[str, int], list[int]] = {}
        for p, m in zip(x.tolist(), k.tolist(), strict=True):
            w, mark = parts[p], self.landmarks[m]
            for size in range(len(mark) - 1, len(mark) + WIDER + 1):
                for a in range(max(1, len(w) - size + 1)):
                    pairs.setdefault((w[a : a + size], m), []).append(owner[p])
                if size >= len(w):
                    break
        keys = list(pairs)
        for a in range(0, len(keys), 20_000):
            some = keys[a : a + 20_000]
            values = matched([s for s, _ in some], [self.landmarks[m] for _, m in some])
            for (s, m), value in zip(some, values.tolist(), strict=True):
                if value >= LEAST:
                    for o in pairs[s, m]:
                        best[o, m] = max(value, best.get((o, m), 0.0))
        rows: dict[int, list[tuple[int, float]]] = {}
        for (o, m), value in best.items():
            rows.setdefault(o, []).append((m, value))
        for i, w in enumerate(new):
            self.known[w] = (np.array([m for m, _ in rows[i]]), np.array([v for _, v in rows[i]])) if i in rows else None

    def values(self, words: list[str]) -> np.ndarray | None:
        """The best value of the words with each landmark; None if all are 0. The words must have been learnt."""
        out = None
        for w in words:
            found = self.known[w]
            if found is not None:
                out = np.zeros(len(self.landmarks)) if out is None else out
                out[found[0]] = np.maximum(out[found[0]], found[1])
        return out


@dataclass
class Model:
    matcher: Matcher
    weights: np.ndarray  # on kernel values: the Nyström map and the machine in one
    bias: float
    slope: float
    shift: float

    def decisions(self, texts: list[str]) -> np.ndarray:
        """Each text's highest sentence."""
        m = self.matcher
        lowered = [t.lower() for t in texts]
        tokens = [set(t.split()) for t in lowered]
        m.meet(set().union(*tokens))
        out = np.full(len(texts), self.bias)
        for i, ts in enumerate(tokens):
            near = not ts.isdisjoint(m.active)
            if not near and len(ts & m.single) > 2:
                # Only spelled words could come near a landmark.
                spelled = {w for run in _SPELT.findall(lowered[i]) if len(w := "".join(filter(str.isalpha, run))) > 2}
                m.learn(spelled)
                near = any(m.known[w] is not None for w in spelled)
            if near:
                split = [plain_words(s) for s in sentences(texts[i])]
                m.learn({w for ws in split for w in ws})
                for ws in split:
                    k = m.values(ws)
                    if k is not None:
                        out[i] = max(out[i], float(k @ self.weights) + self.bias)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.decisions(texts) + self.shift, -40, 40)))


def pick_landmarks(toxic: list[set[str]], clean: list[set[str]], most: int = MOST_LANDMARKS) -> list[str]:
    """Words and word beginnings that together are in most toxic texts (each the set of its words), each again and again, and in nearly no clean one."""

    def strings(words: set[str]) -> set[str]:
        return {w[:n] for w in words for n in range(SHORTEST_MARK, min(len(w), LONGEST_MARK) + 1)}

    inside = [strings(t) for t in toxic]
    known = set().union(*inside)
    outside = Counter(x for t in clean for x in strings(t) & known)
    df = Counter(x for s in inside for x in s)
    least = max(2, len(toxic) // 200)
    allowed = lambda n: n / max(1, len(toxic)) * max(1, len(clean)) * 0.03
    # In order of length and letters: of equal gains the longest goes first, it is the least likely to be part of something else.
    names = sorted((x for x, n in df.items() if n >= least and outside[x] <= allowed(n)), key=lambda x: (len(x), x))
    number = {x: i for i, x in enumerate(names)}
    owned = [np.array(sorted(number[x] for x in s if x in number), np.int64) for s in inside]
    holders: list[list[int]] = [[] for _ in names]
    for row, own in enumerate(owned):
        for i in own.tolist():
            holders[i].append(row)
    gain = np.array([df[x] - len(toxic) / max(1, len(clean)) * outside[x] for x in names])
    alphabetic = sorted(names)
    left = np.full(len(toxic), 3)
    out: list[str] = []

    def beginning(x: str) -> list[str]:
        a = bisect_left(alphabetic, x)
        return alphabetic[a : bisect_left(alphabetic, x + "\U0010ffff")]

    while len(out) < most and len(names):
        best = len(gain) - 1 - int(np.argmax(gain[::-1]))
        if not gain[best] >= least:
            break
        # A longer string that is nearly as common says more.
        x = max((s for s in beginning(names[best]) if gain[number[s]] >= 0.85 * gain[best]), key=lambda s: (len(s), gain[number[s]], s))
        out.append(x)
        for row in holders[number[x]]:
            left[row] -= 1
            if left[row] == 0:
                gain[owned[row]] -= 1
        for y in beginning(x) + [x[:n] for n in range(SHORTEST_MARK, len(x) + 1) if x[:n] in number]:
            gain[number[y]] = -np.inf
    return out


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge) by Newton steps on its support vectors; y is 1 or -1."""
    a = np.hstack([x, np.ones((len(x), 1))])
    weight = weight / weight.sum()
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-9

    def cost(w: np.ndarray) -> float:
        return float(weight @ np.maximum(0, 1 - y * (a @ w)) ** 2 + penalty @ (w * w))

    w = np.zeros(a.shape[1])
    for _ in range(60):
        held = 1 - y * (a @ w) > 0
        b, u = a[held], weight[held]
        goal = np.linalg.solve(b.T @ (u[:, None] * b) + np.diag(penalty), b.T @ (u * y[held]))
        rate = 1.0
        while rate > 1e-6 and cost(w + rate * (goal - w)) > cost(w):
            rate /= 2
        if rate <= 1e-6 or np.abs(goal - w).max() < 1e-10:
            break
        w = w + rate * (goal - w)
    return w[:-1], float(w[-1])


def _altered(mark: str) -> list[tuple[str, float]]:
    """A landmark with one character put in at each place, and with two, and weights that add up to 1."""
    one = [mark[:i] + "\x7f" + mark[i:] for i in range(1, len(mark))]
    two = [mark[:i] + "\x7f" + mark[i:j] + "\x7f" + mark[j:] for i, j in itertools.combinations(range(1, len(mark)), 2)]
    return [(w, 0.5 / len(some)) for some in (one, two) for w in some]


def _curve(d: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through decisions, kept from certainty by a small prior."""
    n_toxic, n_clean = (target > 0).sum(), (target == 0).sum()
    slope, shift = 1.0, 0.0
    goal = np.where(target > 0, (n_toxic + 1) / (n_toxic + 2), 1 / (n_clean + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * d + shift, -40, 40)))
        r, h = p - goal, p * (1 - p) + 1e-6
        step = np.linalg.solve(np.array([[h @ (d * d) + 1e-3, h @ d], [h @ d, h.sum() + 1e-3]]), np.array([r @ d + 1e-3 * slope, r.sum()]))
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(slope), float(shift)


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """Without texts of both kinds, or without landmarks, the model gives every text the share of toxic rows."""
    y = np.array([1 if label else -1 for label in labels])
    split = [[plain_words(s) for s in sentences(t or "")] for t in texts]
    toxic, clean = ([{w for ws in split[i] for w in ws} for i in np.flatnonzero(y == k)] for k in (1, -1))
    share = min(max(len(toxic) / max(1, len(texts)), 1e-3), 1 - 1e-3)
    marks = pick_landmarks(toxic, clean) if toxic and clean else []
    matcher = Matcher(marks)
    if not marks:
        return Model(matcher, np.zeros(0), 0.0, 0.0, float(np.log(share / (1 - share))))
    gram = cosine([a for a in marks for _ in marks], [b for _ in marks for b in marks]).reshape(len(marks), -1)
    value, vector = np.linalg.eigh(gram)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    # Each sentence that comes near a landmark, its document, and how many others each document has.
    rows, owner, others = [], [], np.zeros(len(texts))
    altered = [w for m in marks for w in _altered(m)]
    matcher.learn({w for t in split for ws in t for w in ws} | {w for w, _ in altered})
    for i, t in enumerate(split):
        for ws in t:
            k = matcher.values(ws)
            if k is None:
                others[i] += 1
            else:
                rows.append(k)
                owner.append(i)
    extra = [(k, part) for w, part in altered if (k := matcher.values([w])) is not None]
    near, owner = np.array(rows).reshape(len(rows), len(marks)), np.array(owner, int)

    def machine(own: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, float]:
        """The machine on some sentences, and on the others of the clean documents among ``used``."""
        x = np.concatenate([near[own], np.zeros((1, len(marks))), np.array([k for k, _ in extra]).reshape(len(extra), len(marks))])
        side = np.concatenate([y[owner[own]], [-1], np.ones(len(extra))])
        weight = np.concatenate([np.ones(int(own.sum())), [others[used & (y < 0)].sum() + 1], np.zeros(len(extra))])
        if extra:
            weight[-len(extra) :] = np.array([part for _, part in extra]) * ALTERED * weight[side > 0].sum() / len(marks)
        weight = np.where(side > 0, weight / max(weight[side > 0].sum(), 1), weight / weight[side < 0].sum())
        # The empty row must not outweigh the clean sentences that come near a landmark.
        clean_near = (side < 0) & x.any(axis=1)
        weight[clean_near] += 1.0 / max(1, clean_near.sum())
        w, bias = _machine(x @ root, side.astype(float), weight)
        return root @ w, bias

    def solved(used: np.ndarray) -> tuple[np.ndarray, float]:
        """The machine on some documents. Not every sentence of a toxic document is toxic: at first all that come near a
        landmark count, then those on the toxic side, and each document's best."""
        own = used[owner]
        w, bias = machine(own, used)
        for _ in range(ROUNDS):
            d = near @ w + bias
            top = np.full(len(texts), -np.inf)
            np.maximum.at(top, owner, d)
            w, bias = machine(own & ((y[owner] < 0) | (d > 0) | (d >= top[owner])), used)
        return w, bias

    def decided(w: np.ndarray, bias: float, used: np.ndarray) -> np.ndarray:
        d = np.full(len(texts), bias)
        np.maximum.at(d, owner, near @ w + bias)
        return d[used]

    everyone = np.ones(len(texts), bool)
    w, bias = solved(everyone)
    # Every FOLDS-th document of either kind is decided by a machine that the others gave.
    fold = np.zeros(len(texts), int)
    for k in (1, -1):
        fold[y == k] = np.arange((y == k).sum()) % FOLDS
    d = decided(w, bias, everyone)
    if min(len(toxic), len(clean)) >= 4 * FOLDS:
        for f in range(FOLDS):
            d[fold == f] = decided(*solved(fold != f), fold == f)
    slope, shift = _curve(d, (y > 0).astype(float))
    matcher.forget()
    return Model(matcher, w, bias, slope, shift)


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Model:
    """Fit on bounded numbers of rows of ``labels`` (doc_id, toxic) of each kind that have a document, and at most SAMPLE_BYTES of text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.where("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id", "toxic"]
    some = known.where("toxic = 1").orderBy(*order).limit(most_toxic).unionByName(known.where("toxic = 0").orderBy(*order).limit(most_clean))
    found = sample_texts(docs, some, "toxic").limit(2 * (most_toxic + most_clean)).toArrow()
    return fit(found["text"].to_pylist(), found["toxic"].to_pylist())


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (doc_id by default) and score, 0 to 1, for each row of ``docs``.

    Null and empty texts, and those without letters, get the score of a text that comes near no landmark. Repeated rows
    and null ids each get their answer.
    """
    bounded_batches(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column("_kw_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(m.scores(texts))], [*keep, "score"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").alias("_kw_text")).mapInArrow(run, f"{fields}, score double")
