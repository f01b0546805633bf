import random
import re
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest

from kilnwork.llm import near_dedup as nd
from kilnwork.llm.textops import shingles, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, percent):
    """(doc_id, n_shingles, component_id, kept) by all pairs."""
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        c = min(ids, default=None)
        out.append((d, len(sets[i]), c, c == d))
    return out, [root(i) for i in range(len(rows)) if sets[i]]


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeÉé") for _ in range(rng.randint(1, 7))) for _ in range(500)]
    say = lambda m: [rng.choice(vocabulary) for _ in range(m)]
    passage = say(60)
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.3:
            w = texts[0][:]
            for _ in range(rng.choice([1, 2, 3, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif texts and kind < 0.6:
            w = rng.choice(texts)[:]
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = say(rng.choice([1, 3, 5, 8, 60, 150, 400]) if texts else 150)
            if kind > 0.85:
                w += passage
        texts.append(w)
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(w).upper() if i % 7 == 0 else " ".join(w)) for i, w in enumerate(texts)]
    rows += [(900, None), (901, ""), (902, " \n "), (3, rows[3][1]), (None, rows[4][1]), (None, "lone words here"), (7, rows[8][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "percent", "most"), [(1, 85, 40), (2, 80, 2), (3, 85, 1)])
def test_against_brute_force(spark, seed, percent, most):
    rows = corpus(seed)
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, label string").repartition(5)
    s = replace(nd.AT_85 if percent == 85 else nd.Settings(), most_members=most, block=256 if seed == 1 else 4, most_broadcast=500_000 if seed == 1 else 0)
    got = [tuple(r) for r in nd.groups(table, s).collect()]
    expected, roots = brute(rows, percent)
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    kept = nd.deduplicated(table, s)
    assert kept.columns == table.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(left) == len(set(left))
    blank = [r for r in rows if not sets_of(r[1])]
    assert len(left) == len(blank) + len(set(roots))


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 10, 2000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        x = nd.sketches(a, np.array([0, n]), 400)
        assert (x != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    a = rng.integers(0, 1 << 63, 1200).astype(np.uint64)
    both = np.concatenate([np.sort(a[:1000]), np.sort(a[200:])])
    x = nd.sketches(both, np.array([0, 1000, 2000]), 800)
    assert abs((x[0] == x[1]).mean() - 800 / 1200) < 0.06


def test_shingles_of_chunks():
    texts = ["a b c d e f a b c d e f", "", None, "A B", " a  b ", "a b c d e", "x" * 50 + " y"]
    got, first = shingles(words(pa.array(texts)), 5)
    assert [b - a for a, b in zip(first[:-1], first[1:])] == [len(sets_of(t)) for t in texts]
    assert got[first[3]] == got[first[4]]


def test_empty(spark):
    assert nd.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert nd.deduplicated(spark.createDataFrame([(1, "a")], "doc_id long, text string")).count() == 1
