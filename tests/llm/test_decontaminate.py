import itertools
import random
import re

import numpy as np
import pyarrow as pa

from kilnwork.llm import decontaminate as de
from kilnwork.llm.textops import ALNUM, words


def wanted(n):
    """Of fewer than 7 words all, else 70 percent, at least 7 and at most 13."""
    return max(n, 1) if n < 7 else max(7, min(13, -(-7 * n // 10)))


def plain_best(equal):
    """The stretch with the highest score of all: equal words count 1, others -1.5; the earliest end, then the earliest beginning."""
    best = (0, 0, 0, 0)
    for end in range(len(equal) + 1):
        score = 0.0
        for begin in range(end - 1, -1, -1):
            score += 1 if equal[begin] else -1.5
            if score > best[0] or (score == best[0] and end == best[2]):
                best = (score, begin, end, sum(equal[begin:end]))
    return best[3], best[1], best[2]


def brute(docs, items):
    """Every pair along every diagonal."""
    out = []
    for d, t in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        for i, u in items:
            v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (u or "").lower())
            best = None
            for g in range(-len(v) + 1, len(w)):
                a, b = max(0, g), min(len(w), g + len(v))
                if sum(w[k] == v[k - g] for k in range(a, b)) < wanted(len(v)):
                    continue
                e, x, y = plain_best([w[k] == v[k - g] for k in range(a, b)])
                if e >= wanted(len(v)):
                    best = min(best or (1,), (-e, a + x, a + y))
            if best:
                out.append((d, i, -best[0], best[1], best[2], -best[0] / (best[2] - best[1])))
    return out


def corpus():
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(5, 50)))) for i in range(25)] + [(3, None), (None, ""), (90, "two words")]
    docs = [(0, None), (1, ""), (2, "x")]
    for d in range(3, 120):
        w = say(rng.randint(5, 150))
        if d % 2:
            v = items[rng.randrange(25)][1].split()
            for _ in range(len(v) // 9):
                v[rng.randrange(len(v))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = v
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w).upper() if d % 3 else " ".join(w)))
    return docs + docs[-2:] + [(None, docs[5][1])], items + items[2:3]


def test_against_brute_force(spark):
    docs, items = corpus()
    table = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(docs, items)
    assert len(expected) > 40
    got = [tuple(r) for r in de.overlaps(table, bench).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    dirty = {(d, t) for d, t in docs if d in {e[0] for e in expected}}
    kept = [(r.doc_id, r.text) for r in de.without_overlaps(table, bench).collect()]
    assert sorted(map(repr, kept)) == sorted(repr(x) for x in docs if x not in dirty)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert de.overlaps(docs, items).count() == 0 and de.without_overlaps(docs, items).count() == 1
    assert de.overlaps(docs.limit(0), spark.createDataFrame([(1, "a " * 30)], "item_id long, text string")).count() == 0


def changed(rng, w, kind):
    """Every third, fourth or fifth word replaced, or each with a probability."""
    if kind >= 1:
        return [f"new{rng.randrange(10**6)}" if k % kind == kind - 1 else x for k, x in enumerate(w)]
    return [f"new{rng.randrange(10**6)}" if rng.random() < kind else x for x in w]


def test_replaced_words_against_brute_force(spark):
    rng = random.Random(8)
    say = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate([1, 2, 3, 5, 6, 7, 8, 10, 13, 15, 20, 30, 45, 60])]
    docs = []
    for _, t in items:
        for kind in (3, 4, 5, 0.0, 0.1, 0.2, 0.25, 0.3, 0.3):
            docs.append((len(docs), " ".join(say(rng.randint(0, 20)) + changed(rng, t.split(), kind) + say(rng.randint(0, 20)))))
    expected = brute(docs, items)
    assert {e[1] for e in expected} == {i for i, _ in items} and len(expected) > 60
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in de.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_every_overlap_has_the_hits_that_are_asked_for():
    rng = np.random.default_rng(2)
    for n in (7, 8, 9, 10, 12, 13, 15, 18, 30, 60):
        every = np.array(list(itertools.product([False, True], repeat=n))) if n <= 12 else np.concatenate([rng.random((400, n)) >= rate for rate in (0.1, 0.25, 0.33, 0.4)])
        for equal in every[every.sum(axis=1) >= de.needed(n)]:
            e, a, b = de.best_stretch(equal)
            if e >= de.needed(n):
                assert sum(all(equal[p + o] for o in m) for m in de.MASKS for p in range(a, b - m[-1])) >= de.least_hits(n)


def test_masks_ignore_positions_between():
    h = words(pa.array(["a b c d e f"]), ALNUM).hash
    for m in de.MASKS:
        other = words(pa.array([" ".join(c if k in m else "z" for k, c in enumerate("abcdef"))]), ALNUM).hash
        assert de.seeds(h, m)[0] == de.seeds(other, m)[0]
    assert len({int(de.seeds(h, m)[0]) for m in de.MASKS}) == len(de.MASKS)


def test_shuffled_benchmark_and_hot_seeds(spark):
    docs, items = corpus()
    expected = brute(docs, items)
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in de.overlaps(table, bench, most_broadcast=10, hot=3).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    clean = de.without_overlaps(table, bench, most_broadcast=10, hot=3)
    assert clean.columns == table.columns and clean.count() == sum((d, t) not in {(d, t) for d, t in docs if d in {e[0] for e in expected}} for d, t in docs)


def test_hits_are_written_only_where_they_are_read_twice(spark, monkeypatch):
    docs, items = corpus()
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    written, stored = [], de.stored
    monkeypatch.setattr(de, "stored", lambda df, name: written.append(name) or stored(df, name))
    expected = sorted(map(repr, brute(docs, items)))
    assert sorted(repr(tuple(r)) for r in de.overlaps(table, bench).collect()) == expected
    assert written == ["items", "candidates"]
    written.clear()
    assert sorted(repr(tuple(r)) for r in de.overlaps(table, bench, most_broadcast=10, hot=3).collect()) == expected
    assert written == ["items", "sighted", "often", "candidates"]
