import math
import random

import numpy as np
import pyarrow as pa

from kilnwork.llm import quality as q


def graded(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8)))
    out = []
    for _ in range(n):
        y = rng.randrange(3)
        junk = (0.6, 0.25, 0.0)[y]
        out.append((" ".join(word() + rng.choice(["###", "$$$", "!!"]) if rng.random() < junk else word() for _ in range(rng.randint(20, 80))), y))
    return out


def test_held_out_grades():
    model = q.fit(*map(list, zip(*graded(1, 900), strict=True)))
    assert len(model.thresholds) == 2 and model.thresholds[0] <= model.thresholds[1]
    texts, y = zip(*graded(2, 300), strict=True)
    above = model.above(q.features(pa.array(texts)))
    assert (above[:, 0] >= above[:, 1]).all()
    expected = model.expected(above)
    assert np.corrcoef(expected, y)[0, 1] > 0.9
    assert ((model.tail(above, 2) >= 0.5) == (np.array(y) == 2)).mean() > 0.9
    assert np.allclose(expected, model.tail(above, 1) + model.tail(above, 2))


def test_dot_products():
    x = q.features(pa.array(["a b", "a c c", "d"]))
    w = np.random.default_rng(1).normal(size=1 << q.BITS)
    assert np.allclose(x.dot(w), [sum(w[i] * v for i, v in zip(x.index[a:b], x.value[a:b])) for a, b in zip(x.first[:-1], x.first[1:])])


def test_documents(spark):
    rows = [(i, t, 7) for i, (t, _) in enumerate(graded(3, 200))] + [(None, None, 7), (900, "", 7), (900, "", 7), (901, "w###  " * 30_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep int")
    labels = spark.createDataFrame([(i, y, 0) for i, (_, y) in enumerate(graded(3, 200))] + [(None, 1, 0), (5, None, 0), (12345, 1, 0)], "doc_id long, quality int, toxic int")
    model = q.train(docs, labels)
    got = q.score(docs, model, 2, 0.5).collect()
    assert len(got) == len(rows) and all(0 <= r.p_grade <= 1 and 0 <= r.expected_grade <= 2 and r.keep == (r.p_grade >= 0.5) for r in got)
    kept = q.selected(docs, model, 2, 0.5)
    assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in got)
    assert {r.keep for r in got if r.doc_id == 901} == {False}
    none = q.train(docs, labels.limit(0))
    assert q.score(docs, none, 0, 0.5).where("keep").count() == len(rows) and q.score(docs.limit(0), model, 1, 0.5).count() == 0
    assert q.selected(docs.limit(0), model, 1, 0.5).count() == 0


def test_fit_against_plain_gradient_descent():
    """The same likelihood and steps, text by text and grade by grade, on the model's features."""
    rng = random.Random(3)
    texts, grades = [], []
    for i in range(60):
        g = i % 3
        texts.append(" ".join(rng.choice([["bad", "junk", "0x1"], ["fine", "plain", "some"], ["good", "clear", "well"]][g]) if rng.random() < 0.6 else "and" for _ in range(20)))
        grades.append(float(g))
    model = q.fit(texts, grades, epochs=15)
    x = q.compact(pa.array(texts))
    own = [dict(zip(x.index[a:b].tolist(), x.value[a:b].tolist(), strict=True)) for a, b in zip(x.first[:-1], x.first[1:], strict=True)]
    weights, seen = {}, {}
    share = [sum(g > k for g in grades) / 60 for k in range(2)]
    cut, seen_cut = [math.log((1 - s) / s) for s in share], [1e-8, 1e-8]
    logistic = lambda z: 1 / (1 + math.exp(-z))
    for _ in range(15):
        g_w, g_c = {}, [0.0, 0.0]
        for f, g in zip(own, map(int, grades), strict=True):
            z = sum(weights.get(j, 0.0) * v for j, v in f.items())
            p = [1.0] + [logistic(z - c) for c in cut] + [0.0]
            s = [v * (1 - v) for v in p]
            here = max(p[g] - p[g + 1], 1e-9)
            for j, v in f.items():
                g_w[j] = g_w.get(j, 0.0) - (s[g] - s[g + 1]) / here * v / 60
            for k in range(2):
                g_c[k] += ((g == k + 1) * s[k + 1] - (g == k) * s[k + 1]) / here / 60
        for j in {j for f in own for j in f}:
            g = g_w.get(j, 0.0) + 1e-6 * weights.get(j, 0.0)
            seen[j] = seen.get(j, 1e-8) + g * g
            weights[j] = weights.get(j, 0.0) - 0.5 * g / math.sqrt(seen[j])
        for k in range(2):
            seen_cut[k] += g_c[k] ** 2
            cut[k] -= 0.1 * g_c[k] / math.sqrt(seen_cut[k])
        cut[1] = max(cut)
    assert np.allclose(model.thresholds, cut, atol=1e-6) and all(abs(model.weights[j] - w) < 1e-5 for j, w in weights.items())
    above = model.above(q.features(pa.array(texts)))
    for f, row in zip(own, above, strict=True):
        z = sum(weights[j] * v for j, v in f.items())
        assert np.allclose(row, [logistic(z - c) for c in cut], atol=1e-4)
        assert abs(model.expected(row[None, :])[0] - row.sum()) < 1e-9 and model.tail(row[None, :], 1)[0] == row[0]
