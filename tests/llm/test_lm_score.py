import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kilnwork.llm import lm_score as lm
from kilnwork.llm.textops import words


def say(rng, n, mixed=False):
    """Words that mostly follow their predecessor in a ring."""
    at, out = rng.randrange(40), []
    for _ in range(n):
        out.append(f"w{at}")
        at = rng.randrange(40) if rng.random() < 0.1 else (at * 7 + 3) % 40
    if mixed:
        rng.shuffle(out)
    return " ".join(out)


def hashed(text):
    return words(pa.array([text])).hash


def test_contexts():
    got = lm.contexts(np.array([1, 2, 3, 4, 5]), np.array([0, 3, 3, 5])).tolist()
    o = lm.IDS
    assert got == [[o, o, 2, 3], [o, 1, 3, o], [1, 2, o, o], [o, o, 5, o], [o, 4, o, o]]


def plainly(net, around, target):
    """ln P of one id, number by number."""
    x = [float(c) for i in around for c in net.codes[i]]
    z = [sum(a * float(w) for a, w in zip(x, net.inner[:, j], strict=True)) + float(net.inner_bias[j]) for j in range(lm.HIDDEN)]
    h = [v / (1 + abs(v)) for v in z]
    total, node = 0.0, 0
    for level, shift in enumerate((8, 4, 0)):
        out, bias = getattr(net, f"out{level}")[node], getattr(net, f"bias{level}")[node]
        e = [math.exp(sum(a * float(w) for a, w in zip(h, row, strict=True)) + float(b)) for row, b in zip(out, bias, strict=True)]
        digit = target >> shift & 15
        total += math.log(e[digit] / sum(e))
        node = target >> shift
    return total


def test_probabilities_against_plain_sums_and_gradient():
    rng = np.random.default_rng(0)
    net = lm.Network.of(rng.normal(size=lm.SIZE).astype(np.float32) * 0.3)
    around = np.repeat(rng.integers(0, lm.IDS + 1, (1, 4)), lm.IDS, axis=0).astype(np.uint16)
    each = lm.log_probabilities(net, around, np.arange(lm.IDS))
    assert np.exp(each).sum() == pytest.approx(1, abs=1e-4)
    for target in (0, 17, 300, 4095):
        assert each[target] == pytest.approx(plainly(net, around[0].tolist(), target), abs=1e-4)
    # A small step along the gradient lowers the loss by its square.
    context, target = rng.integers(0, lm.IDS, (50, 4)).astype(np.uint16), rng.integers(0, lm.IDS, 50)
    moved = {}
    t = lm.Trainer(lm.Network.of(net.flat()))

    def keep(name, g, rows=slice(None)):
        full = np.zeros_like(getattr(net, name))
        full[rows] = g * np.sqrt(50)
        moved[name] = full

    t._move = keep
    t.step(context, target)
    assert set(moved) == {n for n, _ in lm._SHAPES}
    eps = 1e-2
    for name, g in moved.items():
        if name != "bias0":
            other = [lm.Network.of(net.flat()) for _ in "ab"]
            for o, sign in zip(other, (1, -1), strict=True):
                getattr(o, name)[...] += sign * eps * g / np.linalg.norm(g)
            change = (lm.log_probabilities(other[1], context, target).sum() - lm.log_probabilities(other[0], context, target).sum()) / (2 * eps)
            assert change == pytest.approx(np.linalg.norm(g), rel=0.05, abs=0.1), name


def test_held_out_documents_and_layout(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, say(rng, 400)) for i in range(200)], "doc_id long, text string")
    model = lm.train(docs.repartition(6), shard=10_000, step=256)
    good, bad = [say(rng, 300) for _ in range(20)], [say(rng, 300, True) for _ in range(20)]

    def mean(texts):
        return [lm.log_probabilities(model.net, lm.contexts(ids, w.first), ids).mean() for t in texts for w in [words(pa.array([t]))] for ids in [model.vocabulary.look_up(w.hash)[0]]]

    assert min(mean(good)) > max(mean(bad))
    assert np.mean(mean(good)) > -np.log(40)  # better than the words' own frequencies
    # Neither files nor tasks make a difference.
    again = lm.train(docs.repartition(2, "text").sortWithinPartitions("doc_id"), shard=10_000, step=256)
    assert np.array_equal(model.net.flat(), again.net.flat())
    some, others = (sorted((r.doc_id, r.log_likelihood) for r in lm.score(docs.repartition(n).limit(1000), m).collect()) for n, m in ((3, model), (7, again)))
    assert [i for i, _ in some] == [i for i, _ in others] and np.allclose([x for _, x in some], [x for _, x in others], rtol=1e-6)


def test_more_is_learnt_from_a_larger_corpus(spark):
    held = [say(random.Random(9), 300) for _ in range(20)]
    got = []
    for n in (20, 200):
        rng = random.Random(2)
        model = lm.train(spark.createDataFrame([(i, say(rng, 200)) for i in range(n)], "doc_id long, text string"), shard=5_000, step=256)
        got.append(np.mean([lm.log_probabilities(model.net, lm.contexts(ids, w.first), ids).mean() for t in held for w in [words(pa.array([t]))] for ids in [model.vocabulary.look_up(w.hash)[0]]]))
    assert got[1] > got[0] + 0.1


def test_averaging_tree(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN", 3)
    rng = np.random.default_rng(4)
    nets = [(t, int(rng.integers(1, 9)), rng.normal(size=lm.SIZE).astype(np.float32)) for t in (0, 1, 2, 5, 11, 27)]
    rows = [(t, b, n, bytearray(f[b * lm.BLOCK : (b + 1) * lm.BLOCK].tobytes())) for t, n, f in nets for b in range(-(-lm.SIZE // lm.BLOCK))]
    got = lm._average(spark.createDataFrame(rows, "shard long, block int, n long, part binary"), np.zeros(0))
    assert np.allclose(got, sum(n * f for _, n, f in nets) / sum(n for _, n, _ in nets), atol=1e-5)


def test_documents(spark):
    rows = [(1, "a b c", 0), (1, "a b c", 0), (2, None, 0), (None, " \n", 0), (3, "x " * 100_000, 0), (4, "y" * 50_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = lm.score(docs, lm.train(docs)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_once) for r in got) == sorted((str(i), len((t or "").split()), int(i == 4)) for i, t, _ in rows)
    for r in got:
        assert (r.log_likelihood, r.mean_log_likelihood) == (0.0, None) if not r.n_tokens else r.log_likelihood < 0
    flat = lm.score(docs.limit(0), lm.train(docs.limit(0)))
    assert flat.count() == 0
    start = lm.score(docs.limit(1), lm.train(docs.limit(0))).first()
    assert start.mean_log_likelihood == pytest.approx(-np.log(lm.IDS), abs=0.5) and start.n_once == 3


def test_query_against_brute_force(spark, monkeypatch):
    """Counts by a dictionary, ids and shares from the definition, the network's sums number by number."""
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["the", "The", "of", f"z{rng.randrange(60)}", f"y{rng.randrange(4000)}", f"x{i}"]) for _ in range(rng.randint(0, 25)))) for i in range(60)]
    rows += [(100, "only here and here"), (101, "twice over word" + "s" * 300), (102, "twice over word" + "s" * 300), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    count = Counter(w.lower() for _, t in rows for w in (t or "").split())
    code = {w: int(hashed(w)[0]) for w in count}
    for head, exact in ((0, 0), (50, 3)):
        monkeypatch.setattr(lm, "HEAD", head)
        model = lm.train(docs, exact=exact)
        # Ids by the definition: the commonest words of different slots, the others by the highest bits.
        steps = Counter(math.floor(8 * math.log2(n)) for n in count.values())
        least = min((s for s in steps if sum(k for t, k in steps.items() if t >= s) <= head), default=None)
        ranked = sorted((w for w in count if least is not None and math.floor(8 * math.log2(count[w])) >= least), key=lambda w: (-count[w], code[w]))
        slots, own = set(), {}
        for w in ranked:
            if code[w] >> 44 not in slots and len(own) < exact:
                own[w] = len(own)
            slots.add(code[w] >> 44)
        ids = {w: own.get(w, exact + (code[w] >> 55)) for w in count}
        total = Counter()
        for w, n in count.items():
            total[ids[w]] += n
        assert {i: n for i, n in enumerate(model.vocabulary.total.tolist()) if n} == dict(total)
        got = {r.doc_id: r for r in lm.score(docs, model).collect()}
        for d, t in rows[::15] + rows[-4:]:
            ws = [w.lower() for w in (t or "").split()]
            at = [lm.IDS] * 2 + [ids[w] for w in ws] + [lm.IDS] * 2
            s = sum(plainly(model.net, at[k : k + 2] + at[k + 3 : k + 5], ids[w]) + math.log(count[w] / (total[ids[w]] + 1)) for k, w in enumerate(ws))
            assert got[d].log_likelihood == pytest.approx(s, rel=1e-4, abs=1e-3) and got[d].n_tokens == len(ws)
            assert got[d].n_once == sum(count[w] == 1 for w in ws)
        # Documents that are there twice have no word that is there once.
        assert got[101].n_once == got[102].n_once == 0 < got[100].n_once
