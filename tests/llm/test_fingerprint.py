import hashlib
import random
import time

import numpy as np
import pytest
import xxhash

from kilnwork.llm import fingerprint as fp

SCHEMA = "doc_id long, text string, borrowed int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(n))


def test_spans_and_extensions():
    rng = random.Random(2)
    a = "".join(rng.choice("ab\U0001f642") for _ in range(300))
    b = "".join(rng.choice("ab\U0001f642") for _ in range(50)) + a[40:200]
    p, q = fp.Prefixes(a), fp.Prefixes(b)
    for _ in range(2000):
        i, j = rng.randrange(len(a)), rng.randrange(len(b))
        n = rng.randint(0, min(len(a) - i, len(b) - j))
        assert p.same(i, q, j, n) == (a[i : i + n] == b[j : j + n])
        m = 0
        while i + m < len(a) and j + m < len(b) and a[i + m] == b[j + m]:
            m += 1
        assert p.extension(i, q, j) == m
    assert p.extension(40, q, 50) >= 160


def mixed(x):
    """The finaliser of splitmix64, on plain numbers."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def polynomial(text, base):
    return sum((ord(c) + 1) * pow(base, j, fp.PRIME) for j, c in enumerate(text)) % fp.PRIME


def plain_mark(text):
    """The fingerprint by its definition: every span by itself."""
    k = min(fp.SPAN, len(text))
    spans = {text[i : i + k] for i in range(len(text) - k + 1)} if k else set()
    least = sorted({mixed((polynomial(x, fp.BASES[0]) << 31) | polynomial(x, fp.BASES[1])) >> 32 for x in spans})[: fp.SKETCH]
    return f"{len(text):x}.{polynomial(text, fp.BASES[0]):08x}{polynomial(text, fp.BASES[1]):08x}." + "".join(f"{x:08x}" for x in least)


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = ({s.split(".")[2][i : i + 8] for i in range(0, len(s.split(".")[2]), 8)} for s in (a, b))
    both = sorted(x | y)[: fp.SKETCH]
    return sum(h in x and h in y for h in both) / len(both) if both else 0.0


def brute(rows):
    signed = lambda t: xxhash.xxh64(t.encode(), seed=42).intdigest() + 2**63
    rows = sorted(((i is not None, i or 0, signed(t or "") % 2**64, t or ""), i) for i, t in rows)
    texts = [(i, k[3]) for k, i in rows]
    out = []
    for at, (i, t) in enumerate(texts):
        u = texts[(at + 1) % len(texts)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + u[:half]
        m = [plain_mark(x) for x in (t, e, u)]
        common = 0
        while common < min(len(t), len(e)) and t[common] == e[common]:
            common += 1
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), m[0], m[1], plain_likeness(m[0], m[1]), plain_likeness(m[0], m[2]), common))
    return out


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_against_brute_force(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.randrange(0, 400), words(rng, rng.choice([0, 1, 3, 30, 100]))) for _ in range(60)]
    rows += [(5, None), (5, ""), (7, "same"), (7, "same"), (None, "none"), (None, None), (None, "more"), (10**12, "far"), (-3, "x" * 3000), (399, words(rng, 500)), (-(2**63), "least")]
    # An id that many rows have, beginning several ranges.
    rows += [(200, words(rng, 3)) for _ in range(40)]
    got = [tuple(r) for r in fp.fingerprints(spark.createDataFrame([(*r, 9) for r in rows], SCHEMA), ranges).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))


def test_many_ranges_plan_within_seconds(spark):
    rng = np.random.default_rng(3)
    ids = np.sort(rng.integers(0, 10**9, 100_000))
    found = fp.Ranges(ids[::5], np.zeros(20_000, bool), rng.integers(-(2**60), 2**60, 20_000))
    began = time.time()
    at, first = found.of(np.repeat(ids, 3), np.zeros(300_000, bool), rng.integers(-(2**60), 2**60, 300_000))
    assert time.time() - began < 5 and (np.diff(at) >= -1).all() and not first.any()


def test_small_tables(spark):
    assert fp.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    for rows in ([(4, "alone here")], [(4, None)], [(1, "ab"), (1, "ab")]):
        got = [tuple(r) for r in fp.fingerprints(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))


def test_likeness_follows_what_is_shared():
    rng = random.Random(8)
    a, b = words(rng, 900), words(rng, 900)
    marks = [fp.fingerprint(p.n, p.span(0, p.n), fp.sketch(p.spans())) for p in map(fp.Prefixes, (a, "x" + a, fp.edited_text(a, b), b))]
    assert fp.likeness(marks[0], marks[0]) == 1
    assert fp.likeness(marks[0], marks[1]) > 0.9 and 0.15 < fp.likeness(marks[0], marks[2]) < 0.55 and fp.likeness(marks[0], marks[3]) < 0.1
