import math

import numpy as np
import pytest

from kilnwork.operators import matching as M


def contour(seed):
    rng = np.random.default_rng(seed)
    y = np.linspace(55, 300, 60)
    centre = 180 + rng.uniform(5, 20) * np.sin(np.pi * rng.uniform(0.7, 1.6) * (y - 55) / 245)
    bump = rng.uniform(8, 30) * np.exp(-(((y - rng.uniform(90, 260)) / rng.uniform(10, 40)) ** 2))
    return np.stack([centre - rng.uniform(15, 30) - bump, y], 1), np.stack([centre + rng.uniform(15, 30), y], 1)


def moved(p, angle=20):
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    return 1.7 * p @ np.array([[c, s], [-s, c]]) + [0.41, -0.28]


def rows(contours):
    put = lambda w: [(float(x), float(y)) for x, y in w]
    return [(i, put(a), put(b)) for i, (a, b) in contours]


@pytest.fixture(scope="module")
def tables(spark):
    schema = f"id long, {M.WALLS}"
    refs = [(i, contour(i)) for i in range(40)]
    asked = [(100, tuple(map(moved, contour(7)))), (101, contour(21))]
    empty = [(99, [], [])]
    return spark.createDataFrame(rows(asked), schema), spark.createDataFrame(rows(refs) + empty, schema).repartition(4)


def test_the_same_shape_wins(tables):
    queries, refs = tables
    got = M.match(queries, refs, 12, ((24, 4, 1), (48, 2, 0))).collect()
    first = {r.query_id: r.ref_id for r in got if r.place == 1}
    assert first == {100: 7, 101: 21}
    assert all(r.score < 0.2 for r in got if r.place == 1)
    assert {r.query_id: r.rotation for r in got if r.place == 1}[100] == pytest.approx(20, abs=1)


def test_dct_baseline(tables):
    queries, refs = tables
    got = M.dct_baseline(queries, refs, 5).where("rank = 1").collect()
    assert {(r.query_id, r.ref_id, round(r.coverage, 2)) for r in got} == {(100, 7, 1.0), (101, 21, 1.0)}
    assert all(r.rmsd < 1e-3 for r in got)


def test_vectors_do_not_depend_on_place():
    a, b = contour(3)
    assert np.allclose(M.dct_vector(a, b, 0.8), M.dct_vector(moved(a, 31), moved(b, 31), 0.8), atol=1e-9)
    assert np.allclose(M.descriptor(a, b, 0.7), M.descriptor(moved(a, 31), moved(b, 31), 0.7), atol=1e-5)
    assert M.score_pair((a, b), (moved(a, 170), moved(b, 170)), 24) is None
