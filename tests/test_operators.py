import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kilnwork.functions import boxes as B
from kilnwork.functions import kernels as K
from kilnwork.functions import scoring as S
from kilnwork.functions import text as X
from kilnwork.operators import detections as D
from kilnwork.operators import evaluation as E
from kilnwork.operators import linking as L
from kilnwork.operators import retrieval as R
from kilnwork.operators import sets as Q
from kilnwork.operators import tables as T


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_text(spark):
    s = lambda f, v: one(spark, f(F.lit(v)))
    assert [s(X.normalize_number, v) for v in ("No. 002A", " 01 ", "(3)", "x12", "000", None)] == ["2a", "1", "3", "x12", "0", ""]
    assert [s(X.normalize_figure, v) for v in ("Figure 2.01, continued.", "fig. 2:3", "2-4.")] == ["2.01", "2.3", "2.4"]
    assert s(X.strict_figure, "bowl") == "" and s(X.card_stem, "a.b.PNG") == "a.b"
    assert s(X.printed_page, "text\nIRON AGE   21\nFigure 2.1") == "21" and s(X.printed_page, None) == ""
    c = s(X.caption, "x\nFigure 2.1, continued. Bowls\ny")
    assert (c.figure, c.continued) == ("2.1", True)
    assert tuple(s(X.parse_box, "(1, 2.5, 3.5, -4)")) == (1, 2, 3, -4) and s(X.parse_box, "1 2") is None
    keys = {v: s(X.natural_key, v) for v in ("p2", "p10", "P1a", "10", "9")}
    assert sorted(keys, key=keys.get) == ["9", "10", "P1a", "p2", "p10"]
    assert s(X.bracket_fields, "[a] x [ b ] [a]") == ["a", "b"] and s(X.first_number, "ca. -3,5 cm") == -3.5
    import uuid

    assert one(spark, X.uuid5(uuid.NAMESPACE_DNS.hex, F.lit("example.org"))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "example.org"))


def test_link_cases(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "3"), ("e", None)], "file string, number string")
    b = spark.createDataFrame([("1", "Pithos"), ("2", "Bowl"), ("2", "Jar"), ("3", "Cup"), ("9", "Lid")], "number string, kind string")
    got = {r.file: (r.status, r.kind) for r in L.unique_key_link(a, b, ["number"], ["kind"]).collect()}
    assert got == {"a": ("ready", "Pithos"), "b": ("needs_review", None), "c": ("needs_review", None), "d": ("needs_review", None), "e": ("needs_review", None)}
    codes = {(r.number, r.code) for r in L.link_warnings(a.where("number is not null"), b, ["number"]).collect()}
    assert codes == {("2", "duplicate_table_number"), ("3", "duplicate_drawing_number"), ("9", "unexpected_table_row")}


def test_upsert_twice_is_once(spark):
    cur = spark.createDataFrame([(1, "", None), (2, "manual", None), (3, "old", "old")], "k long, c string, applied_c string")
    new = spark.createDataFrame([(1, "n"), (2, "n"), (3, "n")], "k long, c string")
    once = L.ownership_upsert(cur, new, "k", ["c"], True)
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(once) == [(1, "n", "n"), (2, "manual", None), (3, "n", "n")] == rows(L.ownership_upsert(once, new, "k", ["c"], True))


def test_collapse(spark):
    rows = [("f", "s1", "1", 1), ("f", "s1", "2", 2), ("f", "s2", "2", 3), ("f", "s2", "1", 4), ("f", "s3", "1", 5), ("g", "s1", "", 1), ("g", "s2", "", 2)]
    got = L.collapse_sources(spark.createDataFrame(rows, "figure string, source string, number string, ord long"), "figure", "source", "number", "ord")
    assert {(r.figure, r.source) for r in got.collect()} == {("f", "s1"), ("f", "s3"), ("g", "s1"), ("g", "s2")}


@pytest.mark.parametrize(("keep", "reserve", "expected"), [(8, 1, [*range(8), 15, 16]), (5, 0, list(range(5)))])
def test_cascade(spark, keep, reserve, expected):
    rows = [("q", f"r{i:02}", i / 100, 1 if i == 15 else 100 + i, 1 if i == 16 else 100 + i) for i in range(20)]
    df = spark.createDataFrame(rows, "query_id string, ref_id string, score double, outline_rank int, ribbon_rank int").repartition(3)
    assert [int(r.ref_id[1:]) for r in R.cascade(df, keep, reserve, ["query_id"]).orderBy("place").collect()] == expected


def test_metrics(spark):
    ranks = spark.createDataFrame([("a", 1), ("a", 5), ("a", 6), ("a", None)], "g string, rank int")
    m = E.rank_metrics(ranks, ["g"], [1, 5, 10], 400).first()
    assert (m.top_1, m.top_5, m.top_10, m.top_5_share, m.median_rank) == (1, 2, 3, 0.5, 5.5)
    assert m.mrr_found == pytest.approx((1 + 1 / 5 + 1 / 6) / 3) and m.mrr_all == pytest.approx((1 + 1 / 5 + 1 / 6) / 4)
    assert E.recall_curve(ranks, ["g"], 150).count() == 150
    w = one(spark, S.wilson(F.lit(50), F.lit(100)))
    assert w.low == pytest.approx(0.4038, abs=2e-4) and w.high == pytest.approx(0.5962, abs=2e-4)
    for b, c in ((0, 0), (1, 0), (3, 9), (200, 260), (900, 1500)):
        exact = min(1.0, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c))
        assert one(spark, S.mcnemar(F.lit(b), F.lit(c))) == pytest.approx(exact, rel=1e-9)
    pixels = spark.createDataFrame([("p", 1, 0), ("p", 1, 1), ("p", 0, 1), ("p", 0, 0), ("e", 0, None)], "pair string, a int, b int")
    got = {r.pair: r for r in E.mask_metrics(pixels, "pair", "a", "b").collect()}
    assert got["p"].iou == pytest.approx(1 / 3) and got["p"].dice == 0.5 and not got["e"].valid and got["e"].iou is None


def test_scoring(spark):
    d = lambda a, b, p=1.5, q=0.75: one(spark, S.diameter_similarity(F.lit(a), F.lit(b), F.lit(p), F.lit(q)))
    x = F.lit(None).cast("double")
    assert one(spark, S.diameter_similarity(x, F.lit(3.0), F.lit(1.5), F.lit(0.75))) == 0.5
    assert 0 < d(10.0, 20.0) < d(10.0, 13.0) < d(10.0, 10.8) and d(20.0, 22.0) > 0.95 and d(10.0, 20.0) < 0.15 and d(20.0, 25.0) >= 0.75
    fused = lambda shape, cost, strength, gap: one(spark, S.fuse(F.lit(shape), F.lit(cost).cast("double"), F.lit(strength), F.lit(gap).cast("double"), F.lit(0.5)))
    assert fused(0.4, None, 0.0, None) == 0.4 and fused(0.4, 0.02, 2.0, 0.0) < 0.4 < fused(0.4, 0.8, 2.0, 0.0) < fused(0.4, 0.8, 2.0, 20.0)
    c = lambda a, b: one(spark, S.colour_similarity(F.lit(a), F.lit(b)))
    assert c("5YR 6/4", "5YR 6/4") == pytest.approx(1) and c("5YR 6/4", "7.5YR 6/4") > c("5YR 6/4", "5BG 6/4")
    assert c("dark gray", "gray") > c("dark gray", "red") and c("zig", "zag") == pytest.approx(0.35)
    assert one(spark, S.ordinal_similarity(F.array(F.lit(1), F.lit(3)), F.array(F.lit(3)))) == 1


def test_retrieval_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 4, (300, 6)).astype(float)
    refs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "id long, v array<double>").repartition(7)
    channels = [R.Channel("outline", 0, 3), R.Channel("ribbon", 3, 6)]
    got = R.shortlist(refs.where("id < 5"), refs, channels, 20, 8).collect()
    for q in range(5):
        scores = [[((v[q, c.begin : c.end] - x[c.begin : c.end]) ** 2).sum() for x in v] for c in channels]
        ranks = [{i: n + 1 for n, i in enumerate(sorted(range(300), key=lambda i: (s[i], i)))} for s in scores]
        order = sorted(range(300), key=lambda i: (min(r[i] for r in ranks), sum(r[i] for r in ranks), i))[:20]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.position)
        assert [r.ref_id for r in mine] == order
        assert all((r.outline_rank, r.ribbon_rank) == (ranks[0][r.ref_id], ranks[1][r.ref_id]) for r in mine)
    assert R.shortlist(refs.where("id < 0"), refs, channels, 20).count() == 0


def walls():
    y = np.linspace(55, 300, 90)
    centre = 180 + 13 * np.sin(np.pi * (y - 55) / 245)
    return np.stack([centre - 27 - 16 * np.exp(-(((y - 145) / 13) ** 2)), y], 1), np.stack([centre + 24, y], 1)


def moved(p):
    c, s = math.cos(math.radians(31)), math.sin(math.radians(31))
    return 1.7 * p @ np.array([[c, s], [-s, c]]) + [0.41, -0.28]


def test_kernels():
    a, b = walls()
    assert K.outline_descriptor(a).shape == (226,) and K.ribbon_descriptor(a, b).shape == (299,)
    assert np.allclose(K.outline_descriptor(a), K.outline_descriptor(moved(a)), atol=1e-5)
    assert np.allclose(K.ribbon_descriptor(a, b), K.ribbon_descriptor(moved(a), moved(b)), atol=1e-5)
    scale, turn, shift = K.similarity(a, moved(a))
    assert scale == pytest.approx(1.7) and np.allclose(scale * a @ turn + shift, moved(a)) and np.linalg.det(turn) == pytest.approx(1)
    assert np.linalg.det(K.similarity(a, a * [-1, 1])[1]) == pytest.approx(1)
    assert K.isotonic(np.array([1, 3, 2, 2, 5, 4])).tolist() == pytest.approx([1, 7 / 3, 7 / 3, 7 / 3, 4.5, 4.5])
    cost = np.abs(np.arange(8)[:, None] - np.arange(8)[None, :]).astype(float)
    assert K.banded_dtw(cost, 3) == (0.0, [(i, i) for i in range(8)])
    x, y = K.resample(a, 24), K.resample(moved(a), 24)
    da, db = (np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1)) for p in (x, y))
    plan, value = K.transport(da / da.max(), db / db.max(), np.abs(np.linspace(0, 1, 24)[:, None] - np.linspace(0, 1, 24)[None, :]))
    assert plan.sum(axis=1) == pytest.approx(np.full(24, 1 / 24)) and value < 0.02 and (plan.argmax(axis=1) == np.arange(24)).mean() > 0.9
    assert K.salience(a, a) == pytest.approx(0) and K.hausdorff95(a, a) == 0
    assert np.array_equal(K.synthetic_query(a, 3, 0.7, 0.01), K.synthetic_query(a, 3, 0.7, 0.01))
    sheets = K.pack([(5, 5), (5, 5), (10, 5), (4, 4), (99, 1)], 10, 10)
    assert [s for s, *_ in sheets] == [0, 0, 0, 1, -1]


def test_dct(spark):
    x = np.random.default_rng(1).normal(size=16)
    df = spark.createDataFrame([(x.tolist(),)], "v array<double>").select(B.dct(F.col("v"), 16, 16).alias("c"), "v").select(B.inverse_dct(F.col("c"), 16, 16).alias("back"), B.rms_distance(F.col("c"), F.col("c")).alias("d"))
    r = df.first()
    assert np.allclose(r.back, x) and r.d == 0


def test_reconcile_keeps_identities(spark):
    s = "page string, ord long, x1 double, y1 double, x2 double, y2 double, confidence double"
    found = spark.createDataFrame([("p", 0, 152.0, 81.0, 332.0, 281.0, 0.9), ("p", 1, 41.0, 42.0, 241.0, 262.0, 0.8), ("n", 0, 0.0, 0.0, 5.0, 5.0, 0.5)], s)
    prior = spark.createDataFrame([("p", 1, 40.0, 40.0, 240.0, 260.0, "approved", "detector"), ("p", 2, 150.0, 80.0, 330.0, 280.0, "pending", "detector"), ("p", 3, 900.0, 0.0, 950.0, 50.0, "pending", "manual"), ("p", 4, 700.0, 0.0, 750.0, 50.0, "pending", "detector")], "page string, vessel_id long, x1 double, y1 double, x2 double, y2 double, status string, source string")
    got = {(r.page, r.vessel_id): (r.x1, r.stale) for r in D.reconcile(found, prior).collect()}
    assert got == {("p", 2): (152.0, False), ("p", 1): (40.0, False), ("p", 3): (900.0, False), ("p", 4): (700.0, True), ("n", 0): (0.0, False)}


def test_scales_and_tokens(spark):
    cards = spark.createDataFrame([("i", "a", 5.0, 5.0), ("i", "b", 50.0, 5.0), ("j", "c", 1.0, 1.0)], "image string, card string, x double, y double")
    scales = spark.createDataFrame([("i", 0, 9.0, None, "resolved"), ("i", 1, 2.0, (10.0, 10.0, 0.0, 0.0), "resolved"), ("i", 2, 3.0, (0.0, 0.0, 10.0, 10.0), "resolved")], "image string, ord int, ratio double, zone struct<x1:double,y1:double,x2:double,y2:double>, status string")
    assert {r.card: r.px_per_cm for r in D.choose_scale(cards, scales).collect()} == {"a": 2.0, "b": 9.0, "c": None}
    tokens = spark.createDataFrame([("p", "1", 0.9, 10.0, 60.0, 24.0, 82.0), ("p", "Pithos", 0.9, 45.0, 60.0, 100.0, 82.0), ("p", "2", 0.9, 10.0, 220.0, 24.0, 242.0), ("p", "Bowl", 0.9, 45.0, 220.0, 90.0, 242.0)], "page string, text string, score double, x1 double, y1 double, x2 double, y2 double")
    assert {r.text: r.line for r in T.text_lines(tokens).collect()} == {"1": 0, "Pithos": 0, "2": 1, "Bowl": 1}
    anchors = tokens.where("x1 = 10").select("page", F.col("y1").alias("y"))
    bounds = T.row_bounds(anchors).withColumn("row", F.col("y"))
    heads = [("p", "No", 0.9, 10.0, 2.0, 20.0, 12.0), ("p", "Type", 0.9, 45.0, 2.0, 80.0, 12.0), ("p", "Color Man", 0.8, 85.0, 2.0, 145.0, 12.0)]
    header = spark.createDataFrame(heads, "page string, text string, score double, x1 double, y1 double, x2 double, y2 double").withColumns({"rule_y": F.lit(20.0), "width": F.lit(200.0)})
    names = [("No.", 0, ("no",)), ("Type", 0, ("type",)), ("Color", 0, ("color", "colour")), ("Man", 0, ("man",))]
    columns = T.column_bounds(header, names)
    assert [tuple(r) for r in columns.orderBy("left").collect()] == [("p", "No.", 7.0, 42.0), ("p", "Type", 42.0, 82.0), ("p", "Color", 82.0, 120.0), ("p", "Man", 120.0, 200.0)]
    assert T.column_bounds(header, [*names, ("Decor", 0, ("decor",))]).count() == 0
    cells = bounds.join(columns, "page")
    got = {(r.row, r.column): r.text for r in D.tokens_in_cells(tokens, cells).collect()}
    assert got == {(60.0, "No."): "1", (60.0, "Type"): "Pithos", (220.0, "No."): "2", (220.0, "Type"): "Bowl"}
    found = [("p", 100.0, 20.0, "1", False, True, True, 0.9), ("p", 104.0, 20.0, "11", True, False, False, 0.5), ("p", 108.0, 20.0, "11", True, True, False, 0.4), ("p", 160.0, 20.0, "2", True, True, True, 0.8)]
    rows = T.row_anchors(spark.createDataFrame(found, "page string, y double, height double, text string, expected boolean, page_pass boolean, exact boolean, score double")).orderBy("y").collect()
    assert [(r.y, r.text, r.conflict) for r in rows] == [(108.0, "11", True), (160.0, "2", False)]


def test_table_rules(spark):
    rows = [
        ("A  b", 0.9, "a B", 0.1, "x", False, "type"), ("", 0.0, "p", 0.8, "P ", False, "type"), ("c", 0.5, "p", 0.8, "p", False, "type"), ("c", 0.95, "p", 0.8, "p", False, "type"), ("", 0.0, "p", 0.6, "p", False, "type"),
        ("", 0.0, "p", 0.9, "x", False, "type"), ("", 0.0, "p", 0.9, "x", True, "type"), ("c", 0.2, "p", 0.9, "x", False, "type"), ("9", 0.9, "9", 0.9, "9", False, "table_no"), ("", 0.0, "", 0.0, "", False, "type"),
    ]
    got = spark.createDataFrame(rows, "c string, cs double, p string, ps double, safe string, removed boolean, column string")
    r = [tuple(x.v) for x in got.select(T.reading(*[F.col(c) for c in ("c", "cs", "p", "ps", "safe", "removed")], F.lit("4"), F.col("column")).alias("v")).collect()]
    assert r == [
        ("A  b", "cell_pass", None), ("p", "page_pass_blank_cell", None), ("p", "page_pass", None), ("c", "cell_pass", None), ("p", "page_pass_fallback", None),
        ("", "cross_column_page_withheld", "cross_column_ocr_withheld"), ("p", "page_pass_blank_cell", None), ("c", "cell_pass", None), ("4", "row_anchor", None), ("", "cell_pass", None),
    ]
    anchors = spark.createDataFrame([("p", 0.0, 1), ("p", 10.0, 2), ("p", 41.0, 5), ("p", 200.0, 7)], "page string, y double, number int")
    assert sorted((r.number, r.y) for r in T.recover_anchors(anchors).where("recovered").collect()) == [(3, pytest.approx(10 + 31 / 3)), (4, pytest.approx(10 + 62 / 3))]
    pages = spark.createDataFrame([("s", i, f"p{i}", f) for i, f in enumerate(["2.1", None, None, "2.2", None])], "source string, logical_index int, image_name string, figure_id string")
    drawings = spark.createDataFrame([("2.1", "s", 0), ("2.1", "s", 1)], "figure string, source string, logical_index int")
    assert [r.image_name for r in T.candidate_pages(pages, drawings).orderBy("logical_index").collect()] == ["p0", "p1", "p2"]


def test_sets(spark):
    pages = spark.createDataFrame([("d", "first", "a", 0), ("d", "first", "b", 1), ("d", "second", "c", 2)], "project string, pdf string, page string, logical_index long")
    new = spark.createDataFrame([("d", "first", "x", 0), ("d", "first", "y", 1)], pages.schema)
    got = Q.replace_block(pages, new, "project", "pdf", "logical_index").orderBy("logical_index").collect()
    assert [(r.page, r.logical_index) for r in got] == [("x", 0), ("y", 1), ("c", 2)]
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None)], "k int, rev int, v string")
    assert {r.k: r.v for r in Q.last_of_each(df, ["k"], [F.col("rev")]).collect()} == {1: "b", 2: None}
    assert Q.last_of_each(df.limit(0), ["k"], [F.col("rev")]).count() == 0


def test_partitions_do_not_matter(spark):
    rows = [(i % 7, i, float(i * 37 % 11)) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, id long, v double")
    a, b = (sorted(map(tuple, Q.one_of_each(d, ["k"], [F.col("v"), F.col("id")]).collect())) for d in (df.repartition(1), df.repartition(9)))
    assert a == b and isinstance(pd.DataFrame(a), pd.DataFrame)
