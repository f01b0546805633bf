import json

from pyspark.sql import functions as F

from kilnwork.operators import curation as C


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_json_and_ascii(spark):
    cases = {'```json\n{"a": 1,}\n```': {"a": 1}, "text {“a”: [1, 2,]} more": {"a": [1, 2]}, '{"a": {"b": "x': None, '{"a": [{"b": 1}, {"c": ': {"a": [{"b": 1}]}, '[1, {"k": 2}, {"q"': {"k": 2}, "none": None, "": None, None: None}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = {r.i: r.j for r in df.select("i", C.repaired_json("t").alias("j")).collect()}
    for i, want in enumerate(cases.values()):
        assert (json.loads(got[i]) if got[i] else None) == want
    assert spark.createDataFrame([("ﬁne é½ A",)], "t string").select(C.printable_ascii("t")).first()[0] == "fine 12 A"


def test_review_and_reset(spark):
    s = "id long, box string, status string"
    stored = spark.createDataFrame([(1, "a", "approved"), (2, "b", "pending"), (3, "c", "pending")], s)
    given = spark.createDataFrame([(2, "b", "deleted"), (3, "c2", "approved"), (9, "n", "pending")], s)
    after = C.apply_review(stored, given, "id", ["box", "status"])
    assert rows(after) == sorted(map(repr, [(1, "a", "approved"), (2, "b", "deleted"), (3, "c2", "approved"), (9, "n", "pending")]))
    assert rows(C.reset_changed(stored, after, "id", "box", {"status": "pending"})) == sorted(map(repr, [(1, "a", "approved"), (2, "b", "deleted"), (3, "c2", "pending"), (9, "n", "pending")]))


def test_manifest_and_batch(spark):
    prior = spark.createDataFrame([("a", 300, "keep"), ("b", 300, "drop"), ("z", 100, "keep")], "k string, dpi int, decision string")
    wanted = spark.createDataFrame([("a", 300), ("b", 425), ("c", 425)], "k string, dpi int")
    assert rows(C.merge_manifest(prior, wanted, "k", ["dpi"], "decision")) == sorted(map(repr, [("a", 300, "keep", False), ("b", 425, "drop", True), ("c", 425, "pending", True), ("z", 100, "keep", False)]))
    results = spark.createDataFrame([(1, "v2", 400), (2, "v2", 399), (2, "v2", 400), (5, "v1", 400)], "q long, version string, pool long")
    assert rows(C.batch_faults(results, spark.range(1, 4).withColumnRenamed("id", "q"), "q", "version", "pool", 400)) == sorted(map(repr, [(2, "repeated"), (2, "short_pool"), (3, "missing"), (5, "unexpected"), (5, "other_version")]))


def test_order_and_letters(spark):
    r = spark.createDataFrame([("f", "10", "p2", 0), ("f", "2", "p2", 1), ("f", "2", "p1", 2), ("f", "", "p1", 3), ("f", "2a", "p9", 4)], "figure string, number string, page string, i int")
    p = spark.createDataFrame([("f", "p1", 5), ("f", "p2", 7)], "figure string, page string, logical_index int")
    assert [x.i for x in C.row_order(r, p, "figure", "number", "page", "i").orderBy("place").collect()] == [2, 1, 4, 0, 3]
    cards = spark.createDataFrame([("g", 1, "x"), ("g", 2, "y")], "g string, o int, card string")
    values = spark.createDataFrame([("g", "B", "Bowl"), ("g", "C", "none")], "g string, letter string, v string")
    assert rows(C.letters_back(cards, values, "g", "o", "card")) == [repr(("g", "B", "Bowl", "y"))]


def test_small_ones(spark):
    df = spark.createDataFrame([("a.PNG", "1")], "file string, v string")
    assert C.classified(df.select("file"), spark.createDataFrame([("a", "Bowl")], "file string, type string"), "file", "type", "ENT").first().type == "Bowl"
    assert C.ensure_columns(df, ["v", "w"]).columns == ["file", "v", "w"] and C.ensure_columns(df, ["v"]) is df
    d, r = (spark.createDataFrame(x, "f string, s string") for x in ([("1", "a")], [("1", "a"), ("1", "b"), ("2", "c")]))
    assert rows(C.foreign_sources(d, r, "f", "s")) == sorted(map(repr, [("1", ["b"]), ("2", ["c"])]))
    state = spark.createDataFrame([("k", [(1, "x")]), ("n", None)], "key string, diagnostics array<struct<page:int,note:string>>")
    new, side = C.migrated(state, "diagnostics", "key")
    assert new.columns == ["key", "version"] and rows(side) == [repr(("k", 1, "x"))]
    assert spark.range(1).select(C.canonical_field(F.lit(" Temper "))).first()[0] == "inclusions"


def test_guards_and_sources(spark):
    pages = spark.createDataFrame([("d", 0, "a.jpg"), ("d", 0, "b.jpg"), ("d", 1, "c.jpg")], "pdf string, i int, image string")
    assert rows(C.siblings(pages, "pdf", "i", "image")) == sorted(map(repr, [("a.jpg", "b.jpg"), ("b.jpg", "a.jpg")]))
    crops = spark.createDataFrame([("1", "a"), ("2", "zz")], "crop string, img string")
    assert rows(C.crop_sources(crops, pages, "img", "image", "pdf")) == sorted(map(repr, [("1", "a", "d"), ("2", "zz", None)]))
    q = spark.createDataFrame([(1, "q1", "t1"), (1, "q1", "t9"), (3, "q3", "t2")], "n int, q string, t string")
    t = spark.createDataFrame([("t1",), ("t2",), ("t2",)], "t string")
    assert rows(C.query_set_faults(q, t, "n", "q", "t", 3)) == sorted(map(repr, [("missing_number", "2"), ("repeated_number", "1"), ("repeated_query", "q1"), ("unknown_target", "t9"), ("several_references", "t2")]))
    n = spark.createDataFrame([("1", "2"), ("", "2"), (None, "nan")], "a string, b string").select(C.staged_number(F.col("a"), F.col("b")).alias("v"))
    assert [r.v for r in n.collect()] == ["1", "2", "?"]


def test_segmentation():
    import numpy as np

    from kilnwork.functions import kernels as K

    a = np.zeros((20, 20), bool)
    a[5:15, 5:15] = True
    b = np.roll(a, 1, axis=1)
    m = K.segmentation_metrics(a, b)
    assert m["iou"] == 90 / 110 and m["boundary_f1"] == 1 and m["hd95"] == 1 and K.segmentation_metrics(a, a)["mean_distance"] == 0
    assert K.segmentation_metrics(a, a & False)["hd95"] == np.inf
