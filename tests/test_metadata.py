import math
import re

import pytest
from pyspark.sql import functions as F

from kilnwork.functions import boxes as B
from kilnwork.functions import kernels as K
from kilnwork.functions import scoring as S
from kilnwork.operators import curation as C
from kilnwork.operators import linking as L
from kilnwork.operators import metadata as M


def values(spark, column, rows, schema):
    return [r.v for r in spark.createDataFrame(rows, schema).select(column.alias("v")).collect()]


def test_colours(spark):
    pairs = [("5YR 6/4", "7.5YR 6/4"), ("10R 5/6 red", "2.5 YR 4/2"), ("very dark gray", "black"), ("pink", "light red"), ("pinkish gray", "pink"), ("reddish brown", "Reddish Brown 5YR4/4"), ("odd 12", "odd 13"), ("", "red"), (None, None)]
    got = values(spark, S.colour_similarity(F.col("a"), F.col("b")), pairs, "a string, b string")
    soft = lambda d, s: 1 / (1 + (d / s) ** 2)
    assert got[0] == pytest.approx(0.4 * soft(0.25 / 0.25, 2) + 0.25 + 0.35)
    assert got[1] == pytest.approx(0.4 * soft(0.25 / 0.25, 2) + 0.25 * soft(1, 1.5) + 0.35 * soft(4, 2.5))
    assert got[2] == pytest.approx(0.68 + 0.22 * 1.0 + 0.10)  # a lightness of 0 counts as 2
    assert got[3] == pytest.approx(0.68 * 0.82 + 0.22 * 0.82 + 0.10)
    assert got[4] == pytest.approx(0.68 * 0.48 + 0.22 + 0.10 * 0.78)
    assert got[5] >= 0.96 and got[6] == pytest.approx(0.35 + 0.5 / 3) and got[7] == got[8] == 0.35
    chips = values(spark, S.munsell_labels(S.munsell(F.col("a"))), [("2.5YR 4/6",), ("10YR 7/2",), ("none",)], "a string")
    assert [tuple(c) if c else None for c in chips] == [("2.5YR", "dark", "strong"), ("10YR/Y", "light", "muted"), None]


def test_empty_sides_say_nothing(spark):
    empty, some = F.array().cast("array<string>"), F.array(F.lit("FS"), F.lit("3"))
    got = spark.range(1).select(
        S.categorical_similarity(empty, some).alias("a"), S.void_similarity(empty, some).alias("b"), S.diameter_similarity(F.lit(0.0), F.lit(5.0), F.lit(1.5), F.lit(1.5)).alias("c"),
        S.void_similarity(some, F.array(F.lit("FC"), F.lit("3"))).alias("d"), S.ordinal_similarity(S.ranks(empty, "size"), S.ranks(some, "size")).alias("e"),
    ).first()
    assert tuple(got) == (0.5, 0.5, 0.5, pytest.approx(0.35), 0.5)


def test_comparison_against_plain_sums(spark):
    schema = f"q map<string,{M.OBSERVATION}>, r map<string,{M.OBSERVATION}>"
    o = lambda v, rel=None, unc=None, source=None, reviewed=False: (v, rel, unc, source, reviewed)
    q = {"vessel_type": o("A, B"), "rim_diameter_cm": o("20", reviewed=True), "fabric_exterior": o("5YR 6/4"), "fabric_core": o("red", 0.8), "nonplastics_size": o("2"), "decor": o("n/a")}
    r = {"vessel_type": o("B"), "rim_diameter_cm": o("31,5", unc=4.0), "fabric_exterior": o("7.5YR 6/4", source="ocr"), "fabric_core": o("pink"), "nonplastics_size": o("5 x"), "decor": o("incised")}
    rows = [(q, r), (q, {}), (None, r)]
    df = spark.createDataFrame(rows, schema).withColumn("f", M.compare(F.col("q"), F.col("r")))
    got = df.select("f", *[c.alias(n) for n, c in M.summary(F.col("f")).items()]).collect()
    soft = lambda d, s: 1 / (1 + (d / s) ** 2)
    fields = [
        ("classification", 1.20, 0.12 + 0.88 / 2, 0.65, 0.65), ("measurement", 1.65, 1 / (1 + (11.5 / max(6, 0.3 * 25.75, 2.5 * math.hypot(1.5, 4.0))) ** 4), 0.90, 0.65),
        ("colour", 0.65, 0.4 * soft(1, 2) + 0.6, 0.65, 0.55), ("colour", 0.80, 0.68 * 0.82 + 0.22 + 0.10, 0.8, 0.65), ("inclusions", 0.65, soft(3, 1.25), 0.65, 0.65),
    ]
    groups = {}
    for g, w, c, a, b in fields:
        s = w * math.sqrt(a * b)
        e = math.copysign(abs(2 * c - 1) ** 1.35, 2 * c - 1) * s * 2
        groups.setdefault(g, []).append((max(-2.8, min(2.8, e)), 1 - c, s))
    top = {g: max(s for _, _, s in v) for g, v in groups.items()}
    assert got[0].evidence == pytest.approx(sum(4 * math.tanh(sum(e for e, _, _ in v) / 4) for v in groups.values()), abs=1e-6)
    assert got[0].metadata_cost == pytest.approx(sum(sum(c * s for _, c, s in v) / sum(s for _, _, s in v) * top[g] for g, v in groups.items()) / sum(top.values()), abs=1e-6)
    assert got[0].compared_fields == 5 and got[0].coverage == pytest.approx(sum(s for v in groups.values() for _, _, s in v) / M.ALL_WEIGHTS, abs=1e-6)
    assert [(g.evidence, g.compared_fields, g.metadata_cost) for g in got[1:]] == [(0.0, 0, None)] * 2


def test_names_in_sequence(spark):
    bases = ["a", "a", "a-2", "A", "b", "b", "a-2-2", "c-2", "c", "c", "c-2"]
    got = [r.name for r in L.unique_names(spark.createDataFrame(list(enumerate(bases)), "i long, base string"), "base", ["i"]).orderBy("i").collect()]
    seen, expected = set(), []
    for b in bases:
        name, k = b, 2
        while name.lower() in seen:
            name, k = f"{b}-{k}", k + 1
        seen.add(name.lower())
        expected.append(name)
    assert got == expected and len({n.lower() for n in got}) == len(got)


def test_split_takes_from_the_largest_part(spark):
    from kilnwork.functions import text as X

    keys = [(f"k{i}",) for i in range(60)]
    part = dict(zip([k for k, in keys], values(spark, X.split_of(F.col("k")), keys, "k string"), strict=True))
    train = sorted(k for k, p in part.items() if p == "train")[:12]
    got = {r.k: r.part for r in L.split_with_donors(spark.createDataFrame([(k,) for k in train], "k string"), "k").collect()}
    assert got == {k: "train" for k in train} | {train[-1]: "validation", train[-2]: "test"}
    assert {r.part for r in L.split_with_donors(spark.createDataFrame([(k,) for k in train[:9]], "k string"), "k").collect()} == {"train"}


def test_headings():
    assert K.header_score("", ("no",)) == 0 and K.header_score("No.", ("no",)) == 1 and K.header_score("Fabric", ("fabric color",)) == 0.84 and K.header_score("N", ("no",)) == 0.70
    assert K.header_score("Pail", ("xx", "pale")) == pytest.approx(0.75)
    assert K.split_heading("No Type", 0.0, 60.0, {"no", "type"}) == [("No", 0.0, 20.0), ("Type", 20.0, 60.0)]
    assert K.split_heading("No 12", 0.0, 60.0, {"no", "type"}) == [("No 12", 0.0, 60.0)]
    assert K.merged_rules([(100, 0, 1000, 2), (102, 10, 1100, 3), (300, 0, 200, 1), (500, 0, 900, 1)], 1000) == [(101, 0, 1100, 3), (500, 0, 900, 1)]


def test_measurements(spark):
    p, q = F.struct(F.lit(0.0).alias("x"), F.lit(3.0).alias("y")), F.struct(F.lit(4.0).alias("x"), F.lit(6.0).alias("y"))
    got = spark.range(1).select(
        B.pixels_per_cm(p, q, F.lit(1.5), F.lit(10), F.lit(10)).alias("a"), B.pixels_per_cm(p, q, F.lit(1.5), F.lit(3), F.lit(10)).alias("b"),
        B.verified_measurement(F.lit(None).cast("double"), p, q, F.lit(2.0)).alias("c"), B.verified_measurement(F.lit(-1.0), p, q, F.lit(2.0)).alias("d"),
    ).first()
    assert (got.a, got.b, got.c.verified_cm, got.c.status, got.d) == (3.333333, None, 2.5, "verified_manual", None)


def test_expected_header(spark):
    full = "No. Type Sq. Loc. Pail Reg. Fabric Color Exterior Core Interior"
    assert values(spark, C.header_expected(F.col("t")), [(full,), (re.sub("Type", "", full),), ("No Type Sq Loc Exterior Core",), (None,)], "t string") == [True, False, False, False]
