"""Boxes, points and curves, as Column expressions. A box is struct(x1, y1, x2, y2)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0)) * F.greatest(b["y2"] - b["y1"], F.lit(0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where both are empty."""
    common = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0)) * F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0))
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def normalized(b: Column, width: Column, height: Column) -> Column:
    """Corners in order, rounded half to even, within the page."""
    put = lambda c, most: F.least(F.greatest(F.bround(c.cast("double")).cast("int"), F.lit(0)), most.cast("int"))
    return box(put(F.least(b["x1"], b["x2"]), width), put(F.least(b["y1"], b["y2"]), height), put(F.greatest(b["x1"], b["x2"]), width), put(F.greatest(b["y1"], b["y2"]), height))


def expanded(b: Column, margin: Column, width: Column, height: Column) -> Column:
    return normalized(box(b["x1"] - margin, b["y1"] - margin, b["x2"] + margin, b["y2"] + margin), width, height)


def rescaled(b: Column, fx: Column, fy: Column, width: Column, height: Column) -> Column:
    return normalized(box(b["x1"] * fx, b["y1"] * fy, b["x2"] * fx, b["y2"] * fy), width, height)


def padded(b: Column, width: Column, height: Column, share: float = 0.28, least: int = 12) -> Column:
    margin = F.greatest(F.lit(float(least)), share * F.greatest(b["x2"] - b["x1"], b["y2"] - b["y1"]))
    return expanded(b, margin, width, height)


def holds(b: Column, x: Column, y: Column) -> Column:
    """Whether a box, its corners in any order, has the point within or on its edge."""
    return x.between(F.least(b["x1"], b["x2"]), F.greatest(b["x1"], b["x2"])) & y.between(F.least(b["y1"], b["y2"]), F.greatest(b["y1"], b["y2"]))


def pixels_per_cm(p: Column, q: Column, cm: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """The scale of two points at a known distance, to six places; null for less than 5 pixels, no length, or points beyond the page."""
    d = F.hypot(p["x"] - q["x"], p["y"] - q["y"])
    inside = F.lit(True)
    if width is not None and height is not None:
        for c in (p, q):
            inside = inside & c["x"].between(0, width) & c["y"].between(0, height)
    return F.when((d >= 5) & (cm > 0) & inside, F.round(d / cm, 6))


def verified_measurement(value: Column, p: Column, q: Column, px_per_cm: Column) -> Column:
    """struct(verified_cm, status, method) of a reviewer's value, else of two end points and a scale; null unless positive and finite."""
    found = F.coalesce(value, F.when(px_per_cm > 0, F.hypot(p["x"] - q["x"], p["y"] - q["y"]) / px_per_cm))
    good = (found > 0) & (found < float("inf")) & ~F.isnan(found)
    return F.when(good, F.struct(found.alias("verified_cm"), F.lit("verified_manual").alias("status"), F.lit("manual").alias("method")))


def diameter_decision(a: Column, b: Column) -> Column:
    """struct(status, value, agreement) of two measurements: verified within 5 percent, accepted within 15."""
    gap = F.abs(a - b) / F.greatest(a, b)
    status = F.when(gap <= 0.05, "verified_automatic").when(gap <= 0.15, "accepted").otherwise("needs_review")
    return F.struct(F.coalesce(status, F.lit("unmeasured")).alias("status"), F.when(gap <= 0.15, (a + b) / 2).alias("value"), gap.alias("agreement"))


def mirrored(points: Column, width: Column) -> Column:
    return F.transform(points, lambda p: F.struct((width - 1 - p["x"]).alias("x"), p["y"].alias("y")))


def restored(points: Column, scale: Column, centre: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] * scale + centre["x"]).alias("x"), (p["y"] * scale + centre["y"]).alias("y")))


def dct(signal: Column, n: int, harmonics: int) -> Column:
    """The first coefficients of the orthonormal DCT-II of an array of n numbers."""
    out = []
    for k in range(harmonics):
        basis = F.lit([math.cos(math.pi / n * (i + 0.5) * k) for i in range(n)]).cast("array<double>")
        total = F.aggregate(F.zip_with(F.transform(signal, lambda x: x.cast("double")), basis, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        out.append(math.sqrt((1 if k == 0 else 2) / n) * total)
    return F.array(*out)


def inverse_dct(coefficients: Column, n: int, harmonics: int) -> Column:
    """The signal of n numbers that the kept coefficients give."""
    out = []
    for i in range(n):
        basis = F.lit([math.sqrt((1 if k == 0 else 2) / n) * math.cos(math.pi / n * (i + 0.5) * k) for k in range(harmonics)]).cast("array<double>")
        out.append(F.aggregate(F.zip_with(coefficients, basis, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))
    return F.array(*out)


def rms_distance(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(total / F.size(a))


def valid_edges(edges: Column, n: int = 23, least_gap: float = 0.0015) -> Column:
    """Whether an array has n edges within 0 and 1, each at least least_gap beyond the one before."""
    gaps = F.zip_with(F.slice(edges, 1, n - 1), F.slice(edges, 2, n - 1), lambda a, b: b - a)
    return (F.size(edges) == n) & F.forall(edges, lambda e: e.between(0, 1)) & F.forall(gaps, lambda g: g >= least_gap)
