"""Similarities, penalties, fused scores and intervals, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kilnwork.functions.text import token_set

#: 97.5 percent point of the normal distribution (fixed value).
Z = 1.959963984540054
#: Weights of the shape terms (fixed values).
SHAPE_WEIGHTS = {"fgw": 0.31, "ribbon": 0.26, "salience": 0.13, "tail": 0.08, "rim": 0.10, "transform": 0.06, "completeness": 0.06}


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def wilson(hits: Column, n: Column) -> Column:
    """struct(low, high): the 95 percent score interval of a proportion; (0, 0) for none."""
    n_, p = n.cast("double"), hits.cast("double") / n.cast("double")
    scale = 1 + Z * Z / n_
    centre = (p + Z * Z / (2 * n_)) / scale
    margin = Z * F.sqrt(p * (1 - p) / n_ + Z * Z / (4 * n_ * n_)) / scale
    some = n > 0
    return F.struct(F.when(some, clip(centre - margin)).otherwise(0.0).alias("low"), F.when(some, clip(centre + margin)).otherwise(0.0).alias("high"))


def intervals_overlap(a: Column, b: Column) -> Column:
    return F.greatest(a["low"], b["low"]) <= F.least(a["high"], b["high"])


def mcnemar(b: Column, c: Column) -> Column:
    """The exact two-sided p of b and c discordant pairs: twice the binomial tail, at most 1; 1 for none."""
    n, m = b + c, F.least(b, c)
    # ln C(n, i) by running sums, so that large n don't overflow.
    term = F.aggregate(
        F.sequence(F.lit(1), F.greatest(m, F.lit(1))),
        F.struct(F.lit(0.0).alias("log"), F.exp(-n * F.log(F.lit(2.0))).alias("sum")),
        lambda acc, i: F.struct((acc["log"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))).alias("log"), F.when(i <= m, acc["sum"] + F.exp(acc["log"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")) - n * F.log(F.lit(2.0)))).otherwise(acc["sum"]).alias("sum")),
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * term["sum"]))


def soft_distance(d: Column, scale: float) -> Column:
    return 1 / (1 + (d / scale) * (d / scale))


def diameter_similarity(a: Column, b: Column, sigma_a: Column, sigma_b: Column) -> Column:
    """1 / (1 + (difference / scale)**4); 0.5 where either is missing or not above zero."""
    scale = F.greatest(F.lit(6.0), 0.3 * (a + b) / 2, 2.5 * F.sqrt(sigma_a * sigma_a + sigma_b * sigma_b))
    ratio = F.abs(a - b) / scale
    return F.coalesce(F.when((a > 0) & (b > 0), 1 / (1 + ratio * ratio * ratio * ratio)), F.lit(0.5))


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def categorical_similarity(a: Column, b: Column) -> Column:
    """Of two sets of codes; 0.5 where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 0.12 + 0.88 * jaccard(a, b)).otherwise(0.5)


def ordinal_similarity(a: Column, b: Column) -> Column:
    """From the least gap between two arrays of ranks; 0.5 where either is empty."""
    gaps = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.abs(x - y).cast("double"))))
    return F.coalesce(soft_distance(F.array_min(gaps), 1.25), F.lit(0.5))


#: Codes in order (fixed values).
ORDINALS = {
    "size": {str(i): i for i in range(1, 8)},
    "density": {"VL": 1, "L": 2, "M": 3, "MH": 4, "H": 5},
    "shape": {"A": 1, "SA": 2, "SR": 3, "R": 4},
}
#: Codes of kinds of voids (fixed values).
VOID_TYPES = ["FS", "FC", "PR", "PA", "JR", "JH", "JB", "JD"]


def ranks(codes: Column, kind: str) -> Column:
    """The ranks of those codes that the kind has."""
    order = F.create_map(*[F.lit(x) for kv in ORDINALS[kind].items() for x in kv])
    return F.filter(F.transform(codes, lambda x: order[x]), lambda x: x.isNotNull())


def void_similarity(a: Column, b: Column) -> Column:
    """Of two sets of codes: kinds of voids (0.5 where either has none) and sizes."""
    kinds = F.array(*map(F.lit, VOID_TYPES))
    x, y = F.array_intersect(a, kinds), F.array_intersect(b, kinds)
    return 0.65 * F.when((F.size(x) > 0) & (F.size(y) > 0), jaccard(x, y)).otherwise(0.5) + 0.35 * ordinal_similarity(ranks(a, "size"), ranks(b, "size"))


#: Hues in order round the circle, and a chip's form (fixed values).
HUES = ["R", "YR", "Y", "GY", "G", "BG", "B", "PB", "P", "RP"]
CHIP = r"(\d+(?:\.\d+)?)\s*(YR|GY|BG|PB|RP|R|Y|G|B|P)\s+(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)"
NAMED_CHIP = r"\b\d+(?:\.\d+)?\s*(?:yr|gy|bg|pb|rp|r|y|g|b|p)\s*\d+(?:\.\d+)?\s*/\s*\d+(?:\.\d+)?\b"
#: How near colour families are; others .20 (fixed values).
NEAR_FAMILIES = {
    ("pink", "red"): 0.82, ("pink", "reddish_brown"): 0.62, ("red", "reddish_brown"): 0.82, ("red", "red_yellow"): 0.82,
    ("reddish_brown", "brown"): 0.86, ("reddish_brown", "red_yellow"): 0.68, ("brown", "yellow"): 0.64, ("red_yellow", "yellow"): 0.82,
}
#: By the gap of lightness (fixed values).
TONES = [1.0, 0.82, 0.58, 0.34, 0.18]
#: Centres of hue labels (fixed values).
HUE_LABELS = [(1.00, "R/10R"), (1.25, "2.5YR"), (1.50, "5YR"), (1.75, "7.5YR"), (2.10, "10YR/Y")]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def munsell(c: Column) -> Column:
    """struct(hue, value, chroma) of a chip such as 5YR 6/4, the hue on a circle of ten families; null without one."""

    def read(t: Column) -> Column:
        part = lambda i: F.regexp_extract(t, CHIP, i)
        place = F.array_position(F.array(*map(F.lit, HUES)), part(2)) - 1
        hue = F.pmod(place.cast("double") + part(1).try_cast("double") / 10, F.lit(10.0))
        return F.when(t.rlike(CHIP), F.struct(hue.alias("hue"), part(3).try_cast("double").alias("value"), part(4).try_cast("double").alias("chroma")))

    return let(F.trim(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"\s+", " ")), read)


def munsell_labels(chip: Column) -> Column:
    """struct(hue, lightness, saturation): words for a chip, the nearest hue's (the first of equals) and bands."""

    def labels(c: Column) -> Column:
        gaps = F.array(*[F.struct(F.abs(c["hue"] - centre).alias("gap"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (centre, name) in enumerate(HUE_LABELS)])
        light = F.when(c["value"] < 5, "dark").when(c["value"] < 6.5, "middle").when(c["value"] < 7.5, "light").otherwise("very light")
        vivid = F.when(c["chroma"] <= 2, "muted").when(c["chroma"] <= 4, "moderate").otherwise("strong")
        return F.when(c.isNotNull(), F.struct(F.array_min(gaps)["name"].alias("hue"), light.alias("lightness"), vivid.alias("saturation")))

    return let(chip, labels)


def colour_words(c: Column) -> Column:
    """A colour's name without its chip: lower-case words."""
    t = F.regexp_replace(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("grey"), F.lit("gray")), NAMED_CHIP, " ")
    return F.trim(F.regexp_replace(t, r"[^a-z]+", " "))


def _named(t: Column) -> Column:
    has = lambda *words: t.rlike("|".join(words))
    family = (
        F.when(has("white", "gray", "black"), "neutral").when(has("reddish brown", "red brown"), "reddish_brown").when(has("brown"), "brown").when(has("pink"), "pink")
        .when(has("red") & has("yellow"), "red_yellow").when(has("red"), "red").when(has("yellow", "buff"), "yellow")
    )
    light = F.when(has("very dark", "black"), 0).when(has("dark"), 1).when(has("white", "very pale"), 4).when(has("light", "pale"), 3).otherwise(2)
    vivid = F.when(has("gray", "white", "black"), "neutral").when(has("weak", "pale"), "weak").otherwise("normal")
    tint = F.when(has("pink"), "pink").when(has("red"), "red").when(has("brown"), "brown").when(has("yellow"), "yellow")
    known = has("white", "gray", "black", "brown", "pink", "red", "yellow", "buff")
    return F.when(known, F.struct(family.alias("family"), light.alias("lightness"), vivid.alias("saturation"), tint.alias("tint")))


def colour_name(c: Column) -> Column:
    """struct(family, lightness 0 to 4, saturation, tint) of a colour's name; null where it names no family."""
    return let(colour_words(c), _named)


def _named_similarity(p: Column, q: Column) -> Column:
    near = F.lit(0.20)
    for (f, g), v in NEAR_FAMILIES.items():
        near = F.when(((p["family"] == f) & (q["family"] == g)) | ((p["family"] == g) & (q["family"] == f)), v).otherwise(near)
    tinted = F.when(p["family"] == "neutral", p["tint"].eqNullSafe(q["family"])).otherwise(q["tint"].eqNullSafe(p["family"]))
    neutral = (p["family"] == "neutral") | (q["family"] == "neutral")
    family = F.when(p["family"] == q["family"], 1.0).when(neutral, F.when(tinted, 0.48).otherwise(0.22)).otherwise(near)
    # A lightness of 0 counts as the middle one.
    light = lambda z: F.when(z["lightness"] == 0, 2).otherwise(z["lightness"])
    tone = F.element_at(F.array(*map(F.lit, TONES)), F.least(F.abs(light(p) - light(q)), F.lit(4)) + 1)
    vivid = F.when(p["saturation"] == q["saturation"], 1.0).when((p["saturation"] == "normal") | (q["saturation"] == "normal"), 0.78).otherwise(0.55)
    return 0.68 * family + 0.22 * tone + 0.10 * vivid


def colour_similarity(a: Column, b: Column) -> Column:
    """By Munsell chips if both have one (hue .40 on the circle in quarter steps, value .25, chroma .35), else by names
    (equal ones at least .96), else by common words."""

    def chips(s: Column) -> Column:
        x, y = s["x"], s["y"]
        gap = F.abs(x["hue"] - y["hue"])
        return 0.40 * soft_distance(F.least(gap, 10 - gap) / 0.25, 2.0) + 0.25 * soft_distance(F.abs(x["value"] - y["value"]), 1.5) + 0.35 * soft_distance(F.abs(x["chroma"] - y["chroma"]), 2.5)

    def names(s: Column) -> Column:
        value = let(_named_similarity(s["p"], s["q"]), lambda v: F.when(s["u"] == s["w"], F.greatest(v, F.lit(0.96))).otherwise(v))
        return F.when(s["p"].isNotNull() & s["q"].isNotNull(), value)

    words = F.struct(colour_words(a).alias("u"), colour_words(b).alias("w"))
    named = let(words, lambda s: let(F.struct(_named(s["u"]).alias("p"), _named(s["w"]).alias("q"), s["u"].alias("u"), s["w"].alias("w")), names))
    return F.coalesce(let(F.struct(munsell(a).alias("x"), munsell(b).alias("y")), chips), named, 0.35 + 0.5 * jaccard(token_set(a), token_set(b)))


def evidence(compat: Column, weight: Column, rel_a: Column, rel_b: Column) -> Column:
    """Signed evidence of one field: its compatibility about one half, sharpened, weighted by reliability, within +-2.8."""
    centred = 2 * clip(compat) - 1
    strength = weight * F.sqrt(rel_a * rel_b)
    return clip(F.signum(centred) * F.pow(F.abs(centred), F.lit(1.35)) * strength * 2, -2.8, 2.8)


def reliability(explicit: Column, reviewed: Column, source: Column, factor: Column) -> Column:
    base = F.coalesce(explicit, F.when(reviewed, 0.90).when(source.isin("model", "ocr", "automatic"), 0.55).otherwise(0.65))
    return clip(base * F.coalesce(factor, F.lit(1.0)))


def fuse(shape: Column, cost: Column, strength: Column, diameter_gap: Column, diameter_reliability: Column) -> Column:
    """A shape score (lower is better) moved by metadata: a small bonus for close agreement, a growing penalty for
    disagreement, both by availability, and a quadratic tail for distant diameters. Without comparable fields the
    clipped shape score. Costs and strengths are taken as reported, to six places."""
    available = 1 - F.exp(-strength / 1.5)
    compat = 1 - cost
    raw = (
        F.when(compat >= 0.90, -0.030 * (0.35 + 0.65 * (compat - 0.90) / 0.10))
        .when(compat >= 0.65, -0.030 * 0.35 * (compat - 0.65) / 0.25)
        .otherwise(0.075 * F.pow((0.65 - compat) / 0.65, F.lit(1.35)))
    )
    beyond = F.greatest(F.lit(0.0), F.abs(diameter_gap) - 5)
    tail = F.coalesce(F.least(F.lit(0.06), 0.00011 * beyond * beyond * F.sqrt(diameter_reliability)), F.lit(0.0))
    used = cost.isNotNull() & (0.22 * available > 0)
    return F.round(clip(clip(shape) + F.when(used, raw * available + tail).otherwise(0.0)), 8)


def rank_score(rank_a: Column, rank_b: Column, n: Column) -> Column:
    """A pair of ranks as a score in 0 to 1."""
    return 0.75 * F.least(rank_a, rank_b) / n + 0.25 * (rank_a + rank_b) / (2 * n)


def bounded_score(v: Column, scale: float) -> Column:
    """v / (v + scale); values below zero count as zero."""
    v = F.greatest(v, F.lit(0.0))
    return v / (v + max(scale, 1e-12))


def completeness_penalty(share: Column) -> Column:
    return (1 - clip(share)) * (1 - clip(share))


def weighted_overall(terms: dict[str, Column]) -> Column:
    return sum((F.lit(w) * terms[t] for t, w in SHAPE_WEIGHTS.items()), F.lit(0.0))


def instability(rotations: Column, scales: Column, seams: Column) -> Column:
    """How far hypotheses differ, 0 for a single one: the mean of bounded population deviations of rotation (10 degrees),
    log scale (.15) and seam (.05)."""

    def deviation(a: Column) -> Column:
        mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
        return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(a))

    logs = F.transform(scales, lambda x: F.log(F.greatest(x, F.lit(1e-12))))
    mean = (bounded_score(deviation(rotations), 10.0) + bounded_score(deviation(logs), 0.15) + bounded_score(deviation(seams), 0.05)) / 3
    return F.when(F.size(rotations) > 1, mean).otherwise(0.0)


def hypothesis_reliability(scale_gap: Column, not_converged: Column, start: Column, unstable: Column) -> Column:
    """The penalty of an unreliable transform: .60 disagreement of scales, .15 no convergence, .10 start, .15 instability."""
    return 0.60 * scale_gap + 0.15 * not_converged + 0.10 * start + 0.15 * unstable


def warning_flags(tests: dict[str, Column]) -> Column:
    """Codes of the tests that hold, sorted, each once."""
    return F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(t, F.lit(code)) for code, t in tests.items()]), lambda x: x.isNotNull())))


def aligned(rotation: Column) -> Column:
    return F.abs(F.pmod(rotation + 180, F.lit(360.0)) - 180) <= 45


def scale_allowed(scale: Column) -> Column:
    return scale.between(0.1, 10)
