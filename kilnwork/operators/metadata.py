"""Metadata of two records compared field by field: evidence, costs and coverage for fusion with a shape score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kilnwork.functions import scoring as S
from kilnwork.functions import text as X

#: Fields with their group, weight and comparison (fixed values).
FIELDS = [
    ("vessel_type", "classification", 1.20, "categorical"),
    ("rim_diameter_cm", "measurement", 1.65, "diameter"),
    ("fabric_exterior", "colour", 0.65, "colour"),
    ("fabric_core", "colour", 0.80, "colour"),
    ("fabric_interior", "colour", 0.65, "colour"),
    ("nonplastics_type", "inclusions", 0.85, "categorical"),
    ("nonplastics_size", "inclusions", 0.65, "size"),
    ("nonplastics_shape", "inclusions", 0.60, "shape"),
    ("nonplastics_density", "inclusions", 0.70, "density"),
    ("voids_type_size", "voids", 0.65, "void"),
    ("voids_density", "voids", 0.55, "density"),
    ("manufacture", "technology", 0.85, "categorical"),
    ("surface_exterior", "surface", 0.75, "categorical"),
    ("surface_exterior_color", "surface", 0.45, "colour"),
    ("surface_interior", "surface", 0.75, "categorical"),
    ("surface_interior_color", "surface", 0.45, "colour"),
    ("decor", "decoration", 0.85, "categorical"),
    ("fire", "technology", 0.65, "categorical"),
]
GROUPS = list(dict.fromkeys(group for _, group, _, _ in FIELDS))
ALL_WEIGHTS = sum(weight for _, _, weight, _ in FIELDS)
#: Uncertainty of a diameter in cm where none is given, of a query and of a reference (fixed values).
SIGMAS = 1.5, 0.75
GROUP_CAP = 4.0
#: What a metadata map has for each field.
OBSERVATION = "struct<value:string,reliability:double,uncertainty:double,source:string,reviewed:boolean>"


def observed(raw: Column, factor: Column | None = None) -> Column:
    """struct(value, reliability, uncertainty) of an observation (OBSERVATION); null for a value that stands for none."""
    known = S.reliability(raw["reliability"], F.coalesce(raw["reviewed"], F.lit(False)), F.coalesce(raw["source"], F.lit("unspecified")), F.lit(1.0) if factor is None else factor)
    return F.when(~X.is_empty_value(raw["value"]), F.struct(raw["value"].alias("value"), known.alias("reliability"), raw["uncertainty"].alias("uncertainty")))


def _diameter(a: Column, b: Column) -> Column:
    sigma = lambda o, usual: F.coalesce(F.nullif(o["uncertainty"], F.lit(0.0)), F.lit(usual))
    return S.diameter_similarity(X.first_number(a["value"]), X.first_number(b["value"]), sigma(a, SIGMAS[0]), sigma(b, SIGMAS[1]))


def _ordinal(kind: str) -> Callable[[Column, Column], Column]:
    return lambda a, b: S.ordinal_similarity(S.ranks(X.token_set(a["value"]), kind), S.ranks(X.token_set(b["value"]), kind))


COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "categorical": lambda a, b: S.categorical_similarity(X.token_set(a["value"]), X.token_set(b["value"])),
    "diameter": _diameter,
    "colour": lambda a, b: S.colour_similarity(a["value"], b["value"]),
    "void": lambda a, b: S.void_similarity(X.token_set(a["value"]), X.token_set(b["value"])),
    **{kind: _ordinal(kind) for kind in S.ORDINALS},
}


def compare(query: Column, reference: Column, factors: dict[str, float] | None = None) -> Column:
    """array of struct(field, grp, weight, compat, reliability, strength, evidence) for each field that both of two
    metadata maps (field to OBSERVATION, by canonical names) have.

    One expression for each kind of comparison; fields are elements of an array, so that no rows are made.
    """
    pairs = F.array(
        *[
            F.struct(
                F.lit(name).alias("field"), F.lit(group).alias("grp"), F.lit(weight).alias("weight"), F.lit(kind).alias("kind"),
                observed(query[name], F.lit((factors or {}).get(name, 1.0))).alias("a"), observed(reference[name], F.lit((factors or {}).get(name, 1.0))).alias("b"),
            )
            for name, group, weight, kind in FIELDS
        ]
    )

    def scored(x: Column) -> Column:
        compat = F.lit(None).cast("double")
        for kind, similarity in COMPARISONS.items():
            compat = F.when(x["kind"] == kind, similarity(x["a"], x["b"])).otherwise(compat)
        return F.struct(*[x[c].alias(c) for c in ("field", "grp", "weight", "a", "b")], compat.alias("compat"))

    def weighed(x: Column) -> Column:
        reliability = F.sqrt(x["a"]["reliability"] * x["b"]["reliability"])
        evidence = S.evidence(x["compat"], x["weight"], x["a"]["reliability"], x["b"]["reliability"])
        return F.struct(*[x[c].alias(c) for c in ("field", "grp", "weight", "compat")], reliability.alias("reliability"), (x["weight"] * reliability).alias("strength"), evidence.alias("evidence"))

    both = F.filter(pairs, lambda x: x["a"].isNotNull() & x["b"].isNotNull())
    return F.transform(F.transform(both, scored), weighed)


def _sum(items: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(F.transform(items, value), F.lit(0.0), lambda s, x: s + x)


def _of(group: str) -> Callable[[Column], Column]:
    return lambda x: x["grp"] == group


def summary(fields: Column) -> dict[str, Column]:
    """Columns of a comparison, to six places: evidence (each group's sum bent to within GROUP_CAP), coverage,
    compared_fields, evidence_strength, metadata_strength and metadata_cost (groups' mean costs, weighted by their
    strongest field; null without one)."""
    evidence, weight, cost = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for group in GROUPS:
        own = F.filter(fields, _of(group))
        strength = _sum(own, lambda x: x["strength"])
        mean = F.when(strength > 0, _sum(own, lambda x: (1 - x["compat"]) * x["strength"]) / strength).otherwise(0.5)
        top = F.coalesce(F.array_max(F.transform(own, lambda x: x["strength"])), F.lit(0.0))
        evidence = evidence + GROUP_CAP * F.tanh(_sum(own, lambda x: x["evidence"]) / GROUP_CAP)
        weight, cost = weight + top, cost + mean * top
    strength = _sum(fields, lambda x: x["strength"])
    return {
        "evidence": F.round(evidence, 6), "coverage": F.round(strength / ALL_WEIGHTS, 6), "compared_fields": F.size(fields).cast("long"),
        "evidence_strength": F.round(strength, 6), "metadata_strength": F.round(weight, 6), "metadata_cost": F.round(F.when(weight > 0, cost / weight), 6),
    }
