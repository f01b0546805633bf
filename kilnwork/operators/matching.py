"""Shape search over contours: descriptor variants, two-channel retrieval, and a cascade of exact scoring.

A contour has an id and two walls, arrays of points from the rim on. References and queries are cut to several
coverages; a pair's distance in a channel is the least over variants. The retrieved pairs, at most ``keep`` for each
query, go through three levels of scoring with more and more samples, each level keeping fewer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.functions import kernels as K
from kilnwork.functions import scoring as S
from kilnwork.operators import retrieval as R

#: Shares of the walls that reference variants keep, and those of queries (fixed values).
COVERAGES = (0.50, 0.60, 0.70, 0.80, 0.90, 1.00)
QUERY_COVERAGES = (1.0,)
#: Samples and survivors of each level, and the reserve for each channel's best.
LEVELS = ((24, 40, 2), (48, 12, 1), (96, 5, 0))

OUTLINE, RIBBON = R.Channel("outline", 0, 226), R.Channel("ribbon", 226, 525)
WALLS = "wall_a array<struct<x:double,y:double>>, wall_b array<struct<x:double,y:double>>"


def points(column: pa.Array) -> list[np.ndarray]:
    """Arrays of (x, y) of a column of lists of points."""
    flat = column.flatten()
    xy = np.stack([flat.field("x").to_numpy(zero_copy_only=False), flat.field("y").to_numpy(zero_copy_only=False)], axis=1) if len(flat) else np.zeros((0, 2))
    ends = np.cumsum([0] + [len(v) if v is not None else 0 for v in column.to_pylist()])
    return [xy[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def descriptor(wall_a: np.ndarray, wall_b: np.ndarray, coverage: float) -> np.ndarray:
    """Both channels' descriptors of the walls cut to a coverage."""
    a, b = (K.resample(w, len(w), 0.0, coverage) for w in (wall_a, wall_b))
    return np.concatenate([K.outline_descriptor(np.concatenate([a[::-1], b])), K.ribbon_descriptor(a, b)])


def descriptors(contours: DataFrame, coverages: tuple[float, ...] = COVERAGES) -> DataFrame:
    """(id, variant, vector) of each contour (id, wall_a, wall_b) and coverage; contours with fewer than three points on a wall have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (i, k, descriptor(a, b, c).astype(float).tolist())
                for i, a, b in zip(batch.column(0).to_pylist(), points(batch.column(1)), points(batch.column(2)), strict=True)
                if len(a) >= 3 and len(b) >= 3
                for k, c in enumerate(coverages)
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["id", "variant", "vector"])

    return contours.select(F.col("id").cast("long").alias("id"), "wall_a", "wall_b").mapInArrow(run, "id long, variant int, vector array<double>")


def retrieve(queries: DataFrame, references: DataFrame, keep: int = 400) -> DataFrame:
    """(query_id, ref_id, outline_score, ribbon_score, outline_rank, ribbon_rank, position) from descriptor tables.

    Variants are rows of their own in the scan. A channel's best ``keep`` references are among its best keep * variants
    rows; ranks beyond those count as keep + 1.
    """
    from pyspark.sql import Window as W

    variants = len(COVERAGES)
    coded = references.select((F.col("id") * variants + F.col("variant")).alias("row"), "vector")
    asked = queries.where("variant = 0").select("id", "vector")
    rows = R.top_k(asked, coded, [OUTLINE, RIBBON], keep * variants)
    best = rows.groupBy("query_id", "channel", F.floor(F.col("ref_id") / variants).alias("ref_id")).agg(F.min("score").alias("score"))
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "channel").orderBy("score", "ref_id"))).where(F.col("rank") <= keep)
    side = lambda c: best.where(F.col("channel") == c).select("query_id", "ref_id", F.col("score").alias(f"{c}_score"), F.col("rank").alias(f"{c}_rank"))
    both = side("outline").join(side("ribbon"), ["query_id", "ref_id"], "full").withColumns({c: F.coalesce(c, F.lit(keep + 1)) for c in ("outline_rank", "ribbon_rank")})
    order = [F.least("outline_rank", "ribbon_rank"), F.col("outline_rank") + F.col("ribbon_rank"), F.col("ref_id")]
    return both.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("position") <= keep)


@dataclass
class Match:
    """The terms of a pair at its best coverage; lower is better."""

    fgw: float
    ribbon: float
    salience: float
    tail: float
    rim: float
    transform: float
    completeness: float
    rotation: float
    scale: float


def score_pair(query: tuple[np.ndarray, np.ndarray], reference: tuple[np.ndarray, np.ndarray], samples: int) -> Match | None:
    """The best match over coverages; None if none passes the gates of rotation and scale."""
    best: tuple[float, Match] | None = None
    qa, qb = (K.resample(w, samples) for w in query)
    q = np.concatenate([qa[::-1], qb])
    size = max(np.hypot(*np.ptp(q, axis=0)), 1e-9)
    for coverage in COVERAGES:
        ra, rb = (K.resample(w, samples, 0.0, coverage) for w in reference)
        r = np.concatenate([ra[::-1], rb])
        scale, turn, shift = K.similarity(r, q)
        rotation = float(np.degrees(np.arctan2(turn[0, 1], turn[0, 0])))
        if abs((rotation + 180) % 360 - 180) > 45 or not 0.1 <= scale <= 10:
            continue
        placed = scale * r @ turn + shift
        gap = np.hypot(*(placed - q).T) / size
        x, y = (np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1)) for p in (K.resample(q, 24), K.resample(placed, 24)))
        plain = np.abs(np.linspace(0, 1, 24)[:, None] - np.linspace(0, 1, 24)[None, :])
        top = max(x.max(), y.max(), 1e-9)
        _, cost = K.transport(x / top, y / top, plain, rounds=40 if samples < 96 else 250)
        thick = np.abs(np.hypot(*(qa - qb).T) - scale * np.hypot(*(ra - rb).T)) / size
        n = max(2, samples // 10)
        m = Match(
            fgw=bounded(cost, 0.05), ribbon=bounded(float(np.sqrt((gap * gap).mean())) + float(thick.mean()), 0.10), salience=K.salience(q, placed), tail=bounded(float(np.concatenate([gap[:n], gap[-n:]]).mean()), 0.10),
            rim=bounded(float(gap[samples - n : samples + n].mean()), 0.05), transform=abs(rotation) / 45 * 0.5 + min(1.0, abs(np.log(scale)) / np.log(10)) * 0.5, completeness=(1 - coverage) ** 2, rotation=rotation, scale=scale,
        )
        total = sum(w * getattr(m, t) for t, w in S.SHAPE_WEIGHTS.items())
        if best is None or total < best[0]:
            best = total, m
    return best[1] if best else None


def bounded(v: float, scale: float) -> float:
    return v / (v + scale)


_TERMS = [*S.SHAPE_WEIGHTS, "rotation", "scale"]


def scored(pairs: DataFrame, queries: DataFrame, references: DataFrame, samples: int) -> DataFrame:
    """Pairs (query_id, ref_id, ...) with their terms and overall score; pairs that no coverage matches are gone."""
    q = queries.select(F.col("id").alias("query_id"), F.col("wall_a").alias("qa"), F.col("wall_b").alias("qb"))
    r = references.select(F.col("id").alias("ref_id"), F.col("wall_a").alias("ra"), F.col("wall_b").alias("rb"))
    full = pairs.select("query_id", "ref_id").join(r, "ref_id").join(q, "query_id").select("query_id", "ref_id", "qa", "qb", "ra", "rb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            curves = [points(batch.column(i)) for i in range(2, 6)]
            rows = []
            for k, (i, j) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                m = score_pair((curves[0][k], curves[1][k]), (curves[2][k], curves[3][k]), samples)
                if m is not None:
                    rows.append((i, j, *(getattr(m, t) for t in _TERMS)))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], pa.int64() if c < 2 else pa.float64()) for c in range(2 + len(_TERMS))], ["query_id", "ref_id", *_TERMS])

    terms = full.mapInArrow(run, "query_id long, ref_id long, " + ", ".join(f"{t} double" for t in _TERMS))
    overall = S.weighted_overall({t: F.col(t) for t in S.SHAPE_WEIGHTS})
    return terms.withColumn("score", F.round(overall, 9)).join(pairs.select("query_id", "ref_id", "outline_rank", "ribbon_rank"), ["query_id", "ref_id"])


def match(queries: DataFrame, references: DataFrame, keep: int = 400, levels=LEVELS) -> DataFrame:
    """(query_id, ref_id, score, terms, place) of each query's survivors of the last level."""
    pairs = retrieve(descriptors(queries, QUERY_COVERAGES), descriptors(references), keep)
    for samples, most, reserve in levels:
        pairs = R.cascade(scored(pairs, queries, references, samples), most, reserve, ["query_id"])
    return pairs


def dct_vector(wall_a: np.ndarray, wall_b: np.ndarray, coverage: float, samples: int = 100, harmonics: int = 20) -> np.ndarray:
    """Coefficients of the canonical outline: rim at the origin, axis upwards, unit size; the baseline descriptor."""
    n = samples
    a, b = (K.resample(w, n, 0.0, coverage) for w in (wall_a, wall_b))
    last = max(2, n // 10)
    origin = (a[0] + b[0]) / 2
    axis = (a[-last:].mean(axis=0) + b[-last:].mean(axis=0)) / 2 - origin
    turn = np.pi / 2 - np.arctan2(axis[1], axis[0])
    c, s = np.cos(turn), np.sin(turn)
    p = (np.concatenate([a[::-1], b]) - origin) @ np.array([[c, s], [-s, c]])
    p = p / max(np.sqrt((p * p).sum(axis=1).mean()), 1e-12)
    size = len(p)
    k = np.arange(harmonics)[:, None]
    basis = np.where(k == 0, np.sqrt(1 / size), np.sqrt(2 / size)) * np.cos(np.pi / size * (np.arange(size)[None, :] + 0.5) * k)
    return np.concatenate([basis @ p[:, 0], basis @ p[:, 1]])


def dct_baseline(queries: DataFrame, references: DataFrame, keep: int = 150) -> DataFrame:
    """(query_id, ref_id, rmsd, coverage, rank): references by the least distance of coefficients over eleven coverages."""
    from pyspark.sql import Window as W

    coverages = tuple(np.linspace(0.5, 1.0, 11))

    def bank(contours: DataFrame, cuts: tuple[float, ...]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [
                    (i * 11 + k, dct_vector(a, b, c).tolist())
                    for i, a, b in zip(batch.column(0).to_pylist(), points(batch.column(1)), points(batch.column(2)), strict=True)
                    if len(a) >= 3 and len(b) >= 3
                    for k, c in enumerate(cuts)
                ]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["row", "vector"])

        return contours.select(F.col("id").cast("long").alias("id"), "wall_a", "wall_b").mapInArrow(run, "row long, vector array<double>")

    asked = bank(queries, (1.0,)).select(F.floor(F.col("row") / 11).alias("id"), "vector")
    rows = R.top_k(asked, bank(references, coverages), [R.Channel("dct", 0, 40)], keep * 11)
    named = rows.select("query_id", F.floor(F.col("ref_id") / 11).alias("ref_id"), (F.col("ref_id") % 11).alias("k"), F.sqrt(F.col("score") / 40).alias("rmsd"))
    best = named.groupBy("query_id", "ref_id").agg(F.min(F.struct("rmsd", "k")).alias("b")).select("query_id", "ref_id", "b.rmsd", (0.5 + F.col("b.k") * 0.05).alias("coverage"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rmsd", "ref_id"))).where(F.col("rank") <= keep)
