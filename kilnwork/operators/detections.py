"""Detections, crops, scales and zones: identity over runs, containment, choice of a scale."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.functions import boxes as B
from kilnwork.functions import kernels as K

SIDES = ("x1", "y1", "x2", "y2")


def reconcile(found: DataFrame, prior: DataFrame, least: float = 0.5) -> DataFrame:
    """Detections with their identities over runs.

    found: page, ord, x1, y1, x2, y2, confidence. prior: page, vessel_id, x1, y1, x2, y2, status, source. On each page
    a detection, in order, takes the free prior box that it overlaps most; manual and legacy_polygon boxes are never
    taken. It keeps that identity, and moves the reviewed box unless that is approved or deleted. Others get ids after
    the page's highest. Prior boxes that nothing takes stay, stale if a detector made them.

    Greedy matching depends on the order, so a page's boxes are handled together, one page after the other as they come
    from the sort; a task holds one page at a time.
    """
    columns = ["page", "side", "ord", *SIDES, "confidence", "status", "source"]
    none = F.lit(None)
    a = found.select("page", F.lit(1).alias("side"), F.col("ord").cast("long").alias("ord"), *SIDES, "confidence", none.cast("string").alias("status"), none.cast("string").alias("source"))
    b = prior.select("page", F.lit(0).alias("side"), F.col("vessel_id").cast("long").alias("ord"), *SIDES, none.cast("double").alias("confidence"), "status", "source")
    # Spark takes a union of sides dealt out by page as dealt out by page and drops another repartition by page, but then
    # joins small partitions of one side only; by a struct of it, the rows do meet.
    both = a.unionByName(b).repartition(F.struct("page")).sortWithinPartitions("page", "side", "ord", *SIDES).select(*columns)
    names = [c.split()[0] for c in _RECONCILED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _whole_pages(batches):
            rows = [r for page in some for r in _reconciled(page, least)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_RECONCILED_TYPES)], names)

    return both.mapInArrow(run, _RECONCILED)


_RECONCILED = "page string, vessel_id long, x1 double, y1 double, x2 double, y2 double, confidence double, status string, source string, stale boolean, moved boolean"
_RECONCILED_TYPES = [pa.string(), pa.int64(), *[pa.float64()] * 5, pa.string(), pa.string(), pa.bool_(), pa.bool_()]


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[tuple]]]:
    """Lists of pages, each page's rows in order; a page may begin in one batch and end in the next."""
    page: list[tuple] = []
    for batch in batches:
        done = []
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if page and page[0][0] != row[0]:
                done.append(page)
                page = []
            page.append(row)
        if done:
            yield done
    if page:
        yield [page]


def _reconciled(rows: list[tuple], least: float) -> list[tuple]:
    """A page's detections and prior boxes after matching."""
    prior, found = [r for r in rows if r[1] == 0], [r for r in rows if r[1] == 1]
    a, b = (np.array([r[3:7] for r in part], float).reshape(-1, 4) for part in (found, prior))
    taken = K.greedy_boxes(a, b, np.array([r[9] not in ("manual", "legacy_polygon") for r in prior], bool), least)
    top = max([r[2] for r in prior], default=-1)
    out = []
    for r, k in zip(found, taken.tolist(), strict=True):
        if k < 0:
            top += 1
            out.append((r[0], top, *r[3:7], r[7], "pending", "detector", False, True))
        else:
            old = prior[k]
            moved = old[8] not in ("approved", "deleted")
            out.append((r[0], old[2], *(r if moved else old)[3:7], r[7], old[8], old[9], False, moved))
    for k in sorted(set(range(len(prior))) - set(taken.tolist())):
        old = prior[k]
        out.append((old[0], old[2], *old[3:7], None, old[8], old[9], old[9] == "detector", False))
    return out


def without_overlaps(new: DataFrame, existing: DataFrame, page: str, box: str, least: float = 0.95) -> DataFrame:
    """New boxes that overlap no existing one of their page by ``least`` or more."""
    old = existing.select(page, F.col(box).alias("_old"))
    return new.join(old, (new[page] == old[page]) & (B.iou(new[box], F.col("_old")) >= least), "left_anti")


def choose_scale(cards: DataFrame, scales: DataFrame, image: str = "image") -> DataFrame:
    """Cards (image, card, x, y) with the scale of the first zone that holds their centre and has a positive ratio, else
    the first one without a zone that is resolved. scales: image, ord, ratio, zone, status. The join follows the image."""
    s = scales.select(F.col(image), "ord", "ratio", "zone", "status")
    pairs = cards.join(s, image, "left")
    inside = F.col("zone").isNotNull() & B.holds(F.col("zone"), F.col("x"), F.col("y")) & (F.col("ratio") > 0)
    plain = F.col("zone").isNull() & (F.col("status") == "resolved")
    rank = F.when(inside, 0).when(plain, 1)
    best = F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), "ord", "ratio")))
    return pairs.groupBy(*cards.columns).agg(best.alias("_best")).select(*cards.columns, F.col("_best.ord").alias("scale_ord"), F.col("_best.ratio").alias("px_per_cm"))


def tokens_in_cells(tokens: DataFrame, cells: DataFrame, page: str = "page", share: float = 0.8) -> DataFrame:
    """Tokens (page, text, score, x1..y2) whose centre is within a cell (page, row, column, left, right, top, bottom; the
    right and lower edges excluded), and whether ``share`` of their width and height is inside. The join follows the page."""
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    inside = (x >= F.col("left")) & (x < F.col("right")) & (y >= F.col("top")) & (y < F.col("bottom"))
    part = lambda a, b, c, d: (F.least(b, d) - F.greatest(a, c)) / F.greatest(b - a, F.lit(1e-9))
    safe = (part(F.col("x1"), F.col("x2"), F.col("left"), F.col("right")) >= share) & (part(F.col("y1"), F.col("y2"), F.col("top"), F.col("bottom")) >= share)
    return tokens.join(cells, page).where(inside).withColumn("safe", safe)


def best_of(candidates: DataFrame, by: list[str], confidence: str, id_: str, margin: float = 0.08) -> DataFrame:
    """The most confident candidate of each group, ambiguous if the next is within ``margin``."""
    # Only the two best of each group are kept while the groups are summed.
    first = candidates.groupBy(*by).agg(F.max_by(id_, F.struct(confidence, id_)).alias(id_), F.max(F.struct(confidence, id_)).alias("_top"))
    rest = candidates.join(first.select(*by, F.col(id_).alias("_id")), by).where(F.col(id_) != F.col("_id")).groupBy(*by).agg(F.max(confidence).alias("_next"))
    return first.join(rest, by, "left").select(*by, id_, F.col(f"_top.{confidence}").alias(confidence), F.coalesce(F.col(f"_top.{confidence}") - F.col("_next") < margin, F.lit(False)).alias("ambiguous"))
