"""From recognised tokens to table rows: columns, anchors, bounds, arbitration of readings, pages of a figure."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilnwork.functions import kernels as K


def _in_lines(rows: DataFrame, centre: Column, height: Column, order: list[str], least: float, share: float, most: float) -> DataFrame:
    """Rows of pages (page) with the number of their line, ``_line``: one after the other by centre, a new line where a
    centre is beyond the running mean of the line by ``share`` of the page's median height, within least and most.

    A line's mean depends on its rows' order, so a page is one array: at most its few tokens.
    """
    kept = [c for c in rows.columns if c != "page"]
    held = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(centre.alias("_c"), *order, *[c for c in kept if c not in order]))).alias("_rows"), F.percentile(height, 0.5).alias("_height"))
    gap = F.least(F.greatest(F.lit(least), share * F.col("_height")), F.lit(most))

    def step(at: Column, x: Column) -> Column:
        new = (at["n"] == 0) | (F.abs(x["_c"] - at["total"] / F.greatest(at["n"], F.lit(1))) > at["gap"])
        line = at["line"] + new.cast("int")
        return F.struct(
            line.alias("line"), F.when(new, x["_c"]).otherwise(at["total"] + x["_c"]).alias("total"), F.when(new, 1).otherwise(at["n"] + 1).alias("n"), at["gap"].alias("gap"), F.concat(at["lines"], F.array(line)).alias("lines"),
        )

    start = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("total"), F.lit(0).alias("n"), gap.cast("double").alias("gap"), F.array().cast("array<int>").alias("lines"))
    lines = held.withColumn("_lines", F.aggregate("_rows", start, step, lambda at: at["lines"]))
    return lines.select("page", F.explode(F.arrays_zip("_rows", "_lines")).alias("z")).select("page", *[F.col(f"z._rows.{c}").alias(c) for c in kept], F.col("z._lines").alias("_line"))


def text_lines(tokens: DataFrame) -> DataFrame:
    """Tokens (page, text, score, x1, y1, x2, y2) with the number of their line from the top."""
    rows = tokens.select("page", "text", "score", "x1", "y1", "x2", "y2")
    middle = ((F.col("y1") + F.col("y2")) / 2).cast("double")
    return _in_lines(rows, middle, F.col("y2") - F.col("y1"), ["y1", "x1", "text"], 5.0, 0.65, float("inf")).withColumnRenamed("_line", "line")


#: Room before a heading: its height's share, at least and at most so many pixels; and the least score of a heading (fixed values).
LEAD_SHARE, LEAST_LEAD, MOST_LEAD, LEAST_HEADING = 0.20, 3.0, 18.0, 0.68


def column_bounds(header: DataFrame, headings: list[tuple[str, int, tuple[str, ...]]], rule: str = "rule_y", width: str = "width") -> DataFrame:
    """(page, column, left, right) from header tokens (page, text, score, x1, y1, x2, y2, and the page's upper rule and
    width).

    headings: name, tier (0 above the rule, 1 below it) and spellings, in order. Tokens of several headings are split.
    Within a tier each heading takes the first token beyond the one before that is near enough to it, of those at one
    place the best. Columns begin a little before their headings. A page without all headings gives no rows.
    """
    known = {"".join(c for c in a.lower() if c.isalnum()) for _, _, spellings in headings for a in spellings}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame([], columns=["page", "column", "left", "right"])
        pdf = pdf[pdf.text.fillna("") != ""].sort_values(["y1", "x1", "text"])
        tokens = [(t, float(r.score), a, float(r.y1), b, float(r.y2)) for r in pdf.itertuples() for t, a, b in K.split_heading(r.text, float(r.x1), float(r.x2), known)]
        if not tokens:
            return none
        height = lambda t: max(1.0, t[5] - t[3])
        middle = lambda t: ((t[2] + t[4]) / 2, (t[3] + t[5]) / 2)
        line, gap = float(pdf[rule].iloc[0]), max(5.0, float(np.median([height(t) for t in tokens])) * 0.45)
        tiers = [[t for t in tokens if middle(t)[1] <= line + gap], sorted((t for t in tokens if middle(t)[1] > line - gap), key=lambda t: middle(t)[0])]
        found: dict[int, tuple] = {}
        for tier, some in enumerate(tiers):
            cursor, used = -1.0, set()
            for k, (_, own, spellings) in enumerate(headings):
                if own != tier:
                    continue
                scores = [(middle(t)[0], -K.header_score(t[0], spellings) * t[1], i) for i, t in enumerate(some) if i not in used and middle(t)[0] > cursor and K.header_score(t[0], spellings) >= LEAST_HEADING]
                if scores:
                    cursor, _, i = min(scores)
                    used.add(i)
                    found[k] = some[i]
        if len(found) < len(headings):
            return none
        ordered = [found[k] for k in range(len(headings))]
        most = float(pdf[width].iloc[0])
        lead = max(LEAST_LEAD, min(MOST_LEAD, float(np.median([height(t) for t in ordered])) * LEAD_SHARE))
        edges = [max(0.0, t[2] - lead) for t in ordered] + [most]
        least = max(3.0, most * 0.0015)
        if any(b - a < least for a, b in zip(edges, edges[1:], strict=False)) or ordered[-1][4] > most + least:
            return none
        edges = [float(round(e)) for e in edges]
        return pd.DataFrame({"page": pdf.page.iloc[0], "column": [n for n, _, _ in headings], "left": edges[:-1], "right": edges[1:]})

    return header.groupBy("page").applyInPandas(run, "page string, column string, left double, right double")


def even_bounds(centres: list[float], low: float, high: float, width: Column) -> Column:
    """array of struct(left, right): columns by the usual places of their centres, half way between neighbours, scaled to the width."""
    at = [(c - low) / (high - low) for c in centres]
    cuts = [0.0] + [(a + b) / 2 for a, b in zip(at, at[1:], strict=False)] + [1.0]
    put = lambda e: F.least(F.greatest(F.bround(e * width).cast("int"), F.lit(0)), width.cast("int"))
    return F.array(*[F.struct(put(a).alias("left"), put(b).alias("right")) for a, b in zip(cuts, cuts[1:], strict=False)])


def row_anchors(candidates: DataFrame) -> DataFrame:
    """(page, y, text, conflict): candidates (page, y, height, text, expected, page_pass, exact, score) of one physical row
    have one winner: the expected, then whole-page, then exact, then best scored, then longest one, then the upper and
    smaller; conflict says whether texts differ."""
    held = candidates.select("page", "y", "height", "text", "expected", "page_pass", "exact", "score")
    rows = _in_lines(held, F.col("y").cast("double"), F.col("height"), ["y", "text"], 8.0, 0.72, 24.0)
    rank = F.struct(*[(~F.col(c)).cast("int").alias(c) for c in ("expected", "page_pass", "exact")], -F.col("score"), -F.length("text"), "y", "text")
    best = rows.groupBy("page", "_line").agg(F.min_by(F.struct("y", "text"), rank).alias("b"), (F.count_distinct("text") > 1).alias("conflict"))
    return best.select("page", "b.y", "b.text", "conflict")


def recover_anchors(anchors: DataFrame, share: float = 0.35) -> DataFrame:
    """Anchors (page, y, number) with missing numbers put between neighbours whose distance is that many usual gaps, within ``share`` of one."""
    w = W.partitionBy("page").orderBy("y")
    step, gap = F.lead("number").over(w) - F.col("number"), F.lead("y").over(w) - F.col("y")
    gaps = anchors.withColumns({"step": step, "gap": gap})
    usual = gaps.where("step = 1").groupBy("page").agg(F.percentile("gap", 0.5).alias("usual"))
    fits = (F.col("step") > 1) & (F.abs(F.col("gap") / F.col("step") - F.col("usual")) <= share * F.col("usual"))
    made = gaps.join(usual, "page").where(fits).select("page", "y", "number", "step", "gap", F.explode(F.sequence(F.lit(1).cast("long"), F.col("step").cast("long") - 1)).alias("k"))
    made = made.select("page", (F.col("y") + F.col("gap") * F.col("k") / F.col("step")).alias("y"), (F.col("number") + F.col("k")).alias("number"), F.lit(True).alias("recovered"))
    return anchors.select("page", "y", F.col("number").cast("long").alias("number"), F.lit(False).alias("recovered")).unionByName(made)


def row_bounds(anchors: DataFrame, bottom: float = 300.0) -> DataFrame:
    """Anchors (page, y) with the top and bottom of their rows: up to the next anchor, the last one by at most the greatest
    of ``bottom`` and one and a half times the median or longest row."""
    w = W.partitionBy("page").orderBy("y")
    rows = anchors.withColumn("height", F.lead("y").over(w) - F.col("y"))
    usual = rows.groupBy("page").agg(F.greatest(F.lit(bottom), 1.5 * F.coalesce(F.percentile("height", 0.5), F.lit(0.0)), 1.5 * F.coalesce(F.max("height"), F.lit(0.0))).alias("last"))
    return rows.join(usual, "page").withColumns({"top": F.col("y"), "bottom": F.col("y") + F.coalesce("height", "last")}).drop("height", "last")


def folded(c: Column) -> Column:
    """Text for comparison: white space runs as one blank, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def reading(cell: Column, cell_score: Column, page: Column, page_score: Column, safe_page: Column, prefix_removed: Column, anchor: Column, column: Column, anchor_column: str = "table_no") -> Column:
    """struct(text, source, warning) of two readings of a cell, the focused one and that of the whole page.

    The page's reading may count where its tokens lie within the cell: it equals the reading of those tokens alone
    (``safe_page``), or the row's number was taken off it. The row's anchor owns its own column.
    """
    cell, page = F.coalesce(cell, F.lit("")), F.coalesce(page, F.lit(""))
    reliable = (folded(page) == folded(safe_page)) | F.coalesce(prefix_removed, F.lit(False))
    agree = (cell != "") & (page != "") & (folded(cell) == folded(page))
    strong, sure = (page != "") & (page_score > 0.75), (cell != "") & (cell_score >= 0.90)
    pick = lambda text, source, warning=None: F.struct(text.alias("text"), F.lit(source).alias("source"), F.lit(warning).cast("string").alias("warning"))
    own = pick(cell, "cell_pass")
    return (
        F.when(column == anchor_column, pick(anchor, "row_anchor"))
        .when(agree, own)
        .when((cell == "") & strong & reliable, pick(page, "page_pass_blank_cell"))
        .when(strong & reliable & ~sure, pick(page, "page_pass"))
        .when((cell == "") & (page != "") & (page_score >= 0.5) & reliable, pick(page, "page_pass_fallback"))
        .when((cell == "") & (page != "") & ~reliable, pick(F.lit(""), "cross_column_page_withheld", "cross_column_ocr_withheld"))
        .otherwise(own)
    )


def zero_as_letter(column: Column, text: Column, name: str = "fire") -> Column:
    """In one column a read 0 is the letter O."""
    return F.when(column == name, F.replace(text, F.lit("0"), F.lit("O"))).otherwise(text)


def candidate_pages(pages: DataFrame, drawings: DataFrame, reach: int = 2) -> DataFrame:
    """(figure, image_name, logical_index): for each figure and source the pages from its first drawing to ``reach`` after
    its last one, up to the first page beyond that has another figure. pages: source, logical_index, image_name, figure_id.
    drawings: figure, source, logical_index."""
    span = drawings.groupBy("figure", "source").agg(F.min("logical_index").alias("low"), F.max("logical_index").alias("last"))
    near = pages.join(span, "source").where(F.col("logical_index").between(F.col("low"), F.col("last") + reach))
    stop = (F.col("logical_index") > F.col("last")) & (F.coalesce("figure_id", F.lit("")) != "") & (F.col("figure_id") != F.col("figure"))
    first = near.groupBy("figure", "source").agg(F.min(F.when(stop, F.col("logical_index"))).alias("stop"))
    return near.join(first, ["figure", "source"]).where(F.col("stop").isNull() | (F.col("logical_index") < F.col("stop"))).select("figure", "image_name", "logical_index")


def accepted(n_rows: Column, same_figure: Column, has_caption: Column, overlap: Column, needs_columns: Column) -> Column:
    """Whether a table counts: rows with the figure's caption, or without one but in its place; or columns to be set by hand."""
    return ((n_rows > 0) & (same_figure | (~has_caption & overlap))) | needs_columns


def before_closing(pages: DataFrame, by: list[str], order: str, closes: str) -> DataFrame:
    """Pages up to and with the first that closes the table."""
    first = pages.groupBy(*by).agg(F.min(F.when(F.col(closes), F.col(order))).alias("_end"))
    return pages.join(first, by).where(F.col("_end").isNull() | (F.col(order) <= F.col("_end"))).drop("_end")


def nearest_numbers(drawings: DataFrame, numbers: DataFrame, reach: float = 80.0, least: float = 0.15) -> DataFrame:
    """Each drawing (page, drawing, x, y) with the number (page, text, nx, ny, score) of its page that scores best by
    confidence and nearness, null below ``least``; the smallest text of equals."""
    near = F.col("score") * F.exp(-F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny")) / reach)
    pairs = drawings.join(numbers, "page").withColumn("fit", near).where(F.col("fit") >= least)
    best = pairs.groupBy("page", "drawing").agg(F.min_by(F.struct("text", "fit"), F.struct(-F.col("fit"), "text")).alias("b"))
    return drawings.join(best, ["page", "drawing"], "left").select(*drawings.columns, F.col("b.text").alias("number"), F.col("b.fit").alias("fit"))
