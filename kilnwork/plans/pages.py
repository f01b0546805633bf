"""Page, table, detection and library queries over the generated tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.functions import boxes as B
from kilnwork.functions import kernels as K
from kilnwork.functions import scoring as S
from kilnwork.functions import text as X
from kilnwork.operators import detections as D
from kilnwork.operators import linking as L
from kilnwork.operators import tables as T
from kilnwork.sources.tables import table


def zone_assignment(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    cards = e.select(F.col("user_id").alias("image"), F.col("event_id").alias("card"), (F.col("event_id") % 100).cast("double").alias("x"), (F.col("event_id") % 37).cast("double").alias("y"))
    users = e.select(F.col("user_id").alias("image")).distinct()
    zone = lambda a, b, c, g: B.box(F.lit(a), F.lit(b), F.lit(c), F.lit(g))
    none = F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>")
    scales = users.select("image", F.explode(F.array(
        F.struct(F.lit(0).alias("ord"), F.lit(9.5).alias("ratio"), none.alias("zone"), F.lit("resolved").alias("status")),
        F.struct(F.lit(1).alias("ord"), F.lit(2.5).alias("ratio"), zone(40.0, 20.0, 0.0, 0.0).alias("zone"), F.lit("resolved").alias("status")),
        F.struct(F.lit(2).alias("ord"), F.when(F.col("image") % 2 == 0, 3.5).alias("ratio"), zone(30.0, 10.0, 90.0, 30.0).alias("zone"), F.lit("resolved").alias("status")),
    )).alias("s")).select("image", "s.*")
    return D.choose_scale(cards, scales)


ZONE_ASSIGNMENT = """
WITH c AS (SELECT user_id AS image, event_id AS card, (event_id % 100)::DOUBLE AS x, (event_id % 37)::DOUBLE AS y FROM events)
SELECT image, card, x, y, CASE WHEN x <= 40 AND y <= 20 THEN 1 WHEN image % 2 = 0 AND x BETWEEN 30 AND 90 AND y BETWEEN 10 AND 30 THEN 2 ELSE 0 END AS scale_ord,
 CASE WHEN x <= 40 AND y <= 20 THEN 2.5::DOUBLE WHEN image % 2 = 0 AND x BETWEEN 30 AND 90 AND y BETWEEN 10 AND 30 THEN 3.5::DOUBLE ELSE 9.5::DOUBLE END AS px_per_cm FROM c
"""


def row_bounds(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page"), (F.col("l_partkey") % 997).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return T.row_bounds(a.select("page", "y")).select("page", "y", "top", F.round("bottom", 6).alias("bottom"))


ROW_BOUNDS = """
WITH a AS (SELECT DISTINCT l_orderkey AS page, (l_partkey % 997)::DOUBLE AS y FROM lineitem), b AS (SELECT *, lead(y) OVER (PARTITION BY page ORDER BY y) - y AS h FROM a),
u AS (SELECT page, greatest(300.0, 1.5 * coalesce(quantile_cont(h, 0.5), 0), 1.5 * coalesce(max(h), 0)) AS last FROM b GROUP BY page)
SELECT b.page, y, y AS top, round(y + coalesce(h, last), 6) AS bottom FROM b JOIN u ON b.page = u.page
"""


def recover_anchors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("page"), (F.floor(F.col("event_id") / 50)).cast("int").alias("number")).agg(F.min("event_id").alias("n"))
    a = e.select("page", (F.col("number") * 20 + F.col("n") % 5).cast("double").alias("y"), "number")
    out = T.recover_anchors(a)
    return out.select("page", F.round("y", 6).alias("y"), "number", "recovered")


RECOVER_ANCHORS = """
WITH e AS (SELECT user_id AS page, event_id // 50 AS number, min(event_id) AS n FROM events GROUP BY ALL), a AS (SELECT page, number, (number * 20 + n % 5)::DOUBLE AS y FROM e),
g AS (SELECT *, lead(number) OVER w - number AS step, lead(y) OVER w - y AS gap FROM a WINDOW w AS (PARTITION BY page ORDER BY y)),
u AS (SELECT page, quantile_cont(gap, 0.5) AS usual FROM g WHERE step = 1 GROUP BY page)
SELECT page, round(y, 6) AS y, number, false AS recovered FROM a
UNION ALL SELECT page, round(y + gap * k / step, 6), number + k, true FROM (SELECT g.*, usual, unnest(range(1, step)) AS k FROM g JOIN u ON g.page = u.page WHERE step > 1 AND abs(gap / step - usual) <= 0.35 * usual)
"""


def cell_arbitration(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    cell = F.when(F.col("l_partkey") % 4 == 0, "").otherwise(F.concat(F.lit(" "), F.lower("l_returnflag"), F.lit("  x")))
    page = F.when(F.col("l_partkey") % 5 == 0, "").when(F.col("l_partkey") % 3 == 0, F.concat("l_returnflag", F.lit(" X"))).otherwise(F.col("l_linestatus"))
    safe = F.when(F.col("l_suppkey") % 5 != 0, F.lower(page)).otherwise("other")
    column = F.when(F.col("l_linenumber") == 3, "table_no").otherwise("ware")
    r = T.reading(cell, F.col("l_discount") * 10, page, F.col("l_tax") * 12, safe, F.col("l_suppkey") % 7 == 0, F.col("l_linenumber").cast("string"), column)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r.alias("r")).groupBy("r.text", "r.source", "r.warning").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("orders"))


CELL_ARBITRATION = r"""
WITH v AS (SELECT *, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE ' ' || lower(l_returnflag) || '  x' END AS c, l_discount * 10 AS cs, CASE WHEN l_partkey % 5 = 0 THEN '' WHEN l_partkey % 3 = 0 THEN l_returnflag || ' X' ELSE l_linestatus END AS p, l_tax * 12 AS ps FROM lineitem),
w AS (SELECT *, CASE WHEN l_suppkey % 5 <> 0 THEN lower(p) ELSE 'other' END AS safe FROM v),
g AS (SELECT *, lower(trim(regexp_replace(p, '\s+', ' ', 'g'))) AS fp, lower(trim(regexp_replace(c, '\s+', ' ', 'g'))) AS fc, lower(trim(regexp_replace(safe, '\s+', ' ', 'g'))) AS fs FROM w),
k AS (SELECT *, CASE WHEN l_linenumber = 3 THEN 'row_anchor' WHEN c <> '' AND p <> '' AND fc = fp THEN 'cell_pass' WHEN c = '' AND p <> '' AND ps > 0.75 AND (fp = fs OR l_suppkey % 7 = 0) THEN 'page_pass_blank_cell'
  WHEN p <> '' AND ps > 0.75 AND (fp = fs OR l_suppkey % 7 = 0) AND NOT (c <> '' AND cs >= 0.90) THEN 'page_pass' WHEN c = '' AND p <> '' AND ps >= 0.5 AND (fp = fs OR l_suppkey % 7 = 0) THEN 'page_pass_fallback'
  WHEN c = '' AND p <> '' AND NOT (fp = fs OR l_suppkey % 7 = 0) THEN 'cross_column_page_withheld' ELSE 'cell_pass' END AS source FROM g)
SELECT CASE source WHEN 'row_anchor' THEN CAST(l_linenumber AS VARCHAR) WHEN 'cell_pass' THEN c WHEN 'cross_column_page_withheld' THEN '' ELSE p END AS text, source, CASE WHEN source = 'cross_column_page_withheld' THEN 'cross_column_ocr_withheld' END AS warning,
 count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS orders FROM k GROUP BY ALL
"""


def candidate_pages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    pages = c.select(F.col("conv_id").alias("source"), F.col("turn").alias("logical_index"), F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("image_name"), F.when(F.col("turn") % 3 == 2, F.concat(F.lit("f"), F.col("turn").cast("string"))).alias("figure_id")).distinct()
    drawings = c.where("turn <= 1").select(F.lit("f0").alias("figure"), F.col("conv_id").alias("source"), F.col("turn").alias("logical_index"))
    return T.candidate_pages(pages, drawings)


CANDIDATE_PAGES = """
WITH p AS (SELECT DISTINCT conv_id AS source, turn AS i, conv_id || '_' || turn AS image_name FROM conversations), s AS (SELECT conv_id AS source, min(turn) AS low, max(turn) AS last FROM conversations WHERE turn <= 1 GROUP BY conv_id),
n AS (SELECT p.*, last FROM p JOIN s ON p.source = s.source WHERE i BETWEEN low AND last + 2), e AS (SELECT source, min(i) FILTER (i > last AND i % 3 = 2) AS stop FROM n GROUP BY source)
SELECT 'f0' AS figure, image_name, i AS logical_index FROM n JOIN e ON n.source = e.source WHERE stop IS NULL OR i < stop
"""


def scale_candidates(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_retailprice") / 2200).alias("confidence"))
    return D.best_of(p, ["p_brand"], "confidence", "p_partkey").select("p_brand", "p_partkey", F.round("confidence", 6).alias("confidence"), "ambiguous")


SCALE_CANDIDATES = """
WITH p AS (SELECT p_brand, p_partkey, p_retailprice / 2200 AS c, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice / 2200 DESC, p_partkey DESC) AS k FROM part)
SELECT a.p_brand, a.p_partkey, round(a.c, 6) AS confidence, coalesce(a.c - b.c < 0.08, false) AS ambiguous FROM p a LEFT JOIN p b ON a.p_brand = b.p_brand AND b.k = 2 WHERE a.k = 1
"""


def diameter_decisions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("a"), (F.col("o_totalprice") * (1 + (F.col("o_orderkey") % 20) / 80)).alias("b"))
    v = B.diameter_decision(F.col("a"), F.col("b"))
    return o.select("o_orderkey", v.alias("v")).select("o_orderkey", "v.status", F.round("v.value", 8).alias("value"))


DIAMETER_DECISIONS = """
WITH o AS (SELECT o_orderkey, o_totalprice AS a, o_totalprice * (1 + (o_orderkey % 20) / 80) AS b FROM orders), g AS (SELECT *, abs(a - b) / greatest(a, b) AS gap FROM o)
SELECT o_orderkey, CASE WHEN gap <= 0.05 THEN 'verified_automatic' WHEN gap <= 0.15 THEN 'accepted' ELSE 'needs_review' END AS status, CASE WHEN gap <= 0.15 THEN round((a + b) / 2, 8) END AS value FROM g
"""


def library_status(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    q, t = F.col("quality"), F.col("toxic")
    out = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count(q).alias("reviewed"), F.count_if(q.isNull()).alias("pending"), F.count_if(q == 1).alias("usable"), F.count_if((q == 1) & (t == 1)).alias("flagged"))
    return out.withColumns({"ready": F.col("usable") > 0, "complete": F.col("pending") == 0})


LIBRARY_STATUS = """
SELECT lang, count(*) AS n, count(quality) AS reviewed, count(*) FILTER (quality IS NULL) AS pending, count(*) FILTER (quality = 1) AS usable, count(*) FILTER (quality = 1 AND toxic = 1) AS flagged,
 count(*) FILTER (quality = 1) > 0 AS ready, count(*) FILTER (quality IS NULL) = 0 AS complete FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang
"""


def three_way_training(spark: SparkSession, d: str) -> DataFrame:
    crops = table(spark, d, "lineitem").where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber")
    reviews = table(spark, d, "orders").where("o_orderstatus in ('F', 'O')").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    pages = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    joined = crops.join(reviews, "l_orderkey").join(pages, "o_custkey")
    return joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_crops"), F.count_distinct("o_custkey").alias("n_pages"))


THREE_WAY_TRAINING = """
SELECT c_mktsegment, count(*) AS n_crops, count(DISTINCT c_custkey) AS n_pages FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE l_returnflag = 'A' AND o_orderstatus IN ('F', 'O') GROUP BY c_mktsegment
"""


def profile_listing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    reviews = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "approved").otherwise("rejected").alias("status"))
    return docs.join(reviews, "doc_id", "left").select("doc_id", "source", F.coalesce("status", F.lit("not_generated")).alias("review_status"))


PROFILE_LISTING = "SELECT doc_id, source, CASE WHEN quality = 1 THEN 'approved' WHEN quality IS NOT NULL THEN 'rejected' ELSE 'not_generated' END AS review_status FROM documents LEFT JOIN labels USING (doc_id)"


def runtime_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type in ('view', 'click')")
    cents = F.round(F.col("value") * 100).cast("long")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(cents).alias("hundredths"), F.round(F.sum(cents) / 360000, 4).alias("hours"), F.max("ts").alias("last"))


RUNTIME_ROLLUP = "SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS hundredths, round(sum(CAST(round(value * 100) AS BIGINT)) / 360000, 4) AS hours, max(ts) AS last FROM events WHERE event_type IN ('view', 'click') GROUP BY event_type"


def channel_summary(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_shipdate", (F.col("l_partkey") % 60).alias("combined"), (F.col("l_suppkey") % 60).alias("outline"), (F.col("l_orderkey") % 60).alias("ribbon"))
    long = l.unpivot([], ["combined", "outline", "ribbon"], "channel", "rank")
    return long.groupBy("channel").agg(*[F.count_if(F.col("rank") <= k).alias(f"top_{k}") for k in (1, 5, 10)])


CHANNEL_SUMMARY = """
WITH u AS (SELECT 'combined' AS channel, l_partkey % 60 AS r FROM lineitem UNION ALL SELECT 'outline', l_suppkey % 60 FROM lineitem UNION ALL SELECT 'ribbon', l_orderkey % 60 FROM lineitem)
SELECT channel, count(*) FILTER (r <= 1) AS top_1, count(*) FILTER (r <= 5) AS top_5, count(*) FILTER (r <= 10) AS top_10 FROM u GROUP BY channel
"""


def flattened_candidates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.slice(F.array_sort(F.collect_list(F.struct("o_totalprice", "o_orderkey"))), 1, 3).alias("results"), F.slice(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice")), False), 1, 2).alias("forced"))
    a = o.select("o_custkey", F.posexplode("results").alias("place", "r")).select("o_custkey", F.lit("result").alias("kind"), F.col("place").cast("long").alias("place"), "r.o_orderkey")
    b = o.select("o_custkey", F.explode("forced").alias("r")).select("o_custkey", F.lit("forced").alias("kind"), "r.o_orderkey")
    details = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return a.unionByName(b, allowMissingColumns=True).join(details, "o_orderkey", "left")


FLATTENED_CANDIDATES = """
WITH a AS (SELECT o_custkey, 'result' AS kind, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS place, o_orderkey, o_orderpriority FROM orders),
b AS (SELECT o_custkey, 'forced' AS kind, NULL::BIGINT AS place, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders)
SELECT o_custkey, kind, place, o_orderkey, o_orderpriority FROM a WHERE place < 3 UNION ALL SELECT o_custkey, kind, place, o_orderkey, o_orderpriority FROM b WHERE k <= 2
"""


def citation_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", X.normalize_figure(F.concat(F.lit("Fig. "), F.regexp_extract("p_brand", r"(\d+)", 1), F.lit(":"), F.col("p_size").cast("string"))).alias("figure"), X.normalize_number(F.concat(F.lit("No. 0"), F.col("p_size").cast("string"))).alias("item"), F.concat(F.col("p_name"), F.lit(".png")).alias("card"))
    return p.select("p_partkey", X.citation(F.col("figure"), F.col("item"), F.col("card")).alias("citation"), X.card_stem(F.col("card")).alias("stem"), X.is_positive_number(F.col("item")).alias("valid"))


CITATION_LOOKUP = r"""SELECT p_partkey, 'Figure ' || regexp_extract(p_brand, '\d+') || '.' || p_size || ' Item ' || p_size AS citation, p_name AS stem, p_size > 0 AS valid FROM part"""


def warning_flags(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    flags = S.warning_flags({"steep": F.col("l_discount") > 0.08, "large": F.col("l_quantity") >= 45, "taxed": F.col("l_tax") > 0.06, "late": F.col("l_linestatus") == "O"})
    return l.select(F.concat_ws(",", flags).alias("flags")).groupBy("flags").agg(F.count(F.lit(1)).alias("n"))


WARNING_FLAGS = """
SELECT concat_ws(',', CASE WHEN l_quantity >= 45 THEN 'large' END, CASE WHEN l_linestatus = 'O' THEN 'late' END, CASE WHEN l_discount > 0.08 THEN 'steep' END, CASE WHEN l_tax > 0.06 THEN 'taxed' END) AS flags, count(*) AS n FROM lineitem GROUP BY flags
"""


def gated_alignments(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 720).cast("double").alias("turn"), (F.abs("value") / 10).alias("scale"))
    return e.where(S.aligned(F.col("turn")) & S.scale_allowed(F.col("scale"))).select("event_id", "turn", F.round(S.bounded_score(F.col("scale"), 2.0), 6).alias("score"), F.round(S.completeness_penalty(F.col("turn") / 720), 6).alias("penalty"))


GATED_ALIGNMENTS = """
WITH e AS (SELECT event_id, (event_id % 720)::DOUBLE AS turn, abs(value) / 10 AS scale FROM events)
SELECT event_id, turn, round(scale / (scale + 2), 6) AS score, round((1 - turn / 720) * (1 - turn / 720), 6) AS penalty FROM e WHERE (turn <= 45 OR turn BETWEEN 315 AND 405 OR turn >= 675) AND scale BETWEEN 0.1 AND 10
"""

_SQL = {n.lower(): v for n, v in list(globals().items()) if n.isupper() and isinstance(v, str)}


def iso_regression(spark: SparkSession, d: str) -> DataFrame:
    """Each user's values by time, made non-decreasing. A user is one group: pooling runs along the whole sequence."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        return pdf.assign(fitted=K.isotonic(pdf.value.to_numpy()))[["user_id", "event_id", "fitted"]]

    fitted = table(spark, d, "events").select("user_id", "event_id", "ts", "value").groupBy("user_id").applyInPandas(run, "user_id long, event_id long, fitted double")
    # Halves of the last place go up on either side.
    return fitted.withColumn("fitted", F.round(F.col("fitted") + 1e-9, 6))


#: The fit at a place is the highest over beginnings before it of the lowest over ends behind it of the means between.
_SQL["iso_regression"] = """
WITH e AS (SELECT user_id, event_id, value, row_number() OVER w AS n, sum(value) OVER (w ROWS UNBOUNDED PRECEDING) AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT a.user_id, a.n AS s, b.n AS e, (b.c - a.c + a.value) / (b.n - a.n + 1) AS m FROM e a JOIN e b ON a.user_id = b.user_id AND b.n >= a.n),
q AS (SELECT user_id, e, min(m) OVER (PARTITION BY user_id, s ORDER BY e DESC) AS low FROM p)
SELECT e.user_id, event_id, round(max(low) + 1e-9::DOUBLE, 6) AS fitted FROM q JOIN e ON e.user_id = q.user_id AND e.n = q.e GROUP BY ALL
"""


def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("page"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    side = lambda c, n: (F.col(c) % n).cast("double")
    boxes = l.withColumns({"x1": side("l_partkey", 40), "y1": side("l_suppkey", 40), "x2": side("l_partkey", 40) + F.col("l_quantity"), "y2": side("l_suppkey", 40) + F.col("l_quantity")})
    found = boxes.where("l_returnflag = 'R'").select("page", F.row_number().over(_by_page()).cast("long").alias("ord"), "x1", "y1", "x2", "y2", F.lit(0.9).alias("confidence"))
    prior = boxes.where("l_returnflag <> 'R'").select("page", F.row_number().over(_by_page()).cast("long").alias("vessel_id"), "x1", "y1", "x2", "y2", F.when(F.col("l_returnflag") == "A", "approved").otherwise("pending").alias("status"), F.lit("detector").alias("source"))
    return D.reconcile(found, prior)


def _by_page():
    from pyspark.sql import Window as W

    return W.partitionBy("page").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def unmatched_overrides(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    keys = p.select((F.col("p_partkey") * 3).alias("p_partkey"))
    return L.unmatched_overrides(p, keys, keys.where("p_partkey % 2 = 0"), "p_partkey")


_SQL["unmatched_overrides"] = "SELECT DISTINCT p_partkey * 3 AS p_partkey FROM part WHERE p_partkey * 3 NOT IN (SELECT p_partkey FROM part)"

#: A page's detections one after the other, each with the boxes that are taken already.
_SQL["greedy_match"] = """
WITH RECURSIVE b AS (SELECT *, l_orderkey::VARCHAR AS page, (l_partkey % 40)::DOUBLE AS x1, (l_suppkey % 40)::DOUBLE AS y1, l_partkey % 40 + l_quantity AS x2, l_suppkey % 40 + l_quantity AS y2 FROM lineitem),
f AS (SELECT page, row_number() OVER w AS n, x1, y1, x2, y2 FROM b WHERE l_returnflag = 'R' WINDOW w AS (PARTITION BY page ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)),
p AS (SELECT page, row_number() OVER w AS v, x1, y1, x2, y2, CASE l_returnflag WHEN 'A' THEN 'approved' ELSE 'pending' END AS status FROM b WHERE l_returnflag <> 'R' WINDOW w AS (PARTITION BY page ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)),
i AS (SELECT f.page, n, v, greatest(least(f.x2, p.x2) - greatest(f.x1, p.x1), 0) * greatest(least(f.y2, p.y2) - greatest(f.y1, p.y1), 0) AS c, (f.x2 - f.x1) * (f.y2 - f.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) AS s FROM f JOIN p ON f.page = p.page),
o AS (SELECT page, n, list({'u': -c / (s - c), 'v': v} ORDER BY -c / (s - c), v) AS near FROM i WHERE s - c > 0 AND c / (s - c) >= 0.5 GROUP BY ALL),
g AS (SELECT f.*, list_transform(coalesce(near, []), lambda x: x.v) AS near FROM f LEFT JOIN o ON o.page = f.page AND o.n = f.n),
r(page, n, v, taken) AS (SELECT page, n, near[1], CASE WHEN len(near) > 0 THEN [near[1]] ELSE [] END FROM g WHERE n = 1
 UNION ALL SELECT x.page, x.n, x.v, CASE WHEN x.v IS NULL THEN x.taken ELSE list_append(x.taken, x.v) END FROM (SELECT g.page, g.n, r.taken, list_filter(g.near, lambda y: NOT list_contains(r.taken, y))[1] AS v FROM r JOIN g ON g.page = r.page AND g.n = r.n + 1) x),
t AS (SELECT page, max(v) AS top FROM p GROUP BY page)
SELECT f.page, coalesce(r.v, coalesce(top, -1) + count(*) FILTER (r.v IS NULL) OVER (PARTITION BY f.page ORDER BY f.n)) AS vessel_id, CASE WHEN p.status = 'approved' THEN p.x1 ELSE f.x1 END AS x1, CASE WHEN p.status = 'approved' THEN p.y1 ELSE f.y1 END AS y1,
 CASE WHEN p.status = 'approved' THEN p.x2 ELSE f.x2 END AS x2, CASE WHEN p.status = 'approved' THEN p.y2 ELSE f.y2 END AS y2, 0.9::DOUBLE AS confidence, coalesce(p.status, 'pending') AS status, 'detector' AS source, false AS stale, coalesce(p.status <> 'approved', true) AS moved
FROM f JOIN r ON r.page = f.page AND r.n = f.n LEFT JOIN p ON p.page = f.page AND p.v = r.v LEFT JOIN t ON t.page = f.page
UNION ALL SELECT page, v, x1, y1, x2, y2, NULL, status, 'detector', true, false FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.page = p.page AND r.v = p.v)
"""

QUERIES = {n: globals()[n] for n in _SQL}
ORACLE_SQL = dict(_SQL)
