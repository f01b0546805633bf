"""Joins, table rules, geometry, state and files over the generated tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilnwork.functions import boxes as B
from kilnwork.operators import curation as C
from kilnwork.operators import detections as D
from kilnwork.operators import linking as L
from kilnwork.operators import retrieval as R
from kilnwork.operators import sets as Q
from kilnwork.operators import tables as T
from kilnwork.session import shared_folder
from kilnwork.sources import files
from kilnwork.sources.tables import table


def _crops(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Crops that name a page's image, and pages with their source."""
    o = table(spark, d, "orders")
    crops = o.select(F.col("o_orderkey").alias("crop"), F.concat(F.lit("scan_"), (F.col("o_custkey") * 2).cast("string")).alias("image"))
    pages = table(spark, d, "customer").select(F.concat(F.lit("scan_"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, ".jpg").otherwise("")).alias("page_image"), F.concat(F.lit("pdf"), F.col("c_nationkey").cast("string")).alias("source"))
    return crops, pages


def crop_sources(spark: SparkSession, d: str) -> DataFrame:
    crops, pages = _crops(spark, d)
    return C.crop_sources(crops, pages, "image", "page_image", "source")


CROP_SOURCES = "SELECT o_orderkey AS crop, 'scan_' || (o_custkey * 2) AS image, 'pdf' || c_nationkey AS source FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2"


def scoped_targets(spark: SparkSession, d: str) -> DataFrame:
    crops, pages = _crops(spark, d)
    return C.crop_sources(crops, pages, "image", "page_image", "source").where(F.col("source") == "pdf3").select("crop")


SCOPED_TARGETS = "SELECT o_orderkey AS crop FROM orders JOIN customer ON c_custkey = o_custkey * 2 WHERE c_nationkey = 3"


def page_siblings(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("pdf"), F.floor(F.col("c_custkey") / 50).alias("index"), F.col("c_name").alias("image"))
    return C.siblings(c, "pdf", "index", "image")


PAGE_SIBLINGS = "SELECT a.c_name AS image, b.c_name AS sibling FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey // 50 = b.c_custkey // 50 AND a.c_name <> b.c_name"


def linked_contours(spark: SparkSession, d: str) -> DataFrame:
    """Contours whose card has both a figure and a number."""
    cards = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderkey") % 3 > 0, "2.1").alias("figure"), F.when(F.col("o_orderkey") % 5 > 0, "7").otherwise("").alias("no"))
    return table(spark, d, "lineitem").join(cards.where("coalesce(figure, '') <> '' AND coalesce(no, '') <> ''"), "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


LINKED_CONTOURS = "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey % 3 > 0 AND l_orderkey % 5 > 0 AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey"


def paired_files(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    images, masks = (p.where(f"p_partkey % {m} = 0").select(F.concat("p_brand", F.lit("_"), F.col("p_partkey").cast("string")).alias("stem")) for m in (2, 3))
    return images.join(masks, "stem", "left_semi").distinct()


PAIRED_FILES = "SELECT p_brand || '_' || p_partkey AS stem FROM part WHERE p_partkey % 6 = 0"


def staged_numbers(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select("o_orderkey", C.staged_number(F.when(k % 3 == 0, " ").when(k % 3 == 1, "nan").otherwise(F.col("o_orderstatus")), F.when(k % 2 == 0, F.col("o_custkey").cast("string"))).alias("no"))


STAGED_NUMBERS = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN o_orderstatus WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '?' END AS no FROM orders"


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each order's page: a text at a place."""
    l = table(spark, d, "lineitem")
    x, y = (F.col("l_partkey") % 90).cast("double"), (F.col("l_suppkey") % 40 + F.col("l_linenumber") * 7).cast("double")
    return l.select(F.col("l_orderkey").cast("string").alias("page"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int")).alias("text"), (F.col("l_discount") * 10).alias("score"), x.alias("x1"), y.alias("y1"), (x + F.col("l_quantity")).alias("x2"), (y + 6).alias("y2")).distinct()


_TOKENS = "SELECT DISTINCT l_orderkey::VARCHAR AS page, l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || l_quantity::INT AS text, l_discount * 10 AS score, (l_partkey % 90)::DOUBLE AS x1, (l_suppkey % 40 + l_linenumber * 7)::DOUBLE AS y1, (l_partkey % 90) + l_quantity AS x2, (l_suppkey % 40 + l_linenumber * 7 + 6)::DOUBLE AS y2 FROM lineitem"


def cell_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    cells = t.select("page").distinct().select("page", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("column")).select("page", F.lit(1).alias("row"), "column", (F.col("column") * 30).cast("double").alias("left"), (F.col("column") * 30 + 30).cast("double").alias("right"), F.lit(10.0).alias("top"), F.lit(50.0).alias("bottom"))
    return D.tokens_in_cells(t, cells).select("page", "text", "column", "safe")


CELL_TOKENS = f"""
WITH t AS ({_TOKENS}), c AS (SELECT unnest(range(4)) AS k)
SELECT page, text, k::INT AS column, (least(x2, k * 30 + 30) - greatest(x1, k * 30)) / (x2 - x1) >= 0.8 AND (least(y2, 50) - greatest(y1, 10)) / (y2 - y1) >= 0.8 AS safe FROM t, c
WHERE (x1 + x2) / 2 >= k * 30 AND (x1 + x2) / 2 < k * 30 + 30 AND (y1 + y2) / 2 >= 10 AND (y1 + y2) / 2 < 50
"""


def line_clusters(spark: SparkSession, d: str) -> DataFrame:
    return T.text_lines(_tokens(spark, d)).select("page", "text", F.col("line").cast("long").alias("line"))


LINE_CLUSTERS = f"""
WITH RECURSIVE t AS ({_TOKENS}), h AS (SELECT page, greatest(5.0, 0.65 * median(y2 - y1)) AS gap FROM t GROUP BY page),
o AS (SELECT t.page, text, (y1 + y2) / 2 AS c, gap, row_number() OVER (PARTITION BY t.page ORDER BY y1, x1, text) AS n FROM t JOIN h ON h.page = t.page),
r AS (SELECT page, text, n, 0::BIGINT AS line, c AS total, 1 AS k FROM o WHERE n = 1
 UNION ALL SELECT o.page, o.text, o.n, CASE WHEN abs(o.c - r.total / r.k) > o.gap THEN r.line + 1 ELSE r.line END, CASE WHEN abs(o.c - r.total / r.k) > o.gap THEN o.c ELSE r.total + o.c END, CASE WHEN abs(o.c - r.total / r.k) > o.gap THEN 1 ELSE r.k + 1 END FROM r JOIN o ON o.page = r.page AND o.n = r.n + 1)
SELECT page, text, line FROM r
"""


def anchor_choice(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    found = t.select("page", (F.col("y1") * 8).alias("y"), F.lit(20.0).alias("height"), "text", (F.col("x1") % 2 == 0).alias("expected"), (F.col("x2") % 2 == 0).alias("page_pass"), (F.col("y1") % 2 == 0).alias("exact"), F.col("score"))
    return T.row_anchors(found)


ANCHOR_CHOICE = f"""
WITH RECURSIVE t AS ({_TOKENS}), o AS (SELECT page, y1 * 8 AS y, text, x1 % 2 = 0 AS e, x2 % 2 = 0 AS p, y1 % 2 = 0 AS x, score, row_number() OVER (PARTITION BY page ORDER BY y1, text) AS n FROM t),
r AS (SELECT page, n, 0 AS line, y AS total, 1 AS k FROM o WHERE n = 1
 UNION ALL SELECT o.page, o.n, CASE WHEN abs(o.y - r.total / r.k) > 14.4 THEN r.line + 1 ELSE r.line END, CASE WHEN abs(o.y - r.total / r.k) > 14.4 THEN o.y ELSE r.total + o.y END, CASE WHEN abs(o.y - r.total / r.k) > 14.4 THEN 1 ELSE r.k + 1 END FROM r JOIN o ON o.page = r.page AND o.n = r.n + 1),
j AS (SELECT o.*, line, row_number() OVER (PARTITION BY o.page, line ORDER BY e DESC, p DESC, x DESC, score DESC, length(text) DESC, y, text) AS place, count(DISTINCT text) OVER (PARTITION BY o.page, line) > 1 AS conflict FROM o JOIN r ON o.page = r.page AND o.n = r.n)
SELECT page, y, text, conflict FROM j WHERE place = 1
"""


def drawing_numbers(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    drawings = t.where("x1 < 30").select("page", F.col("text").alias("drawing"), F.col("x2").alias("x"), F.col("y2").alias("y"))
    numbers = t.where("x1 >= 30").select("page", "text", F.col("x1").alias("nx"), F.col("y1").alias("ny"), "score")
    return T.nearest_numbers(drawings, numbers).select("page", "drawing", "number", F.round("fit", 6).alias("fit"))


DRAWING_NUMBERS = f"""
WITH t AS ({_TOKENS}), a AS (SELECT page, text AS drawing, x2 AS x, y2 AS y FROM t WHERE x1 < 30), b AS (SELECT page, text, x1 AS nx, y1 AS ny, score FROM t WHERE x1 >= 30),
p AS (SELECT a.*, b.text, score * exp(-sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny)) / 80) AS fit FROM a JOIN b ON a.page = b.page),
r AS (SELECT *, row_number() OVER (PARTITION BY page, drawing ORDER BY fit DESC, text) AS k FROM p WHERE fit >= 0.15)
SELECT a.page, a.drawing, r.text AS number, round(fit, 6) AS fit FROM a LEFT JOIN r ON r.page = a.page AND r.drawing = a.drawing AND k = 1
"""


def overlap_dedupe(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    q = F.col("l_quantity")
    boxed = l.withColumn("box", B.box(F.lit(0.0), F.lit(0.0), 50 + q, F.lit(40.0)))
    new, old = boxed.where("l_returnflag = 'R'"), boxed.where("l_returnflag <> 'R'").select("l_orderkey", "box")
    return D.without_overlaps(new, old, "l_orderkey", "box").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


OVERLAP_DEDUPE = """
WITH n AS (SELECT l_orderkey, l_quantity AS q FROM lineitem WHERE l_returnflag = 'R')
SELECT l_orderkey, count(*) AS n FROM n WHERE NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_returnflag <> 'R' AND o.l_orderkey = n.l_orderkey AND least(50 + q, 50 + o.l_quantity) / greatest(50 + q, 50 + o.l_quantity) >= 0.95) GROUP BY l_orderkey
"""


def table_accepts(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    ok = T.accepted(n - 2, k % 3 == 0, k % 2 == 0, k % 5 == 0, (k % 11 == 0) & (n == 1))
    letter = T.zero_as_letter(F.when(n > 3, "fire").otherwise("ware"), F.col("l_orderkey").cast("string"))
    return l.select("l_orderkey", "l_linenumber", ok.alias("accepted"), letter.alias("text")).distinct()


TABLE_ACCEPTS = "SELECT DISTINCT l_orderkey, l_linenumber, (l_linenumber > 2 AND (l_partkey % 3 = 0 OR (l_partkey % 2 <> 0 AND l_partkey % 5 = 0))) OR (l_partkey % 11 = 0 AND l_linenumber = 1) AS accepted, CASE WHEN l_linenumber > 3 THEN replace(l_orderkey::VARCHAR, '0', 'O') ELSE l_orderkey::VARCHAR END AS text FROM lineitem"


def usual_columns(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", T.even_bounds([0.12, 0.2, 0.45, 0.9], 0.1, 0.95, (F.col("p_size") * 37 + 400)).alias("b"))
    return p.select("p_partkey", F.posexplode("b").alias("k", "c")).select("p_partkey", "k", "c.left", "c.right")


USUAL_COLUMNS = """
WITH p AS (SELECT p_partkey, (p_size * 37 + 400)::DOUBLE AS w FROM part), e AS (SELECT [0.0, ((0.12 - 0.1) / 0.85 + (0.2 - 0.1) / 0.85) / 2, ((0.2 - 0.1) / 0.85 + (0.45 - 0.1) / 0.85) / 2, ((0.45 - 0.1) / 0.85 + (0.9 - 0.1) / 0.85) / 2, 1.0]::DOUBLE[] AS e), k AS (SELECT unnest(range(4)) AS k)
SELECT p_partkey, k::INT AS k, round_even(e[k + 1] * w, 0)::INT AS left, round_even(e[k + 2] * w, 0)::INT AS right FROM p, e, k
"""


def missing_numbers(spark: SparkSession, d: str) -> DataFrame:
    """What is read again: expected rows that no reading gave; and what a crop's rows have on the page."""
    l = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("number")).distinct()
    wanted = l.select("l_orderkey").distinct().select("l_orderkey", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("number"))
    return Q.pending(wanted, l, ["l_orderkey", "number"]).withColumn("top", F.col("number") * 12 + F.col("l_orderkey") % 100)


MISSING_NUMBERS = "WITH w AS (SELECT DISTINCT l_orderkey, unnest(range(1, 5)) AS number FROM lineitem) SELECT l_orderkey, number, number * 12 + l_orderkey % 100 AS top FROM w WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = w.l_orderkey AND l.l_linenumber = w.number)"


def calibrations(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax").distinct()
    p = F.struct((F.col("l_partkey") % 60).cast("double").alias("x"), F.lit(3.0).alias("y"))
    q = F.struct(F.col("l_quantity").alias("x"), (F.col("l_suppkey") % 30).cast("double").alias("y"))
    scale = B.pixels_per_cm(p, q, F.col("l_linenumber") - 2.0, F.lit(45), F.lit(25))
    value = F.when(F.col("l_linenumber") == 1, F.col("l_tax") - 0.02)
    checked = B.verified_measurement(value, p, q, scale)
    roi = B.padded(B.box(F.col("l_quantity"), F.lit(5.0), F.col("l_quantity") + 30, F.lit(25.0)), F.lit(70), F.lit(40))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", scale.alias("scale"), F.round(checked["verified_cm"], 6).alias("cm"), checked["status"].alias("status"), *[roi[c].alias(c) for c in ("x1", "y1", "x2", "y2")])


CALIBRATIONS = """
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax FROM lineitem), p AS (SELECT *, (l_partkey % 60)::DOUBLE AS a, l_quantity AS b, (l_suppkey % 30)::DOUBLE AS c, l_linenumber - 2.0 AS cm FROM l),
g AS (SELECT *, sqrt((a - b) * (a - b) + (3 - c) * (3 - c)) AS dist FROM p), s AS (SELECT *, CASE WHEN dist >= 5 AND cm > 0 AND a <= 45 AND b <= 45 AND c <= 25 THEN round(dist / cm::DOUBLE, 6) END AS scale FROM g),
v AS (SELECT *, coalesce(CASE WHEN l_linenumber = 1 THEN l_tax - 0.02 END, dist / scale) AS found FROM s), m AS (SELECT *, greatest(12.0, 0.28 * greatest(30, 20)) AS pad FROM v)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, scale, CASE WHEN found > 0 THEN round(found, 6) END AS cm, CASE WHEN found > 0 THEN 'verified_manual' END AS status,
 round_even(greatest(l_quantity - pad, 0), 0)::INT AS x1, 0 AS y1, least(70, round_even(l_quantity + 30 + pad, 0))::INT AS x2, 37 AS y2 FROM m
"""


def flipped_walls(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    points = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.struct(F.element_at("embedding", i * 2 - 1).cast("double").alias("x"), F.element_at("embedding", i * 2).cast("double").alias("y")))
    out = B.restored(B.mirrored(points, F.lit(100)), F.lit(2.5), F.struct(F.lit(1.0).alias("x"), F.lit(-2.0).alias("y")))
    edges = F.array_sort(F.transform(F.slice("embedding", 1, 23), lambda v: F.abs(v).cast("double")))
    return e.select("vec_id", F.transform(out, lambda p: F.round(p["x"], 6)).alias("x"), F.transform(out, lambda p: F.round(p["y"], 6)).alias("y"), B.valid_edges(edges).alias("edges_valid"))


FLIPPED_WALLS = """
WITH e AS (SELECT *, list_sort(list_transform(embedding[1:23], lambda v: abs(v)::DOUBLE)) AS s FROM embeddings)
SELECT vec_id, list_transform(range(1, 9), lambda i: round((99 - embedding[i * 2 - 1]::DOUBLE) * 2.5 + 1, 6)) AS x, list_transform(range(1, 9), lambda i: round(embedding[i * 2]::DOUBLE * 2.5 - 2, 6)) AS y,
 s[1] >= 0 AND s[23] <= 1 AND list_min(list_transform(range(1, 23), lambda i: s[i + 1] - s[i])) >= 0.0015 AS edges_valid FROM e
"""


def coefficient_bank(spark: SparkSession, d: str) -> DataFrame:
    """Signals rebuilt from eight coefficients, and their nearest reference, the first signal of each label, by the distance of the rebuilt signals."""
    e = table(spark, d, "embeddings").select("vec_id", "label", B.inverse_dct(B.dct(F.slice("embedding", 1, 16), 16, 8), 16, 8).alias("s"))
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("s").alias("q"))
    banked = Q.one_of_each(e, ["label"], [F.col("vec_id")])
    scored = queries.join(F.broadcast(banked)).withColumn("rmsd", B.rms_distance(F.col("q"), F.col("s")))
    best = scored.groupBy("query_id").agg(F.min_by(F.struct("vec_id", "rmsd"), F.struct("rmsd", "vec_id")).alias("b"))
    return best.select("query_id", F.col("b.vec_id").alias("ref_id"), F.round("b.rmsd", 6).alias("rmsd"))


COEFFICIENT_BANK = """
WITH c AS (SELECT vec_id, list_transform(range(8), lambda k: sqrt((CASE WHEN k = 0 THEN 1 ELSE 2 END) / 16.0) * list_sum(list_transform(range(16), lambda i: embedding[i + 1]::DOUBLE * cos(pi() / 16 * (i + 0.5) * k)))) AS c FROM embeddings),
s AS (SELECT vec_id, list_transform(range(16), lambda i: list_sum(list_transform(range(8), lambda k: c[k + 1] * sqrt((CASE WHEN k = 0 THEN 1 ELSE 2 END) / 16.0) * cos(pi() / 16 * (i + 0.5) * k)))) AS s FROM c),
p AS (SELECT q.vec_id AS query_id, r.vec_id AS ref_id, sqrt(list_sum(list_transform(range(1, 17), lambda i: pow(q.s[i] - r.s[i], 2))) / 16) AS rmsd FROM s q JOIN s r ON q.vec_id % 20 = 0 AND r.vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label))
SELECT query_id, ref_id, round(rmsd, 6) AS rmsd FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rmsd, ref_id) = 1
"""


def variant_scan(spark: SparkSession, d: str) -> DataFrame:
    """Each query's five nearest references, by the least squared distance of any of its two variants and their three."""
    part = lambda a: F.transform(F.slice("embedding", a, 16), lambda v: v.cast("double"))
    # Vectors with what has no distance, or too short, go a plainer way, in which missing numbers don't count.
    whole = F.coalesce((F.size("embedding") >= 48) & F.forall(F.slice("embedding", 1, 48), lambda v: v.isNotNull() & (F.abs(v) < 1e30)), F.lit(False))
    e = table(spark, d, "embeddings").where("vec_id is not null").select("vec_id", whole.alias("whole"), part(1).alias("a"), part(17).alias("b"), part(33).alias("c"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.array("a", "b").alias("q"), "whole")
    r = e.select(F.col("vec_id").alias("ref_id"), F.array("a", "b", "c").alias("r"), F.col("whole").alias("usual"))
    near = R.near_variants(q.where("whole").drop("whole"), r.where("usual").drop("usual"), 5)
    pairs = r.where("NOT usual").join(F.broadcast(q)).unionByName(r.where("usual").join(F.broadcast(q.where("NOT whole")))).where("query_id <> ref_id")
    squares = lambda x, y: F.filter(F.zip_with(x, y, lambda v, w: (v - w) * (v - w)), lambda s: s.isNotNull())
    total = lambda s: F.when(F.size(s) > 0, F.aggregate(s, F.lit(0.0), lambda t, v: t + v))
    gap = F.array_min(F.flatten(F.transform("q", lambda x: F.transform("r", lambda y: total(squares(x, y))))))
    best = near.unionByName(pairs.select("query_id", "ref_id", gap.alias("score"))).groupBy("query_id", "ref_id").agg(F.min("score").alias("score"))
    # The queries, a stated set, go to every task; ranks are cut before they are dealt out.
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").asc_nulls_last(), "ref_id")).cast("long")
    return best.withColumn("rank", rank).where("rank <= 5").select("query_id", "ref_id", "rank", F.round("score", 6).alias("score"))


VARIANT_SCAN = """
WITH e AS (SELECT vec_id, [embedding[1:16], embedding[17:32], embedding[33:48]] AS v FROM embeddings), q AS (SELECT vec_id AS query_id, unnest(v[1:2]) AS q FROM e WHERE vec_id % 20 = 0), r AS (SELECT vec_id AS ref_id, unnest(v) AS r FROM e),
s AS (SELECT query_id, ref_id, min(list_sum(list_transform(range(1, 17), lambda i: pow(q[i]::DOUBLE - r[i]::DOUBLE, 2)))) AS score FROM q JOIN r ON query_id <> ref_id GROUP BY ALL)
SELECT query_id, ref_id, row_number() OVER (PARTITION BY query_id ORDER BY score, ref_id) AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 5
"""


def state_totals(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select((F.col("o_totalprice") > 100_000).alias("ready"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("open").alias("review_status"))
    return C.state_totals(o)


STATE_TOTALS = "SELECT count(*) AS figures, count(*) FILTER (o_totalprice > 100000) AS ready, count(*) FILTER (o_orderstatus = 'F') AS reviewed, count(*) FILTER (o_orderstatus <> 'F' AND NOT o_totalprice > 100000) AS unresolved FROM orders"


def unresolved_figures(spark: SparkSession, d: str) -> DataFrame:
    """Figures that aren't approved, with the messages that block them."""
    o = table(spark, d, "orders").where("o_orderstatus <> 'F'")
    codes = F.array(F.when(F.col("o_totalprice") > 300_000, "too_large"), F.when(F.col("o_custkey") % 7 == 0, "no_number"), F.when(F.col("o_orderkey") % 9 == 0, "low_ocr_confidence"))
    blocking = F.filter(F.array_compact(codes), lambda c: L.blocking(c, F.lit(None).cast("string")))
    return o.select("o_orderkey", F.concat_ws(",", blocking).alias("messages"))


UNRESOLVED_FIGURES = "SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice > 300000 THEN 'too_large' END, CASE WHEN o_custkey % 7 = 0 THEN 'no_number' END) AS messages FROM orders WHERE o_orderstatus <> 'F'"


def repeated_numbers(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.array_sort(F.collect_list("l_partkey")).alias("parts")).where(F.size("parts") > 1)
    return l.select("l_orderkey", "l_linenumber", F.size("parts").cast("long").alias("n"), "parts")


REPEATED_NUMBERS = "SELECT l_orderkey, l_linenumber, count(*) AS n, list_sort(list(l_partkey)) AS parts FROM lineitem GROUP BY ALL HAVING count(*) > 1"


def scaling_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports of several index sizes in one table, with intervals worked out where a report has none."""
    from kilnwork.functions import scoring as S

    o = table(spark, d, "orders")
    one = lambda label, part, stored: o.where(part).groupBy(F.col("o_orderpriority").alias("condition")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("hits"), F.count(F.lit(1)).alias("total")).select(F.lit(label).alias("index_label"), "condition", "hits", "total", stored.alias("stored_low"))
    both = one("current", "o_orderkey >= 0", F.lit(None).cast("double")).unionByName(one("half", "o_orderkey % 2 = 0", F.lit(0.25)))
    ci = S.wilson(F.col("hits"), F.col("total"))
    return both.select("index_label", "condition", "hits", "total", F.round(F.col("hits") / F.col("total"), 6).alias("recall"), F.round(F.coalesce("stored_low", ci["low"]), 6).alias("low"), F.round(ci["high"], 6).alias("high"))


SCALING_REPORTS = """
WITH u AS (SELECT 'current' AS index_label, o_orderpriority AS condition, o_orderstatus, NULL::DOUBLE AS stored FROM orders UNION ALL SELECT 'half', o_orderpriority, o_orderstatus, 0.25 FROM orders WHERE o_orderkey % 2 = 0),
g AS (SELECT index_label, condition, count(*) FILTER (o_orderstatus = 'F') AS hits, count(*) AS total, max(stored) AS stored, 1.959963984540054::DOUBLE AS z FROM u GROUP BY ALL), s AS (SELECT *, hits / total AS p FROM g),
k AS (SELECT *, (p + z * z / (2 * total)) / (1 + z * z / total) AS c, z * sqrt(p * (1 - p) / total + z * z / (4.0 * total * total)) / (1 + z * z / total) AS m FROM s)
SELECT index_label, condition, hits, total, round(p, 6) AS recall, round(coalesce(stored, greatest(c - m, 0)), 6) AS low, round(least(c + m, 1), 6) AS high FROM k
"""


def newest_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The twenty newest jobs, and each one's share of work done."""
    e = table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20)
    return e.select("event_id", F.round((F.col("event_id") % 50) / 50, 6).alias("progress"))


NEWEST_JOBS = "SELECT event_id, round((event_id % 50) / 50, 6) AS progress FROM events ORDER BY ts DESC, event_id DESC LIMIT 20"


def page_order(spark: SparkSession, d: str) -> DataFrame:
    """Pages of one source by logical index, unknown ones last, numbered from 0."""
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 6 > 0, F.col("c_custkey") * 7 % 101).alias("logical_index"))
    return Q.dense_order(c.withColumn("_at", F.coalesce("logical_index", F.lit(10**9))), ["c_nationkey"], ["_at", "c_custkey"], "place").select("c_nationkey", "c_custkey", "place")


PAGE_ORDER = "SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(CASE WHEN c_custkey % 6 > 0 THEN c_custkey * 7 % 101 END, 1000000000), c_custkey) - 1 AS place FROM customer"


def replaced_part(spark: SparkSession, d: str) -> DataFrame:
    """One image's rows replaced, with a column more; and what the new ones made obsolete."""
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name")
    new = n.where("n_nationkey % 3 = 0").select((F.col("n_nationkey") + 100).alias("n_nationkey"), F.lit(2).alias("n_regionkey"), "n_name", F.lit("new").alias("note"))
    gone = n.where("n_regionkey = 2").join(new.select(F.col("n_nationkey") - 100, "n_name").toDF("n_nationkey", "n_name"), ["n_nationkey", "n_name"], "left_anti")
    out = Q.replace_part(C.ensure_columns(n, ["note"]), F.col("n_regionkey") == 2, new)
    return out.unionByName(gone.withColumn("note", F.lit("obsolete")))


REPLACED_PART = """
SELECT n_nationkey, n_regionkey, n_name, '' AS note FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT n_nationkey + 100, 2, n_name, 'new' FROM nation WHERE n_nationkey % 3 = 0
UNION ALL SELECT n_nationkey, n_regionkey, n_name, 'obsolete' FROM nation WHERE n_regionkey = 2 AND n_nationkey % 3 <> 0
"""


def warning_dedupe(spark: SparkSession, d: str) -> DataFrame:
    from kilnwork.functions import text as X

    e = table(spark, d, "events").select(X.warning_id(F.col("event_type"), F.lit("m"), F.col("user_id") % 7, F.lit(None).cast("string")).alias("id"), "event_id", "event_type")
    return Q.one_of_each(e, ["id"], [F.col("event_id")])


WARNING_DEDUPE = "WITH e AS (SELECT substr(sha256(event_type || '|m|' || (user_id % 7) || '|'), 1, 16) AS id, event_id, event_type FROM events) SELECT id, min(event_id) AS event_id, min(event_type) AS event_type FROM e GROUP BY id"


def row_operations(spark: SparkSession, d: str) -> DataFrame:
    """Each figure's rows after some are deleted, some doubled, one added and all sorted by number."""
    from kilnwork.functions import text as X

    p = table(spark, d, "part").select(F.col("p_brand").alias("figure"), F.col("p_partkey").cast("double").alias("ord"), F.concat(F.col("p_size").cast("string"), F.lit("a")).alias("no"))
    kept = p.where("ord % 7 <> 0")
    doubled = kept.where("ord % 5 = 0").withColumn("ord", F.col("ord") + 0.5)
    added = kept.select("figure").distinct().select("figure", F.lit(1e6).alias("ord"), F.lit("0").alias("no"))
    out = kept.unionByName(doubled).unionByName(added)
    place = F.row_number().over(W.partitionBy("figure").orderBy(X.natural_key(F.col("no")), "ord")) - 1
    return out.select("figure", "no", "ord", place.cast("long").alias("place"))


ROW_OPERATIONS = """
WITH p AS (SELECT p_brand AS figure, p_partkey::DOUBLE AS ord, p_size AS size FROM part WHERE p_partkey % 7 <> 0), u AS (SELECT figure, ord, size, size || 'a' AS no FROM p UNION ALL SELECT figure, ord + 0.5, size, size || 'a' FROM p WHERE ord % 5 = 0 UNION ALL SELECT DISTINCT figure, 1e6, 0, '0' FROM p)
SELECT figure, no, ord, row_number() OVER (PARTITION BY figure ORDER BY size, ord) - 1 AS place FROM u
"""


def edits_replayed(spark: SparkSession, d: str) -> DataFrame:
    """Submitted rows turned into overrides and replayed on the stored ones give the submitted rows."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").cast("string").alias("c_nationkey"))
    k = F.col("c_custkey")
    stored, sent = c.where(k % 5 > 0), c.where(k % 7 > 0).withColumn("c_mktsegment", F.when(k % 3 == 0, "EDITED").otherwise(F.col("c_mktsegment")))
    diff = L.row_differences(stored, sent, "c_custkey", ["c_mktsegment", "c_nationkey"])
    added = sent.join(diff.where("kind = 'added'").select("c_custkey"), "c_custkey", "left_semi")
    return L.replay_overrides(stored, diff.where("kind = 'cell'"), diff.where("kind = 'deleted'"), added, "c_custkey", ["c_mktsegment", "c_nationkey"])


EDITS_REPLAYED = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'EDITED' ELSE c_mktsegment END AS c_mktsegment, c_nationkey::VARCHAR AS c_nationkey FROM customer WHERE c_custkey % 7 > 0"


def restorable_reviews(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_type", F.col("p_name").alias("file"))
    current, held = p.where("p_partkey % 4 = 0").select("p_partkey"), p.where("p_size > 10").select("file").distinct()
    return C.restorable(p, current, held, "p_partkey", "p_type", "file", ["ECONOMY", "STANDARD"]).select("p_partkey")


RESTORABLE_REVIEWS = "SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'STANDARD') AND p_partkey % 4 <> 0 AND p_name IN (SELECT p_name FROM part WHERE p_size > 10)"


def query_set_faults(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    q = n.select((F.col("n_nationkey") + F.when(F.col("n_nationkey") == 4, 1).otherwise(0)).alias("number"), F.concat(F.lit("q"), (F.col("n_nationkey") % 20).cast("string")).alias("query"), F.concat(F.lit("t"), (F.col("n_nationkey") % 9).cast("string")).alias("target"))
    t = n.where("n_nationkey < 12 AND n_nationkey <> 5").select(F.concat(F.lit("t"), (F.col("n_nationkey") % 10).cast("string")).alias("target"))
    return C.query_set_faults(q, t, "number", "query", "target", 24)


QUERY_SET_FAULTS = """
WITH q AS (SELECT n_nationkey + CASE WHEN n_nationkey = 4 THEN 1 ELSE 0 END AS number, 'q' || (n_nationkey % 20) AS query, 't' || (n_nationkey % 9) AS target FROM nation), t AS (SELECT 't' || (n_nationkey % 10) AS target FROM nation WHERE n_nationkey < 12 AND n_nationkey <> 5)
SELECT 'missing_number' AS fault, n::VARCHAR AS value FROM (SELECT unnest(range(1, 25)) AS n) WHERE n NOT IN (SELECT number FROM q) UNION ALL SELECT 'repeated_number', number::VARCHAR FROM q GROUP BY number HAVING count(*) > 1
UNION ALL SELECT 'repeated_query', query FROM q GROUP BY query HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'unknown_target', target FROM q WHERE target NOT IN (SELECT target FROM t)
UNION ALL SELECT 'several_references', target FROM t WHERE target IN (SELECT target FROM q) GROUP BY target HAVING count(*) > 1
"""


def diagnostics_side_table(spark: SparkSession, d: str) -> DataFrame:
    """Old states migrated: the evidence of each out of the side table, and the states' new version."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("cell"), F.col("l_quantity").alias("confidence"))).alias("diagnostics"))
    states, side = C.migrated(l, "diagnostics", "l_orderkey")
    own = side.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("cells"), F.sum("confidence").alias("confidence"))
    return own.join(states, "l_orderkey").select("l_orderkey", "cells", "confidence", F.col("version").cast("long").alias("version"))


DIAGNOSTICS_SIDE_TABLE = "SELECT l_orderkey, count(*) AS cells, sum(l_quantity) AS confidence, 2::BIGINT AS version FROM lineitem GROUP BY l_orderkey"


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A table written as text and read back, all columns strings, blanks for missing values."""
    folder = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    c = table(spark, d, "customer").select(F.concat("c_name", F.lit(', "a"')).alias("c_name"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("c_mktsegment"), F.col("c_custkey"))
    files.write_export(c, folder, ["c_custkey", "c_name", "c_mktsegment"])
    return files.read_csv(spark, folder)


CSV_ROUND_TRIP = """SELECT c_custkey::VARCHAR AS c_custkey, c_name || ', "a"' AS c_name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE '' END AS c_mktsegment FROM customer"""


def document_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Nested records written as documents and read back by their schema, in order of (exported, run)."""
    folder = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.struct(F.col("o_orderstatus").alias("status"), F.array("o_orderpriority").alias("notes")).alias("result"), F.col("o_orderdate").cast("string").alias("exported_at"))
    o.repartition(3).write.json(folder)
    found = spark.read.schema("run_id long, result struct<status:string,notes:array<string>>, exported_at string").json(folder)
    return found.select("run_id", "result.status", F.get("result.notes", 0).alias("note"), F.row_number().over(W.partitionBy("result.status").orderBy("exported_at", "run_id")).cast("long").alias("place"))


DOCUMENT_ROUND_TRIP = "SELECT o_orderkey AS run_id, o_orderstatus AS status, o_orderpriority AS note, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS place FROM orders"


def versioned_table(spark: SparkSession, d: str) -> DataFrame:
    """A table's second version after a writer with an old expectation was refused; and whether a derived table is fresh."""
    folder = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.lit("s1").alias("signature"))
    first = files.write_version(n, folder)
    files.write_version(n.where("n_nationkey > 4"), folder, first)
    refused = 0
    try:
        files.write_version(n, folder, first)
    except RuntimeError:
        refused = 1
    fresh = files.index_is_fresh(spark, folder, "s1") and not files.index_is_fresh(spark, folder, "s2")
    return files.read_version(spark, folder).select("n_nationkey", "n_name", F.lit(refused).cast("long").alias("refused"), F.lit(fresh).alias("fresh"))


VERSIONED_TABLE = "SELECT n_nationkey, n_name, 1::BIGINT AS refused, true AS fresh FROM nation WHERE n_nationkey > 4"


def due_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The job that is due in each queue: of those not done, one for each dedupe key, the least (priority, sequence)."""
    e = table(spark, d, "events").select((F.col("user_id") % 11).alias("queue"), F.col("event_id").alias("id"), F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("dedupe_key"), (F.col("event_id") % 4).alias("priority"))
    first = Q.one_of_each(e.where("id % 3 > 0"), ["queue", "dedupe_key"], [F.col("id")])
    return first.groupBy("queue").agg(F.min_by("id", F.struct("priority", "id")).alias("id"))


DUE_JOBS = """
WITH f AS (SELECT user_id % 11 AS queue, event_type || ':' || user_id AS k, min(event_id) AS id FROM events WHERE event_id % 3 > 0 GROUP BY ALL)
SELECT queue, id FROM f QUALIFY row_number() OVER (PARTITION BY queue ORDER BY id % 4, id) = 1
"""


def threshold_share(spark: SparkSession, d: str) -> DataFrame:
    """Codes that hold, with the rows that have each."""
    l = table(spark, d, "lineitem")
    codes = F.array_compact(F.array(F.when(F.col("l_discount") > 0.05, "steep"), F.when(F.col("l_quantity") > 30, "large")))
    return l.select(F.explode(codes).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


THRESHOLD_SHARE = "SELECT 'steep' AS reason, count(*) AS n FROM lineitem WHERE l_discount > 0.05 UNION ALL SELECT 'large', count(*) FROM lineitem WHERE l_quantity > 30"

QUERIES = {n: f for n, f in list(globals().items()) if n.upper() in globals() and callable(f) and n.islower() and not n.startswith("_")}
ORACLE_SQL = {n: globals()[n.upper()] for n in QUERIES}
