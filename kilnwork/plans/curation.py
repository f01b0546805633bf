"""Review, curation and batch queries over the generated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.functions import scoring as S
from kilnwork.functions import text as X
from kilnwork.operators import curation as C
from kilnwork.operators import sets as Q
from kilnwork.operators import tables as T
from kilnwork.sources.tables import table


def page_text_index(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(F.regexp_extract("url", r"/([a-z]{2})/", 1).alias("figure"), "page_id")
    return C.first_pages(p, "figure", "page_id")


PAGE_TEXT_INDEX = "SELECT regexp_extract(url, '/([a-z]{2})/', 1) AS figure, min(page_id) AS page_id FROM pages WHERE regexp_extract(url, '/([a-z]{2})/', 1) <> '' GROUP BY 1"


def classification_join(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    cards = p.select("p_partkey", F.concat(F.col("p_partkey").cast("string"), F.lit(".x.PNG")).alias("file"))
    classes = p.where("p_size > 10").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".x")).alias("file"), F.col("p_type").alias("type"))
    return C.classified(cards, classes, "file", "type", "ENT")


CLASSIFICATION_JOIN = "SELECT p_partkey, p_partkey || '.x.PNG' AS file, CASE WHEN p_size > 10 THEN p_type ELSE 'ENT' END AS type FROM part"


def box_count_per_image(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("image"))
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), "l_returnflag", "l_linestatus")
    boxes = l.where("l_linestatus = 'O'").select("image", F.when(F.col("l_returnflag") == "R", "deleted").otherwise("approved").alias("status"))
    return C.box_counts(o, boxes, l.where("l_linestatus = 'F'"))


BOX_COUNT_PER_IMAGE = """
WITH b AS (SELECT l_orderkey AS k, count(*) FILTER (l_returnflag <> 'R') AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), p AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT o_orderkey AS image, coalesce(b.n, p.n, 0) AS n_boxes FROM orders LEFT JOIN b ON b.k = o_orderkey LEFT JOIN p ON p.k = o_orderkey
"""


def source_set_subset(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("figure"), F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string")).alias("source"), "l_returnflag")
    return C.foreign_sources(l.where("l_returnflag = 'R'"), l.where("l_returnflag <> 'R'"), "figure", "source")


SOURCE_SET_SUBSET = """
WITH l AS (SELECT DISTINCT l_orderkey AS figure, 's' || (l_suppkey % 4) AS source, l_returnflag = 'R' AS own FROM lineitem)
SELECT figure, list_sort(list(source)) AS sources FROM (SELECT DISTINCT figure, source FROM l WHERE NOT own) r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.own AND l.figure = r.figure AND l.source = r.source) GROUP BY figure
"""


def geometry_invalidate(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("string").alias("box"), F.lit("approved").alias("review"))
    k = F.col("c_custkey")
    after = c.withColumn("box", F.when(k % 5 == 0, "moved").otherwise(F.col("box")))
    return C.reset_changed(c.where("c_custkey % 7 <> 0"), after, "c_custkey", "box", {"review": "pending"}).select("c_custkey", "review")


GEOMETRY_INVALIDATE = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 'pending' ELSE 'approved' END AS review FROM customer"


def box_review_apply(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.lit("pending").alias("status"))
    k = F.col("p_partkey")
    given = p.where("p_partkey % 3 = 0").select((k + F.when(k % 2 == 0, 0).otherwise(50_000_000)).alias("p_partkey"), "p_brand", F.when(k % 4 == 0, "deleted").otherwise("approved").alias("status"))
    return C.apply_review(p, given, "p_partkey", ["p_brand", "status"])


BOX_REVIEW_APPLY = """
SELECT p_partkey, p_brand, CASE WHEN p_partkey % 12 = 0 THEN 'deleted' WHEN p_partkey % 6 = 0 THEN 'approved' ELSE 'pending' END AS status FROM part
UNION ALL SELECT p_partkey + 50000000, p_brand, 'approved' FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 <> 0
"""


def training_manifest_merge(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("dpi"), F.col("o_orderstatus").alias("decision"))
    wanted = o.where("o_orderkey % 3 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 1, "other").otherwise(F.col("dpi")).alias("dpi"))
    return C.merge_manifest(o.where("o_orderkey % 4 <> 0"), wanted, "o_orderkey", ["dpi"], "decision")


TRAINING_MANIFEST_MERGE = """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 10 = 1 THEN 'other' ELSE o_orderpriority END AS dpi, CASE WHEN o_orderkey % 4 = 0 THEN 'pending' ELSE o_orderstatus END AS decision,
 o_orderkey % 3 <> 0 AND (o_orderkey % 10 = 1 OR o_orderkey % 4 = 0) AS render FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 4 <> 0
"""


def verify_batch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("user_id") * 40 + F.col("event_id") % 40).alias("query_id"), F.when(F.col("event_type") == "error", "v14").otherwise("v15").alias("version"), (F.col("event_id") % 401).alias("pool"))
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"))
    return C.batch_faults(e, wanted, "query_id", "version", "pool", 100)


VERIFY_BATCH = """
WITH e AS (SELECT user_id * 40 + event_id % 40 AS query_id, CASE WHEN event_type = 'error' THEN 'v14' ELSE 'v15' END AS version, event_id % 401 AS pool FROM events),
n AS (SELECT query_id, count(*) AS n, min(version) AS v, min(pool) AS p FROM e GROUP BY query_id), u AS (SELECT version AS usual FROM e GROUP BY version ORDER BY count(*) DESC, version LIMIT 1),
b AS (SELECT coalesce(n.query_id, c_custkey) AS query_id, n.n, v, p, c_custkey AS wanted, usual FROM n FULL JOIN customer ON c_custkey = n.query_id CROSS JOIN u)
SELECT query_id, 'missing' AS fault FROM b WHERE n IS NULL UNION ALL SELECT query_id, 'unexpected' FROM b WHERE wanted IS NULL UNION ALL SELECT query_id, 'repeated' FROM b WHERE n > 1
UNION ALL SELECT query_id, 'other_version' FROM b WHERE v <> usual UNION ALL SELECT query_id, 'short_pool' FROM b WHERE p < 100
"""


def expected_vs_top2(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    known = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    return C.beside_expected(o, known, "o_custkey", "o_orderkey", "o_totalprice").withColumn("place", F.col("place").cast("long"))


EXPECTED_VS_TOP2 = """
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS k, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS known FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice, CASE WHEN k <= 2 THEN k END AS place FROM r WHERE k <= 2 OR known
"""


def vision_letter_map(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("grp"), "n_nationkey", F.col("n_name").alias("card"))
    values = n.select("grp", F.lit("C").alias("letter"), F.lit("rim").alias("value")).distinct().unionByName(n.select("grp", F.lit("A").alias("letter"), F.lit("base").alias("value")).distinct())
    return C.letters_back(n, values, "grp", "n_nationkey", "card")


VISION_LETTER_MAP = """
WITH n AS (SELECT n_regionkey AS grp, n_name AS card, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)
SELECT grp, CASE k WHEN 1 THEN 'A' ELSE 'C' END AS letter, CASE k WHEN 1 THEN 'base' ELSE 'rim' END AS value, card FROM n WHERE k IN (1, 3)
"""


def citation_metadata_index(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.concat(F.lit("Figure "), F.regexp_extract("p_brand", r"(\d+)", 1)).alias("fig"), F.concat(F.lit("No. "), F.col("p_size").cast("string")).alias("no"), F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.col("p_type")).alias("ware"))
    return C.citation_index(p, "fig", "no", ["ware"])


CITATION_METADATA_INDEX = r"""
SELECT regexp_extract(p_brand, '\d+') AS figure, CAST(p_size AS BIGINT) AS item, list_sort(coalesce(list(DISTINCT p_type) FILTER (p_partkey % 3 <> 0), [])) AS ware FROM part GROUP BY 1, 2
"""


def hypothesis_distinct(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("hypothesis"))
    return C.best_hypotheses(l, ["l_orderkey"], {"l_quantity": 20.0, "l_discount": 0.06}, "l_extendedprice", "hypothesis")


HYPOTHESIS_DISTINCT = """
SELECT l_orderkey, m.s AS l_extendedprice, m.i AS hypothesis FROM (SELECT l_orderkey, min({'s': l_extendedprice, 'i': l_partkey * 10 + l_linenumber}) AS m FROM lineitem GROUP BY l_orderkey, round(l_quantity / 20.0), round(l_discount / 0.06))
"""


def figure_row_order(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    rows = p.select(F.col("p_brand").alias("figure"), F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.col("p_size").cast("string")).alias("number"), F.concat(F.lit("p"), (F.col("p_partkey") % 13).cast("string")).alias("page"), F.col("p_partkey").alias("i"))
    pages = rows.select("figure", "page").distinct().where("page <> 'p5'").withColumn("logical_index", (-F.substring("page", 2, 9).cast("int")))
    return C.row_order(rows, pages, "figure", "number", "page", "i").select("figure", "i", "place")


FIGURE_ROW_ORDER = """
WITH r AS (SELECT p_brand AS figure, p_partkey AS i, p_partkey % 9 = 0 AS blank, p_size AS n, p_partkey % 13 AS page FROM part)
SELECT figure, i, row_number() OVER (PARTITION BY figure ORDER BY blank, CASE WHEN blank THEN 0 ELSE n END, CASE WHEN page = 5 THEN 1000000000 ELSE -page END, i) AS place FROM r
"""


def segmentation_aggregate(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("method"), F.when(F.col("l_discount") > 0.01, F.col("l_discount")).alias("dice"), F.col("l_tax").alias("iou"), F.col("l_quantity").alias("hd95"))
    return C.metric_summary(l, "method", ["dice", "iou", "hd95"]).select("method", "metric", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std")])


SEGMENTATION_AGGREGATE = """
WITH u AS (SELECT l_returnflag AS method, 'dice' AS metric, l_discount AS v FROM lineitem WHERE l_discount > 0.01 UNION ALL SELECT l_returnflag, 'iou', l_tax FROM lineitem UNION ALL SELECT l_returnflag, 'hd95', l_quantity FROM lineitem)
SELECT method, metric, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(stddev_pop(v), 6) AS std FROM u GROUP BY ALL
"""


def metadata_explanations(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", (F.col("p_size") / 50).alias("compat"))
    return p.select("p_partkey", C.explanations(F.lit("ware"), F.col("compat"), F.col("p_brand"), F.col("p_type")).alias("line"))


METADATA_EXPLANATIONS = """SELECT p_partkey, 'ware: ' || p_brand || ' / ' || p_type || ' (' || CASE WHEN p_size / 50 >= 0.90 THEN 'close' WHEN p_size / 50 >= 0.65 THEN 'compatible' ELSE 'different' END || ', ' || printf('%.2f', p_size / 50) || ')' AS line FROM part"""


def upload_guard(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("sha"), F.col("c_nationkey").alias("dpi"), (F.col("c_acctbal") > 0).alias("in_use"))
    up = c.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "new").otherwise(F.col("sha")).alias("sha"), "dpi")
    return Q.upload_refusals(up, c, "c_custkey", ["sha", "dpi"], "in_use").select("c_custkey")


UPLOAD_GUARD = "SELECT c_custkey FROM customer WHERE c_custkey % 6 = 0 AND c_acctbal > 0"


def closing_rule(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") % 4 == 3).alias("closes")).distinct()
    return T.before_closing(c, ["conv_id"], "turn", "closes")


CLOSING_RULE = """
WITH c AS (SELECT DISTINCT conv_id, turn, turn % 4 = 3 AS closes FROM conversations), e AS (SELECT conv_id, min(turn) FILTER (closes) AS stop FROM c GROUP BY conv_id)
SELECT c.conv_id, turn, closes FROM c JOIN e ON c.conv_id = e.conv_id WHERE stop IS NULL OR turn <= stop
"""


def observation_reliability(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    source = F.when(F.col("event_type") == "view", "ocr").when(F.col("event_type") == "click", "model").otherwise("hand")
    r = S.reliability(F.when(F.col("event_id") % 5 == 0, 0.8), F.col("event_id") % 3 == 0, source, F.when(F.col("event_id") % 2 == 0, 0.9))
    value = F.when(F.col("event_id") % 4 == 0, " n/a ").otherwise(F.col("event_type"))
    return e.select("event_id", F.round(F.when(~X.is_empty_value(value), r), 6).alias("reliability"), C.canonical_field(F.when(F.col("event_id") % 2 == 0, " Colour ").otherwise("Rim diameter")).alias("field"))


OBSERVATION_RELIABILITY = """
SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN round((CASE WHEN event_id % 5 = 0 THEN 0.8 WHEN event_id % 3 = 0 THEN 0.90 WHEN event_type IN ('view', 'click') THEN 0.55 ELSE 0.65 END)::DOUBLE * CASE WHEN event_id % 2 = 0 THEN 0.9 ELSE 1.0 END, 6) END AS reliability,
 CASE WHEN event_id % 2 = 0 THEN 'color' ELSE 'diameter' END AS field FROM events
"""


def rank_change(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    w = W.partitionBy("o_custkey")
    a = o.withColumn("rank", F.row_number().over(w.orderBy("o_totalprice", "o_orderkey")))
    b = o.withColumn("rank", F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")))
    return C.rank_change(a, b, ["o_custkey"], "o_orderkey")


RANK_CHANGE = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS moved FROM orders"

QUERIES = {n: f for n, f in list(globals().items()) if n.upper() in globals() and callable(f) and n.islower()}
ORACLE_SQL = {n: globals()[n.upper()] for n in QUERIES}
