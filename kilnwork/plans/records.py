"""Text, similarity and metadata rules over the generated tables. Inputs are expressions that both engines read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.functions import scoring as S
from kilnwork.functions import text as X
from kilnwork.operators import curation as C
from kilnwork.operators import linking as L
from kilnwork.operators import metadata as M
from kilnwork.sources.tables import table

_FIGURES = """CASE p_partkey % 8 WHEN 0 THEN 'Figure 2.' || p_size || 'a' WHEN 1 THEN 'see Abb. 3:' || p_size WHEN 2 THEN 'pl.' || p_size WHEN 3 THEN ' (' || p_brand || ') '
 WHEN 4 THEN 'Plate. 4' WHEN 5 THEN 'fig 1-' || p_size || '-2' WHEN 6 THEN '' ELSE 'b' || p_size || '.1 ' END"""
_NUMBERS = "CASE p_partkey % 7 WHEN 0 THEN 'No. 00' || p_size WHEN 1 THEN ' ' || p_size || 'A.' WHEN 2 THEN '000' WHEN 3 THEN 'no ' || p_brand WHEN 4 THEN '(0' || p_size || ' b)' WHEN 5 THEN '' ELSE p_size || '.5' END"
_FILES = "CASE p_partkey % 4 WHEN 0 THEN p_name || '_3.1-3.50.PNG' WHEN 1 THEN p_name || '.50' WHEN 2 THEN p_name || '.jpeg' ELSE p_name || '.tiff' END"


def identity_rules(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.expr(_FIGURES).alias("f"), F.expr(_NUMBERS).alias("n"), F.expr(_FILES).alias("c"))
    number = X.normalize_number(F.col("n"))
    return p.select("p_partkey", X.strict_figure(F.col("f")).alias("figure"), number.alias("number"), X.is_positive_number(number).alias("positive"), X.card_stem(F.col("c")).alias("stem"), X.page_image_name(F.col("c"), F.col("p_partkey") % 9, F.when(F.col("p_partkey") % 2 == 0, "_left")).alias("image"))


IDENTITY_RULES = rf"""
WITH p AS (SELECT p_partkey, {_FIGURES} AS f, lower(trim({_NUMBERS})) AS n, {_FILES} AS c FROM part),
a AS (SELECT *, regexp_extract(f, '(?i)\b(?:figure|fig\.?|abb\.?|tav\.?|plate|pl\.?)\s*([a-z]?\d+(?:[.:-]\d+)*[a-z]?)', 1) AS found, trim(regexp_replace(regexp_replace(n, '^no\.?\s*', ''), '\s+', '', 'g'), '.,;:()[]') AS m FROM p),
b AS (SELECT *, lower(replace(replace(regexp_replace(trim(trim(CASE WHEN found <> '' THEN found ELSE trim(f) END), '.,;:()[]'), '\s+', '', 'g'), ':', '.'), '-', '.')) AS g,
 CASE WHEN regexp_full_match(m, '0*\d+[a-z]?') THEN CAST(CAST(regexp_extract(m, '^\d+') AS BIGINT) AS VARCHAR) || regexp_extract(m, '[a-z]?$') ELSE m END AS number FROM a)
SELECT p_partkey, CASE WHEN regexp_full_match(g, '[a-z]?\d+(\.\d+)*[a-z]?') THEN g ELSE '' END AS figure, number, regexp_full_match(number, '\d+[a-z]?') AND coalesce(try_cast(regexp_extract(number, '^\d+') AS BIGINT), 0) > 0 AS positive,
 CASE WHEN regexp_matches(lower(c), '\.(png|jpg|jpeg)$') THEN regexp_replace(c, '\.[^.]*$', '') ELSE c END AS stem, c || '_page_' || (p_partkey % 9) || CASE WHEN p_partkey % 2 = 0 THEN '_left' ELSE '' END || '.jpg' AS image FROM b
"""

_PAGES = """CASE p_partkey % 6 WHEN 0 THEN 'IRON AGE   ' || p_size || chr(10) || 'x 3.5' WHEN 1 THEN 'A B' || chr(10) || ' ' || p_size || ' ' || chr(10) || 'UPPER TOWN 7' WHEN 2 THEN 'see 3.5 and p. ' || p_size || ', 12345'
 WHEN 3 THEN 'text' || chr(10) || p_size || ' LATE ROMAN' || chr(10) || 'CAPS 9 x' WHEN 4 THEN 'nothing' ELSE '1.2' || chr(10) || chr(10) || 'a' || p_size || 'b' END"""


def printed_pages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.expr(_PAGES.replace("chr(", "char(")).alias("t"))
    return p.select("p_partkey", X.printed_page(F.col("t")).alias("page"))


PRINTED_PAGES = rf"""
WITH p AS (SELECT p_partkey, list_filter(list_transform(string_split({_PAGES}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM part), e AS (SELECT p_partkey, list_concat(l[1:6], l[-6:]) AS l FROM p),
k AS (SELECT p_partkey, list_filter(l, lambda x: regexp_full_match(x, '\d{{1,4}}')) AS a,
 list_filter(list_transform(l, lambda x: regexp_extract(x, '^[A-Z][A-Z ]{{2,}}\s+(\d{{1,4}})$', 1) || regexp_extract(x, '^(\d{{1,4}})\s+[A-Z][A-Z ]{{2,}}$', 1)), lambda x: x <> '') AS b,
 list_filter(list_transform(l, lambda x: regexp_extract(x, '(?:^|[^.0-9])(\d{{1,4}})(?:$|[^.0-9])', 1)), lambda x: x <> '') AS c FROM e)
SELECT p_partkey, coalesce(a[1], b[1], c[1], '') AS page FROM k
"""

_BOXES = "CASE l_linenumber % 3 WHEN 0 THEN '[' || l_orderkey || ', ' || l_partkey || '.9, 7.5, -3.7]' WHEN 1 THEN l_orderkey || ' x ' || l_suppkey ELSE '(1.99; 2; 3 / ' || l_linenumber || ')' END"


def box_parse(spark: SparkSession, d: str) -> DataFrame:
    box = X.parse_box(F.expr(_BOXES))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[box[c].cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")], X.box_fingerprint(F.lit("page.jpg"), box).alias("fingerprint"))


BOX_PARSE = rf"""
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem), n AS (SELECT *, list_transform(regexp_extract_all({_BOXES}, '-?\d+(?:\.\d+)?'), lambda x: CAST(trunc(CAST(x AS DOUBLE)) AS BIGINT)) AS b FROM l),
o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN len(b) = 4 THEN b END AS b FROM n)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, b[1] AS x1, b[2] AS y1, b[3] AS x2, b[4] AS y2, substr(sha256('page.jpg|' || b[1] || ',' || b[2] || ',' || b[3] || ',' || b[4]), 1, 16) AS fingerprint FROM o
"""

_NAMES = "CASE p_partkey % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'A' WHEN 2 THEN 'a-2' WHEN 3 THEN p_name ELSE p_brand || '-' || (p_size % 3) END"


def export_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.expr(_NAMES).alias("base"))
    return L.unique_names(p, "base", ["p_partkey"]).select("p_partkey", "base", "name")


EXPORT_NAMES = f"""
WITH RECURSIVE p AS (SELECT p_partkey, {_NAMES} AS base, row_number() OVER (ORDER BY p_partkey) AS n FROM part),
r(n, p_partkey, base, name, seen) AS (
 SELECT n, p_partkey, base, base, [lower(base)] FROM p WHERE n = 1
 UNION ALL SELECT x.n, x.p_partkey, x.base, x.name, list_append(x.seen, lower(x.name)) FROM (
  SELECT p.n, p.p_partkey, p.base, r.seen, CASE WHEN NOT list_contains(r.seen, lower(p.base)) THEN p.base ELSE p.base || '-' || list_filter(range(2, 5000), lambda k: NOT list_contains(r.seen, lower(p.base) || '-' || k))[1] END AS name
  FROM r JOIN p ON p.n = r.n + 1) x)
SELECT p_partkey, base, name FROM r
"""

_PIECES = "CASE p_partkey % 6 WHEN 0 THEN 'nan' WHEN 1 THEN '2.' || p_size || ' a' WHEN 2 THEN '--' WHEN 3 THEN p_brand || '--x ' WHEN 4 THEN 'None' ELSE p_name || '?!' END"
_CELLS = "CASE p_partkey % 6 WHEN 0 THEN '=SUM(1)' WHEN 1 THEN '-' || p_size WHEN 2 THEN '@' || p_name WHEN 3 THEN '+1' ELSE p_name END"
_ROWS = "CASE p_partkey % 6 WHEN 0 THEN '  ' || p_size || 'b Pithos' WHEN 1 THEN p_size || 'Pithos' WHEN 2 THEN p_size || '.5 x' WHEN 3 THEN '12345' WHEN 4 THEN p_name ELSE p_size || 'ab' END"
_PROMPTS = "'add [' || p_brand || '] and [ Scale ], [] [Scale] not [' || p_name || ' ]'"


def cell_texts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    e = F.expr
    return p.select(
        "p_partkey", X.safe_piece(e(_PIECES), "Unknown").alias("piece"), X.clean_text(e(_PIECES)).alias("clean"), X.formula_guard(e(_CELLS)).alias("cell"), X.leading_number(e(_ROWS)).alias("leading"),
        F.concat_ws("|", X.bracket_fields(e(_PROMPTS))).alias("fields"), X.field_key(e(_PIECES)).alias("key"), X.first_number(F.concat(F.lit("ca. "), F.col("p_size").cast("string"), F.lit(",25 cm"))).alias("number"),
        F.concat_ws("|", X.token_set(F.concat(F.col("p_brand"), F.lit(" 2.5 fs/"), F.col("p_type")))).alias("tokens"), X.is_empty_value(F.expr("CASE p_partkey % 4 WHEN 0 THEN ' n/a ' WHEN 1 THEN '**' WHEN 2 THEN 'nan' ELSE '' END")).alias("empty"),
    )


CELL_TEXTS = rf"""
WITH p AS (SELECT p_partkey, p_size, p_brand, p_type, {_PIECES} AS a, {_CELLS} AS c, {_ROWS} AS r, {_PROMPTS} AS q FROM part), k AS (SELECT *, CASE WHEN a IN ('nan', 'None') THEN '' ELSE a END AS clean FROM p),
m AS (SELECT *, trim(regexp_replace(replace(clean, '.', '-'), '[^A-Za-z0-9-]+', '-', 'g'), '-') AS piece, list_filter(list_transform(regexp_extract_all(q, '\[([^\[\]]+)\]', 1), lambda x: trim(x)), lambda x: x <> '') AS f,
 regexp_extract(r, '(?i)^\s*(\d{{1,3}}[a-z]?)\b', 1) AS w, regexp_extract_all(upper(p_brand || ' 2.5 fs/' || p_type), '[A-Z]+|\d+(?:\.\d+)?') AS t FROM k)
SELECT p_partkey, CASE WHEN piece = '' THEN 'Unknown' ELSE piece END AS piece, clean, CASE WHEN substr(c, 1, 1) IN ('=', '+', '-', '@') THEN '''' || c ELSE c END AS cell,
 CASE WHEN w <> '' THEN w ELSE regexp_extract(r, '^\s*(\d{{1,3}})[A-Z]', 1) END AS leading, array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), '|') AS fields, regexp_replace(lower(a), '[^a-z0-9]', '', 'g') AS key,
 CAST(p_size || '.25' AS DOUBLE) AS number, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), '|') AS tokens, p_partkey % 4 IN (0, 1, 3) AS empty FROM m
"""

_HEADS = "CASE p_partkey % 5 WHEN 0 THEN 'No. Type Sq. Loc. Pail Reg. Exterior/Core' WHEN 1 THEN 'No Type Fabric  Color, Non-Plastics, Voids; Man. Ty/Sz Den' WHEN 2 THEN 'Type Sq Loc Pail Reg Exterior Core' WHEN 3 THEN 'no type decor fire man int' ELSE p_name END"


def headers_expected(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", C.header_expected(F.expr(_HEADS)).alias("expected"))


HEADERS_EXPECTED = rf"""
WITH p AS (SELECT p_partkey, trim(regexp_replace(lower({_HEADS}), '[^a-z0-9]+', ' ', 'g')) AS t FROM part)
SELECT p_partkey, regexp_matches(t, '\bno\b') AND regexp_matches(t, '\btype\b')
 AND len(list_filter(['\bsq\b', '\bloc\b', '\bpail\b', '\breg\b', 'fabric\s+color', 'non\s+plastics', '\bvoids?\b', '\bman\b', 'surface\s+treatment', '\bdecor\b', '\bfire\b'], lambda x: regexp_matches(t, x))) >= 4
 AND len(list_filter(['\bexterior\b', '\bcore\b', '\binterior\b', '\btyp\b', '\bsiz\b', '\bshap\b', '\bden\b', 'ty\s*sz', '\bext\b', '\bint\b'], lambda x: regexp_matches(t, x))) >= 2 AS expected FROM p
"""


def ocr_texts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", C.printable_ascii(F.concat(F.lit(" "), F.col("text"), F.lit("é漢\t!\r"))).alias("shown"))


OCR_TEXTS = r"""
SELECT conv_id, turn, trim(regexp_replace(' ' || text || 'é漢' || chr(9) || '!' || chr(13), '[^\x20-\x7E\n\t]', '', 'g'), ' ' || chr(9) || chr(10)) AS shown FROM conversations
"""

_ANSWERS = """CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN 'Here: ' || replace(props, '}', ',}') || ' done' WHEN 2 THEN '{"k": [{"a": 1}, {"a": ' WHEN 3 THEN 'no answer' ELSE '{"a": "x", "b": [1, 2,], }' END"""


def model_answers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    a = C.repaired_json(F.expr(_ANSWERS))
    return e.select("event_id", F.get_json_object(a, "$.k").alias("k"), F.get_json_object(a, "$.b[1]").alias("b"), a.isNull().alias("none"))


MODEL_ANSWERS = """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN json_extract_string(props, '$.k') WHEN 1 THEN json_extract_string(props, '$.k') WHEN 2 THEN '[{"a":1}]' END AS k, CASE WHEN event_id % 5 = 4 THEN '2' END AS b, event_id % 5 = 3 AS none FROM events
"""


def name_ids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", X.uuid5("6ba7b8109dad11d180b400c04fd430c8", F.concat(F.col("c_name"), F.lit(":"), F.col("c_nationkey").cast("string"))).alias("id"))


NAME_IDS = """
WITH h AS (SELECT c_custkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(c_name || ':' || c_nationkey)) AS h FROM customer)
SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h
"""


def split_donors(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "nation").select(F.col("n_name").alias("key"))
    return L.split_with_donors(keys, "key")


SPLIT_DONORS = """
WITH k AS (SELECT DISTINCT n_name AS key, CAST('0x' || substr(sha256(n_name), 1, 8) AS BIGINT) % 10 AS n FROM nation), p AS (SELECT key, CASE WHEN n < 8 THEN 'train' WHEN n = 8 THEN 'validation' ELSE 'test' END AS part FROM k),
c AS (SELECT count(*) FILTER (part = 'train') AS a, count(*) FILTER (part = 'validation') AS v, count(*) FILTER (part = 'test') AS t FROM p),
r AS (SELECT key, part, row_number() OVER (PARTITION BY part ORDER BY key DESC) AS nth FROM p)
SELECT key, CASE WHEN a + v + t < 10 THEN part WHEN part = 'train' AND a >= t AND v = 0 AND nth = 1 THEN 'validation' WHEN part = 'train' AND t = 0 AND nth = CASE WHEN v = 0 THEN 2 ELSE 1 END THEN 'test' ELSE part END AS part FROM r, c
"""

_COLOURS = """CASE {k} % 9 WHEN 0 THEN (2.5 * ({k} % 4 + 1)) || 'YR ' || ({k} % 8 + 1) || '/' || ({k} % 7) WHEN 1 THEN 'Very dark grey' WHEN 2 THEN 'reddish brown 5YR 4/4' WHEN 3 THEN 'pale yellow' WHEN 4 THEN 'reddish yellow'
 WHEN 5 THEN 'strange 12' WHEN 6 THEN 'pinkish white' WHEN 7 THEN '5R ' || ({k} % 5 + 2) || '.5/ ' || ({k} % 4) ELSE 'light red' END"""
#: SQL of a colour comparison: from rows (key columns, a, b) in x to (key columns, compat).
_COLOUR_SQL = r"""
 c0 AS (SELECT *, trim(regexp_replace(upper(a), '\s+', ' ', 'g')) AS ua, trim(regexp_replace(upper(b), '\s+', ' ', 'g')) AS ub,
  trim(regexp_replace(regexp_replace(replace(lower(a), 'grey', 'gray'), '\b\d+(?:\.\d+)?\s*(?:yr|gy|bg|pb|rp|r|y|g|b|p)\s*\d+(?:\.\d+)?\s*/\s*\d+(?:\.\d+)?\b', ' ', 'g'), '[^a-z]+', ' ', 'g')) AS na,
  trim(regexp_replace(regexp_replace(replace(lower(b), 'grey', 'gray'), '\b\d+(?:\.\d+)?\s*(?:yr|gy|bg|pb|rp|r|y|g|b|p)\s*\d+(?:\.\d+)?\s*/\s*\d+(?:\.\d+)?\b', ' ', 'g'), '[^a-z]+', ' ', 'g')) AS nb FROM x),
 c1 AS (SELECT *, regexp_extract(ua, '(\d+(?:\.\d+)?)\s*(YR|GY|BG|PB|RP|R|Y|G|B|P)\s+(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)', ['n', 'h', 'v', 'c']) AS ca, regexp_extract(ub, '(\d+(?:\.\d+)?)\s*(YR|GY|BG|PB|RP|R|Y|G|B|P)\s+(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)', ['n', 'h', 'v', 'c']) AS cb FROM c0),
 c2 AS (SELECT *, (list_position(['R', 'YR', 'Y', 'GY', 'G', 'BG', 'B', 'PB', 'P', 'RP'], ca.h) - 1 + try_cast(ca.n AS DOUBLE) / 10) % 10 AS ha, (list_position(['R', 'YR', 'Y', 'GY', 'G', 'BG', 'B', 'PB', 'P', 'RP'], cb.h) - 1 + try_cast(cb.n AS DOUBLE) / 10) % 10 AS hb,
  list_transform([na, nb], lambda t: {'f': CASE WHEN regexp_matches(t, 'white|gray|black') THEN 'neutral' WHEN regexp_matches(t, 'reddish brown|red brown') THEN 'reddish_brown' WHEN contains(t, 'brown') THEN 'brown' WHEN contains(t, 'pink') THEN 'pink'
    WHEN contains(t, 'red') AND contains(t, 'yellow') THEN 'red_yellow' WHEN contains(t, 'red') THEN 'red' WHEN regexp_matches(t, 'yellow|buff') THEN 'yellow' END,
   'l': CASE WHEN regexp_matches(t, 'very dark|black') THEN 2 WHEN contains(t, 'dark') THEN 1 WHEN regexp_matches(t, 'white|very pale') THEN 4 WHEN regexp_matches(t, 'light|pale') THEN 3 ELSE 2 END,
   's': CASE WHEN regexp_matches(t, 'gray|white|black') THEN 'neutral' WHEN regexp_matches(t, 'weak|pale') THEN 'weak' ELSE 'normal' END,
   't': CASE WHEN contains(t, 'pink') THEN 'pink' WHEN contains(t, 'red') THEN 'red' WHEN contains(t, 'brown') THEN 'brown' WHEN contains(t, 'yellow') THEN 'yellow' END}) AS z FROM c1),
 c3 AS (SELECT *, CASE WHEN z[1].f = z[2].f THEN 1.0::DOUBLE WHEN z[1].f = 'neutral' THEN CASE WHEN z[1].t = z[2].f THEN 0.48 ELSE 0.22 END WHEN z[2].f = 'neutral' THEN CASE WHEN z[2].t = z[1].f THEN 0.48 ELSE 0.22 END
   ELSE coalesce(map {'pink/red': 0.82, 'pink/reddish_brown': 0.62, 'red/reddish_brown': 0.82, 'red/red_yellow': 0.82, 'brown/reddish_brown': 0.86, 'red_yellow/reddish_brown': 0.68, 'brown/yellow': 0.64, 'red_yellow/yellow': 0.82}[least(z[1].f, z[2].f) || '/' || greatest(z[1].f, z[2].f)], 0.20) END AS fam,
  least(abs(ha - hb), 10 - abs(ha - hb)) AS gap, regexp_extract_all(upper(a), '[A-Z]+|\d+(?:\.\d+)?') AS ta, regexp_extract_all(upper(b), '[A-Z]+|\d+(?:\.\d+)?') AS tb FROM c2),
 c4 AS (SELECT *, 0.68 * fam + 0.22 * [1.0, 0.82, 0.58, 0.34, 0.18][abs(z[1].l - z[2].l) + 1]::DOUBLE + 0.10 * CASE WHEN z[1].s = z[2].s THEN 1.0 WHEN 'normal' IN (z[1].s, z[2].s) THEN 0.78 ELSE 0.55 END AS named FROM c3),
 coloured AS (SELECT *, CASE WHEN ca.h <> '' AND cb.h <> '' THEN 0.40 / (1 + pow(gap / 0.25 / 2.0, 2)) + 0.25 / (1 + pow((try_cast(ca.v AS DOUBLE) - try_cast(cb.v AS DOUBLE)) / 1.5, 2)) + 0.35 / (1 + pow((try_cast(ca.c AS DOUBLE) - try_cast(cb.c AS DOUBLE)) / 2.5, 2))
   WHEN z[1].f IS NOT NULL AND z[2].f IS NOT NULL THEN CASE WHEN na = nb THEN greatest(named, 0.96) ELSE named END
   ELSE 0.35 + 0.5 * len(list_intersect(ta, tb)) / greatest(1, len(list_distinct(list_concat(ta, tb)))) END AS compat FROM c4)
"""


def colour_similarities(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    a, b = F.expr(_COLOURS.format(k="p_partkey")), F.expr(_COLOURS.format(k="(p_partkey * 7 + p_size)"))
    chip = S.munsell(a)
    label = S.munsell_labels(chip)
    return p.select("p_partkey", F.round(S.colour_similarity(a, b), 6).alias("compat"), S.colour_name(a)["family"].alias("family"), label["hue"].alias("hue_label"), label["lightness"].alias("light_label"), label["saturation"].alias("vivid_label"))


COLOUR_SIMILARITIES = (
    f"WITH x AS (SELECT p_partkey, {_COLOURS.format(k='p_partkey')} AS a, {_COLOURS.format(k='(p_partkey * 7 + p_size)')} AS b FROM part),"
    + _COLOUR_SQL
    + """SELECT p_partkey, round(compat, 6) AS compat, z[1].f AS family,
 CASE WHEN ca.h <> '' THEN list_sort(list_transform([{'c': 1.00, 'n': 'R/10R'}, {'c': 1.25, 'n': '2.5YR'}, {'c': 1.50, 'n': '5YR'}, {'c': 1.75, 'n': '7.5YR'}, {'c': 2.10, 'n': '10YR/Y'}], lambda q, i: {'gap': abs(ha - q.c::DOUBLE), 'i': i, 'n': q.n}))[1].n END AS hue_label,
 CASE WHEN ca.h <> '' THEN CASE WHEN try_cast(ca.v AS DOUBLE) < 5 THEN 'dark' WHEN try_cast(ca.v AS DOUBLE) < 6.5 THEN 'middle' WHEN try_cast(ca.v AS DOUBLE) < 7.5 THEN 'light' ELSE 'very light' END END AS light_label,
 CASE WHEN ca.h <> '' THEN CASE WHEN try_cast(ca.c AS DOUBLE) <= 2 THEN 'muted' WHEN try_cast(ca.c AS DOUBLE) <= 4 THEN 'moderate' ELSE 'strong' END END AS vivid_label FROM coloured"""
)

#: A part's metadata: field, comparison, group, weight, value.
_META = [
    ("vessel_type", "categorical", "classification", 1.20, "CASE WHEN {k} % 7 = 0 THEN ' n/a ' ELSE {p}p_name END"),
    ("rim_diameter_cm", "diameter", "measurement", 1.65, "CASE WHEN {k} % 11 = 0 THEN '0' WHEN {k} % 13 = 0 THEN 'wide' ELSE {p}p_size || ',5 cm' END"),
    ("fabric_exterior", "colour", "colour", 0.65, "(" + _COLOURS + ")"),
    ("fabric_core", "colour", "colour", 0.80, "CASE WHEN {k} % 3 = 0 THEN 'light red' WHEN {k} % 3 = 1 THEN '?' ELSE 'pink' END"),
    ("nonplastics_size", "size", "inclusions", 0.65, "CAST({k} % 9 AS VARCHAR(9))"),
    ("nonplastics_density", "density", "inclusions", 0.70, "CASE {k} % 6 WHEN 0 THEN 'VL' WHEN 1 THEN 'L' WHEN 2 THEN 'm' WHEN 3 THEN 'MH' WHEN 4 THEN 'H' ELSE 'X' END"),
    ("voids_type_size", "void", "voids", 0.65, "CASE {k} % 4 WHEN 0 THEN 'FS ' || ({k} % 8) WHEN 1 THEN 'FS,FC' WHEN 2 THEN '3' ELSE 'PR 9' END"),
    ("manufacture", "categorical", "technology", 0.85, "{p}p_brand"),
]
_PAIRS = "q.p_partkey % 20 = 0 AND q.p_partkey <> r.p_partkey AND r.p_partkey BETWEEN q.p_partkey AND q.p_partkey + 19"


def _metadata(p: str) -> Column:
    """The metadata map of a part, a struct; keys tell how sure its values are."""
    k = f"{p}.p_partkey"
    entry = lambda value: f"struct({value} AS value, CASE WHEN {k} % 4 = 1 THEN 0.8D END AS reliability, CASE WHEN {k} % 5 = 0 THEN 4.0D END AS uncertainty, CASE WHEN {k} % 5 = 0 THEN 'ocr' ELSE 'hand' END AS source, {k} % 3 = 0 AS reviewed)"
    return F.expr("map(" + ", ".join(f"'{n}', {entry(v.format(k=k, p=f'{p}.'))}" for n, _, _, _, v in _META) + ")")


def compare_metadata(spark: SparkSession, d: str) -> DataFrame:
    # Twenty neighbours by key: each query meets a bounded number of references. Parts meet by a shuffle and get their
    # maps, many times as large, as pairs: the planner takes the files' size for that of either side and would broadcast it.
    p = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 20).alias("block"), F.struct("p_partkey", "p_name", "p_brand", "p_size").alias("r"))
    queries = p.where("r.p_partkey % 20 = 0").withColumnRenamed("r", "q")
    pairs = queries.hint("merge").join(p, "block").where("q.p_partkey <> r.p_partkey").select("q", "r", _metadata("q").alias("a"), _metadata("r").alias("b"))
    fields = pairs.select(F.col("q.p_partkey").alias("query_id"), F.col("r.p_partkey").alias("ref_id"), M.compare(F.col("a"), F.col("b")).alias("fields"))
    return fields.select("query_id", "ref_id", *[c.alias(n) for n, c in M.summary(F.col("fields")).items()])


_LONG = " UNION ALL ".join(
    f"SELECT q.p_partkey AS query_id, r.p_partkey AS ref_id, '{n}' AS field, '{kind}' AS kind, '{g}' AS grp, {w}::DOUBLE AS weight, {v.format(k='q.p_partkey', p='q.')} AS a, {v.format(k='r.p_partkey', p='r.')} AS b FROM part q JOIN part r ON {_PAIRS}"
    for n, kind, g, w, v in _META
)
_RELIABLE = "CASE WHEN {k} % 4 = 1 THEN 0.8 WHEN {k} % 3 = 0 THEN 0.90 WHEN {k} % 5 = 0 THEN 0.55 ELSE 0.65 END::DOUBLE"
COMPARE_METADATA = (
    f"WITH v AS ({_LONG}), x AS (SELECT *, {_RELIABLE.format(k='query_id')} AS ra, {_RELIABLE.format(k='ref_id')} AS rb FROM v WHERE upper(trim(a)) NOT IN ('', '-', '--', '?', 'N/A', 'NA', 'NONE', 'NULL', 'UNKNOWN', '*', '**') AND upper(trim(b)) NOT IN ('', '-', '--', '?', 'N/A', 'NA', 'NONE', 'NULL', 'UNKNOWN', '*', '**')),"
    + _COLOUR_SQL
    + r""",
 n AS (SELECT *, try_cast(replace(regexp_extract(replace(a, ',', '.'), '-?\d+(?:\.\d+)?'), ',', '.') AS DOUBLE) AS da, try_cast(regexp_extract(replace(b, ',', '.'), '-?\d+(?:\.\d+)?') AS DOUBLE) AS db,
  CASE WHEN query_id % 5 = 0 THEN 4.0 ELSE 1.5 END::DOUBLE AS sa, CASE WHEN ref_id % 5 = 0 THEN 4.0 ELSE 0.75 END::DOUBLE AS sb,
  CASE kind WHEN 'density' THEN map {'VL': 1, 'L': 2, 'M': 3, 'MH': 4, 'H': 5} ELSE map {'1': 1, '2': 2, '3': 3, '4': 4, '5': 5, '6': 6, '7': 7} END AS ranked FROM coloured),
 o AS (SELECT *, list_filter(list_transform(ta, lambda t: ranked[t]), lambda t: t IS NOT NULL) AS oa, list_filter(list_transform(tb, lambda t: ranked[t]), lambda t: t IS NOT NULL) AS ob, list_intersect(ta, ['FS', 'FC', 'PR', 'PA', 'JR', 'JH', 'JB', 'JD']) AS va, list_intersect(tb, ['FS', 'FC', 'PR', 'PA', 'JR', 'JH', 'JB', 'JD']) AS vb FROM n),
 p AS (SELECT *, coalesce(1 / (1 + pow(list_min(flatten(list_transform(oa, lambda s: list_transform(ob, lambda t: abs(s - t))))) / 1.25::DOUBLE, 2)), 0.5) AS ordinal, CASE WHEN len(ta) > 0 AND len(tb) > 0 THEN 0.12 + 0.88 * len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) ELSE 0.5 END AS categorical,
  CASE WHEN da > 0 AND db > 0 THEN 1 / (1 + pow(abs(da - db) / greatest(6.0, 0.3 * (da + db) / 2, 2.5 * sqrt(sa * sa + sb * sb)), 4)) ELSE 0.5 END AS diameter, CASE WHEN len(va) > 0 AND len(vb) > 0 THEN len(list_intersect(va, vb)) / len(list_distinct(list_concat(va, vb))) ELSE 0.5 END AS kinds FROM o),
 f AS (SELECT query_id, ref_id, grp, weight * sqrt(ra * rb) AS s, CASE kind WHEN 'colour' THEN compat WHEN 'categorical' THEN categorical WHEN 'diameter' THEN diameter WHEN 'void' THEN 0.65 * kinds + 0.35 * ordinal ELSE ordinal END AS c FROM p),
 e AS (SELECT query_id, ref_id, grp, 4 * tanh(sum(greatest(-2.8, least(2.8, sign(2 * c - 1) * pow(abs(2 * c - 1), 1.35) * s * 2))) / 4) AS ev, sum((1 - c) * s) / sum(s) AS cost, max(s) AS top, sum(s) AS s, count(*) AS n FROM f GROUP BY ALL)
SELECT query_id, ref_id, round(sum(ev), 6) AS evidence, round(sum(s) / 13.70, 6) AS coverage, CAST(sum(n) AS BIGINT) AS compared_fields, round(sum(s), 6) AS evidence_strength, round(sum(top), 6) AS metadata_strength, round(sum(cost * top) / sum(top), 6) AS metadata_cost FROM e GROUP BY ALL
"""
)


def score_terms(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    terms = {"fgw": S.bounded_score(F.col("l_discount"), 0.05), "ribbon": F.col("l_tax"), "salience": S.soft_distance(F.col("l_quantity"), 10.0), "tail": F.col("l_discount"), "rim": F.lit(0.5), "transform": S.hypothesis_reliability(F.col("l_tax"), F.lit(0.0), F.col("l_discount"), F.lit(0.2)), "completeness": S.completeness_penalty(F.col("l_quantity") / 40)}
    scored = l.withColumns({"overall": S.weighted_overall(terms), "rank_score": S.rank_score(F.col("l_quantity"), F.col("l_quantity") + 7, F.lit(400)), "ordinal": S.ordinal_similarity(S.ranks(F.array(F.floor(F.col("l_quantity") / 10).cast("string")), "size"), F.array(F.lit(3)))})
    return scored.groupBy("l_orderkey").agg(*[F.round(F.sum(c), 8).alias(c) for c in ("overall", "rank_score", "ordinal")])


SCORE_TERMS = """
WITH l AS (SELECT *, l_discount / (l_discount + 0.05) AS a, 1 / (1 + pow(l_quantity / 10, 2)) AS s, 0.60 * l_tax + 0.10 * l_discount + 0.15 * 0.2 AS t, pow(1 - least(1, l_quantity / 40), 2) AS c, floor(l_quantity / 10) AS z FROM lineitem)
SELECT l_orderkey, round(sum(0.31 * a + 0.26 * l_tax + 0.13 * s + 0.08 * l_discount + 0.10 * 0.5 + 0.06 * t + 0.06 * c), 8) AS overall, round(sum(0.75 * l_quantity / 400 + 0.25 * (2 * l_quantity + 7) / 800), 8) AS rank_score, round(sum(CASE WHEN z BETWEEN 1 AND 7 THEN 1 / (1 + pow((z - 3) / 1.25, 2)) ELSE 0.5 END), 8) AS ordinal FROM l GROUP BY l_orderkey
"""


def hypothesis_instability(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_discount", "l_tax")).alias("h"))
    part = lambda f: F.transform("h", f)
    return l.select("l_orderkey", F.round(S.instability(part(lambda h: h["l_quantity"]), part(lambda h: h["l_discount"] + 0.5), part(lambda h: h["l_tax"])), 6).alias("instability"))


HYPOTHESIS_INSTABILITY = """
WITH s AS (SELECT l_orderkey, count(*) AS n, stddev_pop(l_quantity) AS a, stddev_pop(ln(l_discount + 0.5)) AS b, stddev_pop(l_tax) AS c FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, round(CASE WHEN n > 1 THEN (a / (a + 10) + b / (b + 0.15) + c / (c + 0.05)) / 3 ELSE 0 END, 6) AS instability FROM s
"""

QUERIES = {n: f for n, f in list(globals().items()) if n.upper() in globals() and callable(f) and n.islower() and not n.startswith("_")}
ORACLE_SQL = {n: globals()[n.upper()] for n in QUERIES}
