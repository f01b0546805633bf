"""The queries of this subpackage over the generated tables, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.llm import bpe, decontaminate, fingerprint, licenses, lm_score, near_dedup, quality, secrets, toxicity, url_filter

#: Listed hosts and paths (fixed values).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]



def tokenizer_path(spark: SparkSession) -> str:
    """The tokenizer's file on every machine: spark.kilnwork.tokenizer, or the installed public one."""
    found = spark.conf.get("spark.kilnwork.tokenizer", None)
    if found:
        return found
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item that overlap, with the best stretch."""
    return decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
WITH dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
bw AS (SELECT item_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS q FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)),
hits AS (SELECT doc_id, item_id, p - q AS g, p, CASE WHEN n < 7 THEN n ELSE greatest(7, least(13, ceil(0.7 * n))) END AS needed FROM dw JOIN bw ON dw.word = bw.word),
-- Every diagonal with enough equal words; the score before its j-th equal word, and the lowest of those so far.
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, g ORDER BY p) AS j, count(*) OVER (PARTITION BY doc_id, item_id, g) AS n FROM hits),
s AS (SELECT *, 2.5::DOUBLE * (j - 1) - 1.5::DOUBLE * (p - greatest(0, g)) AS before FROM k WHERE n >= needed),
l AS (SELECT *, min({'b': before, 'i': j, 'p': p}) OVER (PARTITION BY doc_id, item_id, g ORDER BY p ROWS UNBOUNDED PRECEDING) AS low FROM s),
best AS (SELECT doc_id, item_id, needed, g, min({'s': low.b - before - 1, 'j': j, 'i': low.i, 'first': low.p, 'end': p + 1}) AS m FROM l GROUP BY ALL),
r AS (SELECT doc_id, item_id, min({'e': m.i - m.j - 1, 'first': m.first, 'end': m.end}) AS m FROM best WHERE m.j - m.i + 1 >= needed GROUP BY ALL)
SELECT doc_id, item_id, CAST(-m.e AS BIGINT) AS n_equal, m.first AS first_word, m.end AS end_word, -m.e / (m.end - m.first) AS share FROM r
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's toxicity, learnt from the labelled rows that aren't held out."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's host, path, longest fitting rule and verdict."""
    listed = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN NULL ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), cut AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts
), rules(rule_host, rule_path, said) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT page_id, rule_host || rule_path AS rule, said,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS nth
  FROM cut JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT c.page_id, c.host, c.path, f.rule, coalesce(f.said, 'allow') AS verdict
FROM cut c LEFT JOIN fits f ON c.page_id = f.page_id AND f.nth = 1
"""

def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's set size, the smallest id of its near-duplicate group, and whether it is that one."""
    return near_dedup.groups(_table(spark, sf_dir, "documents"), near_dedup.AT_85)


OP4_SQL = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM tokens
), sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
 flat AS (SELECT doc_id, unnest(s) AS g FROM sets),
 common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM flat x JOIN flat y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
 links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
 both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach AS (SELECT doc_id AS start, doc_id AS at FROM sizes UNION SELECT r.start, e.b FROM reach r JOIN both_ways e ON e.a = r.at)
SELECT n.doc_id, n.n AS n_shingles, min(r.at) AS component_id, n.doc_id = min(r.at) AS kept
FROM sizes n JOIN reach r ON r.start = n.doc_id GROUP BY n.doc_id, n.n
"""


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of their decoding."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest_documents(docs, tokenizer_path(spark), keep=["doc_id"])


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint, held against its edited text's and the next document's."""
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's places of licence phrases and its labels."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


#: Documents of this grade, with at least this probability, pass.
QUALITY_GRADE, QUALITY_LEAST = 1, 0.5


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's expected grade, probability of a good one, and whether it passes."""
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")), QUALITY_GRADE, QUALITY_LEAST)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's pseudo-likelihood under a network trained on all documents."""
    docs = _table(spark, sf_dir, "documents")
    return lm_score.score(docs, lm_score.train(docs))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's secrets by key pattern and by guess cost."""
    return secrets.scan(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op4_near_dedup": op4_near_dedup,
    "op5_bpe": op5_bpe,
    "op6_license_scan": op6_license_scan,
    "op7_quality": op7_quality,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_secret_scan": op9_secret_scan,
    "op10_fingerprints": op10_fingerprints,
    "op2_toxicity": op2_toxicity,
    "op3_url_filter": op3_url_filter,
}
ORACLE_SQL = {
    "op1_decontamination": OP1_SQL,
    "op3_url_filter": OP3_SQL,
    "op4_near_dedup": OP4_SQL,
}
