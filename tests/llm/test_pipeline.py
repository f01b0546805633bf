import re

import duckdb
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from kilnwork.llm import quality
from kilnwork.llm.registry import QUALITY_GRADE, QUALITY_LEAST, tokenizer_path
from test_decontaminate import brute as overlapping
from test_near_dedup import sets_of
from test_secrets import brute as secret_spans

SF = "/root/testdata/sf0.001"


def expected(library):
    """Each stage by the plainest means: all pairs, all diagonals, plain patterns, the library."""
    con = duckdb.connect()
    docs = con.sql(f"select doc_id, text, lang, source, n_chars from '{SF}/documents.parquet' order by doc_id").fetchall()
    labels = dict(con.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    known = [(t, float(labels[d])) for d, t, *_ in docs if d in labels]
    return docs, known, con.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()


def test_against_brute_force(spark):
    library = Tokenizer.from_file(tokenizer_path(spark))
    docs, known, items = expected(library)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(table, spark.read.parquet(f"{SF}/labels.parquet"))
    # The fit's rows come in another order, so its weights are the same but for rounding.
    own = quality.fit([t for t, _ in known], [g for _, g in known])
    p = own.tail(own.above(quality.features(pa.array([t for _, t, *_ in docs]))), QUALITY_GRADE)
    q = model.tail(model.above(quality.features(pa.array([t for _, t, *_ in docs]))), QUALITY_GRADE)
    assert abs(p - q).max() < 1e-6
    docs = [d for d, x in zip(docs, p, strict=True) if x >= QUALITY_LEAST]
    sets = [sets_of(t) for _, t, *_ in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    docs = [d for i, d in enumerate(docs) if root[i] == i]
    dirty = {d for d, *_ in overlapping([(d, t) for d, t, *_ in docs], items)}
    docs = [d for d in docs if d[0] not in dirty]
    out = []
    for d, t, lang, source, _ in docs:
        spans = sorted((int(a), int(b)) for a, b in re.findall(r"\w+:(\d+):(\d+)", secret_spans(t)))
        for a, b in reversed([s for s in spans if not any(x <= s[0] and s[1] <= y and (x, y) != s for x, y in spans)]):
            t = t[:a] + "[SECRET]" + t[b:]
        ids = library.encode(t, add_special_tokens=False).ids
        out.append((d, lang, source, ids, len(ids)))
    got = [(r.doc_id, r.lang, r.source, list(r.token_ids), r.n_tokens) for r in corpus_pipeline.run(spark, SF).orderBy("doc_id").collect()]
    assert len(got) < 200 and got == out


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_and_bear_odd_rows(spark, name):
    rows = [(1, None, "en", "s", None), (1, None, "en", "s", None), (None, "", None, None, 0), (3, "a b c " * 40, "en", "s", 9), (4, "x" * 60_000, "en", "s", 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns and got.count() <= len(rows)
    assert stage(spark, docs.limit(0), SF).count() == 0
