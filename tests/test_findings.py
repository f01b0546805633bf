"""Small cases of what went wrong over larger tables."""

import random
import time

import duckdb
import numpy as np
from pyspark.sql import functions as F

from kilnwork.operators import linking as L
from kilnwork.operators import retrieval as R
from kilnwork.plans import registry

FOLDER = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_compare_metadata_broadcasts_no_parts(spark):
    assert "Broadcast" not in planned(registry.QUERIES["compare_metadata"](spark, FOLDER))


def named(bases):
    """Names one by one, with the number to begin at kept for each base."""
    seen, at, out = set(), {}, []
    for b in bases:
        name, k = b, at.get(b.lower(), 2)
        while name.lower() in seen:
            name, k = f"{b}-{k}", k + 1
        at[b.lower()] = max(k - 1, 2)
        seen.add(name.lower())
        out.append(name)
    return out


def test_unique_names_of_chains(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for case in range(150):
        # A root of its own for each case, with bases up to three numbers deep.
        pool = [f"r{case}x", f"R{case}x", *[f"r{case}x" + "".join(f"-{rng.choice([1, 2, 3, 4, 5, '02', 12])}" for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 8))]]
        rows += [rng.choice(pool) for _ in range(rng.randint(1, 40))]
    rng.shuffle(rows)
    expected = named(rows)
    got = L.unique_names(spark.createDataFrame([*enumerate(rows), (len(rows), None)], "i long, base string"), "base", ["i"]).orderBy("i").collect()
    assert [r.name for r in got] == [*expected, None]


def test_unique_names_of_one_hot_base(spark):
    n = 40_000
    df = spark.range(n).select("id", F.expr("CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'A' ELSE 'a-2' END").alias("base"))
    began = time.monotonic()
    got = [r.name for r in L.unique_names(df, "base", ["id"]).orderBy("id").collect()]
    took = time.monotonic() - began
    assert got == named([("a", "A", "a-2")[i % 3] for i in range(n)])
    assert took < 30


def test_pages_of_both_sides_meet(spark):
    # Spark counts a union of sides dealt out by page as dealt out by page, though it may have joined partitions of one side.
    plan = planned(registry.QUERIES["greedy_match"](spark, FOLDER))
    assert "Exchange" in plan[: plan.index("Union")]


def test_variant_scan_of_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = {i: rng.normal(size=64).astype("float32").tolist() for i in range(1300)}
    vectors |= {i: vectors[7] for i in range(30, 90)}  # equal ones, a query among them
    vectors |= {100: None, 101: None, 120: vectors[120][:20], 121: vectors[7][:40], 122: [], 123: [None, *vectors[7][1:]], 140: [float("inf"), *vectors[140][1:]], 141: [None] * 64}
    rows = [*vectors.items(), (5, vectors[7]), (160, vectors[9]), (None, vectors[7])]
    spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = registry.QUERIES["variant_scan"](spark, str(tmp_path)).select("query_id", "ref_id", "rank", "score").collect()
    want = con.sql(f"select query_id, ref_id, rank, score from ({registry.ORACLE_SQL['variant_scan']})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(got) == 5 * 65


def test_variant_scan_makes_no_row_for_a_pair(spark):
    made = R.near_variants(*[spark.createDataFrame([(i, [[i / 7, i % 5 / 3], [i % 3 / 2, 1.0]]) for i in ids], "i long, v array<array<double>>").coalesce(1) for ids in (range(0, 900, 20), range(900))], 5)
    assert made.count() == 45 * 5


def test_fusion_rerank_deals_out_no_pairs(spark, monkeypatch):
    monkeypatch.setattr("kilnwork.plans.search.MOST_PAIRS", 1, raising=False)
    df = registry.QUERIES["fusion_rerank"](spark, FOLDER)
    plan = planned(df)
    assert "Exchange" not in plan[: plan.index("Join")]
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{FOLDER}/part.parquet'")
    want = con.sql(f"select query_id, ref_id, cost_millionths, coverage_millionths, fused from ({registry.ORACLE_SQL['fusion_rerank']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_fusion_rerank_compares_every_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("kilnwork.plans.search.MOST_ALIKE", 7, raising=False)
    monkeypatch.setattr("kilnwork.plans.search.MOST_PAIRS", 900, raising=False)
    rng = random.Random(11)
    names = ["red bolt", "bolt red", "red red bolt", "red", "", " ", None, "old  gear"]
    parts = [(k, rng.choice(names), rng.choice(["A", "B", None]), rng.choice(["T", "U"]), rng.choice([-12, -9, -1, 0, 1, 9, 10, 19, None])) for k in range(1, 150)]
    parts += [(k, "hot nut", "A", "T", 3) for k in range(1001, 1041)] + [(1001, "hot nut", "B", "T", 4), (None, "red", "A", "T", 3), (7, "red", "A", None, 3)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    names = ["query_id", "ref_id", "cost_millionths", "coverage_millionths", "fused"]
    got = sorted(map(repr, map(tuple, registry.QUERIES["fusion_rerank"](spark, str(tmp_path)).select(*names).collect())))
    assert got == sorted(map(repr, con.sql(f"select {', '.join(names)} from ({registry.ORACLE_SQL['fusion_rerank']})").fetchall()))
    of_about = [(k, t, int(z / 10)) for k, _, _, t, z in parts if None not in (k, t, z)]
    pairs = [f"({a[0]}, {b[0]}" for a in of_about for b in of_about if a[1:] == b[1:] and a[0] != b[0]]
    assert sorted(",".join(x.split(",")[:2]) for x in got) == sorted(pairs)


def test_caption_parse_of_long_and_missing_numbers(spark, tmp_path):
    urls = ["https://a.org/en/25930?x", "https://a.org/en/129652", "http://a.org/007", "http://a.org/1/2", "http://a.org/", "", None, f"http://a.org/{10**25}", "http://12345.org/x/9"]
    spark.createDataFrame([(i, u) for i, u in enumerate(urls + urls[1:] + urls[:1])], "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    names = ["page_id", "figure", "caption", "continued", "printed_page", "strict"]
    got = registry.QUERIES["caption_parse"](spark, str(tmp_path)).select(*names).collect()
    want = con.sql(f"select {', '.join(names)} from ({registry.ORACLE_SQL['caption_parse']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_dct_descriptor_signs_and_missing_numbers(spark, tmp_path):
    rng = np.random.default_rng(1)
    vectors = [[0.1] * 64, [-0.1] * 64, [1.0] * 64, [0.0] * 64, [0.3, -0.3] * 32, rng.normal(size=64).tolist(), rng.normal(size=40).tolist(), rng.normal(size=70).tolist(), [None, *rng.normal(size=63).tolist()], [None] * 64, [], None]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = registry.QUERIES["dct_descriptor"](spark, str(tmp_path)).select("vec_id", "coefficients").collect()
    want = con.sql(f"select vec_id, coefficients from ({registry.ORACLE_SQL['dct_descriptor']})").fetchall()
    assert "-0.0" in repr(want)
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))
