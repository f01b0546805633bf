import random

import pytest
from pyspark.sql import functions as F

from kilnwork.llm import url_filter
from kilnwork.llm.registry import URL_RULES

SCHEMA = "page_id long, url string, host string, at string"


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut], rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_against_brute_force(spark):
    rng = random.Random(1)
    hosts = ["a.example.net", "EXAMPLE.net", "xexample.net", "b.org", "org", "example.com", "q.example.com", "", "net", "é.NET", "a.net:80"]
    tails = ["", "/", "/en/1", "/de/", "/fr/x?y#z", "?q=/en/", "#/fr/", "/EN/", "/de", "//en/"]
    urls = [f"{s}://{h}{t}" for s in ("http", "HTTPS", "") for h in hosts for t in tails] + [None, "", "no scheme", "://", "a://b://net/"]
    rows = [(i % 7, u, "clash", "x") for i, u in enumerate(urls * 2)]
    rng.shuffle(rows)
    listed = spark.createDataFrame(URL_RULES + URL_RULES[:1], "host string, path string, verdict string")
    got = url_filter.filter_urls(spark.createDataFrame(rows, SCHEMA), listed).collect()
    assert sorted((repr((r.page_id, r.url, r.host, r.path, r.rule, r.verdict))) for r in got) == sorted(repr((i, u, *brute(u, URL_RULES))) for i, u, _, _ in rows)


def test_filter_never_misses_and_mostly_rejects(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit(".com/")).alias("key"))
    blocks = url_filter.blocks_for(3000)
    table = url_filter.build_filter(keys, blocks)
    other = spark.range(5000).select(F.concat(F.lit("g"), "id", F.lit(".com/")).alias("key"))
    for most in (1, 1 << 19):
        assert url_filter.possible(keys, table, blocks, most).count() == 3000
        assert url_filter.possible(other, table, blocks, most).count() < 100


def test_lists_too_large_to_be_sent(spark):
    rng = random.Random(2)
    hosts = [f"h{i}.{t}" for i in range(30) for t in ("com", "net")] + ["com"]
    rules = [(rng.choice(hosts), rng.choice(["/", "/a", "/a/b", "/en/"]), "block") for _ in range(80)]
    urls = [f"http://{rng.choice(['', 'www.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/a/b/c', '/en/1?q'])}" for _ in range(400)] + [None] * 50 + ["http://www.h1.com/"] * 100
    rows = [(i, u, "clash", "x") for i, u in enumerate(urls)]
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    expected = sorted(repr((i, u, *brute(u, rules))) for i, u, _, _ in rows)
    for limits in ({}, {"most_blocks": 1, "most_entries": 2}):
        got = url_filter.filter_urls(spark.createDataFrame(rows, SCHEMA), listed, **limits)
        assert sorted(repr((r.page_id, r.url, r.host, r.path, r.rule, r.verdict)) for r in got.collect()) == expected


def test_a_million_entries_plan_within_seconds(spark):
    listed = spark.range(1_000_000).select(F.concat(F.lit("h"), "id", F.lit(".com")).alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"))
    pages = spark.createDataFrame([(1, "http://www.h77.com/x"), (2, "http://www.h1000000.com/x")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, listed).collect()}
    assert got == {1: "block", 2: "allow"}


@pytest.mark.parametrize("listed", [[], [(None, "/", "block")]])
def test_empty_inputs(spark, listed):
    entries = spark.createDataFrame(listed, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.filter_urls(pages, entries).collect()] == [(1, "http://a.net/", "a.net", "/", None, "allow")]
    assert url_filter.filter_urls(pages.limit(0), entries).count() == 0
