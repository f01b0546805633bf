"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A listed entry is a host and a path. It fits a URL whose host is that host or one of its subdomains and whose path
starts with that path; of several that fit, the longest wins. The filter holds each listed host and each listed host
with its path. A URL's host suffixes are looked up first; for those that the filter lets through, the beginnings of the
path, one for each length that the list has. Beginnings that it lets through are joined with the list.

Everything runs as DataFrame expressions. The filter is a table with a row for each block of 512 bits, about 32 bits a
key at any size of the list; it and the list are sent to every task while they are small, and shuffled beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.llm.shared import stored

#: Bits set for each key, all in one block of LANES longs.
PROBES, LANES = 6, 8
#: Keys for each block.
BLOCK_KEYS = 16
#: Blocks (about 100 bytes each) and listed entries that are sent to every task at most.
MOST_BLOCKS, MOST_ENTRIES = 1 << 19, 200_000
#: Parts that rows of one URL are dealt to where the matches are too many to be sent.
SALTS = 16
_SEP = "\x00"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit(_SEP), path)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _spot(hashed: Column, probe: int) -> Column:
    """The bit of a block, 0 to 511, that a probe sets: 9 bits of the key's second hash."""
    return F.shiftrightunsigned(hashed, 9 * probe).bitwiseAND(F.lit(511)).cast("int")


def _second(key: Column) -> Column:
    return F.xxhash64(F.lit(7), key)


def blocks_for(keys: int) -> int:
    """A power of two with room for so many keys."""
    return 1 << max(0, (max(1, keys) - 1) // BLOCK_KEYS).bit_length()


def build_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter of ``keys`` (key): block and lane0 to lane7, a row for each block that has a key."""
    hashed = _second(F.col("key"))
    spots = keys.select(_block(F.col("key"), blocks).alias("block"), F.explode(F.array(*[_spot(hashed, j) for j in range(PROBES)])).alias("spot"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("spot").bitwiseAND(F.lit(63)))
    lanes = [F.bit_or(F.when(F.shiftright("spot", 6) == lane, bit).otherwise(F.lit(0).cast("long"))).alias(f"lane{lane}") for lane in range(LANES)]
    return spots.groupBy("block").agg(*lanes)


def possible(rows: DataFrame, table: DataFrame, blocks: int, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """The ``rows`` whose ``key`` the filter holds: few of those that aren't listed, all that are."""
    table = F.broadcast(table) if blocks <= most_blocks else table.hint("shuffle_hash")
    hashed = _second(F.col("key"))
    word = lambda spot: F.element_at(F.array(*[F.col(f"lane{lane}") for lane in range(LANES)]), F.shiftright(spot, 6) + 1)
    held = [F.call_function("shiftright", word(s), s.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1 for s in (_spot(hashed, j) for j in range(PROBES))]
    met = rows.withColumn("block", _block(F.col("key"), blocks)).join(table, "block")
    for one in held:
        met = met.where(one)
    return met.drop("block", *[f"lane{lane}" for lane in range(LANES)])


def filter_urls(
    pages: DataFrame, listed: DataFrame, url: str = "url", default: str = "allow", most_blocks: int = MOST_BLOCKS, most_entries: int = MOST_ENTRIES
) -> DataFrame:
    """``pages`` with host, path, rule and verdict for each row.

    ``listed`` has host, path and verdict, one row for each entry; repeated entries must agree, the smaller verdict
    wins. A URL that no entry fits has a null rule and the default verdict. Null and malformed URLs have an empty host
    and path, and fit nothing. Repeated rows each get their answer; columns of ``pages`` named host, path, rule or
    verdict are replaced. An empty list gives every row the default. Filters of more than most_blocks blocks and lists
    of more than most_entries entries are shuffled, with the same result.
    """
    own = pages.drop("host", "path", "rule", "verdict")
    base = own.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    plain = {"rule": F.lit(None).cast("string"), "verdict": F.lit(default)}
    entries = stored(
        listed.select(lower_ascii(F.col("host")).alias("host"), F.col("path"), F.col("verdict"))
        .where(F.col("host").isNotNull() & F.col("path").isNotNull() & (F.col("host") != ""))
        .groupBy("host", "path")
        .agg(F.min("verdict").alias("verdict")),
        "entries",
    )
    facts = entries.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.length("path"))).alias("lengths"), F.max(F.size(F.split("host", r"\."))).alias("depth")).first()
    if not facts["n"]:
        return base.withColumns(plain)
    blocks = blocks_for(2 * facts["n"])
    keys = entries.select("host").distinct().select(F.col("host").alias("key")).unionByName(entries.select(key_of(F.col("host"), F.col("path")).alias("key")))
    table = stored(build_filter(keys, blocks), "filter")
    # URLs without a host fit nothing; one row for each different other one goes on.
    some = base.where(F.col("host") != "").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(facts["depth"]))), lambda i: F.concat_ws(".", F.slice(labels, -i, i)))
    hosts = possible(some.select("host", "path", F.explode(suffixes).alias("key")), table, blocks, most_blocks)
    lengths = F.filter(F.lit(facts["lengths"]).cast("array<int>"), lambda n: n <= F.length("path"))
    begun = hosts.select("host", "path", F.explode(F.transform(lengths, lambda n: key_of(F.col("key"), F.substr("path", F.lit(1), n)))).alias("key"))
    hits = possible(begun, table, blocks, most_blocks)
    exact = entries.select(key_of(F.col("host"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("said"))
    exact = F.broadcast(exact) if facts["n"] <= most_entries else exact.hint("shuffle_hash")
    judged = (
        hits.join(exact, "key")
        .groupBy(F.col("host").alias("_kw_host"), F.col("path").alias("_kw_path"))
        .agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "said")).alias("_kw_best"))
        .select("_kw_host", "_kw_path", F.col("_kw_best.rule").alias("_kw_rule"), F.col("_kw_best.said").alias("_kw_said"))
    )
    judged = stored(judged, "judged")
    if judged.count() <= most_entries:
        out = base.join(F.broadcast(judged), (F.col("host") == F.col("_kw_host")) & (F.col("path") == F.col("_kw_path")), "left")
    else:
        # A URL that very many rows have is dealt out; rows without a host stay out of the shuffle.
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in own.columns]), F.lit(SALTS)).cast("int")
        parts = judged.withColumn("_kw_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        fits = (F.col("host") == F.col("_kw_host")) & (F.col("path") == F.col("_kw_path")) & (salt == F.col("_kw_part"))
        out = base.where(F.col("host") != "").join(parts, fits, "left").drop("_kw_part")
        blank = base.where(F.col("host") == "")
        out = out.unionByName(blank, allowMissingColumns=True)
    return out.withColumns({"rule": F.col("_kw_rule"), "verdict": F.coalesce(F.col("_kw_said"), F.lit(default))}).drop("_kw_host", "_kw_path", "_kw_rule", "_kw_said")
