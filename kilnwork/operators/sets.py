"""Choosing, comparing and replacing rows: dedupe, snapshots, blocks in order, work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def one_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order. An aggregate, so that hot keys shrink before they are dealt out."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(*df.columns)


def last_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by order: the newest revision wins."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(*df.columns)


def changed_keys(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): added, removed or changed; keys whose columns all agree, nulls too, aren't there."""
    a = before.select(key, F.lit(1).alias("_a"), F.struct(*columns).alias("_was"))
    b = after.select(key, F.lit(1).alias("_b"), F.struct(*columns).alias("_is"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return a.join(b, key, "full").where(~F.col("_was").eqNullSafe(F.col("_is"))).select(key, kind.alias("change"))


def replace_part(df: DataFrame, part: Column, new: DataFrame) -> DataFrame:
    """Rows outside the part and the new rows; columns of either side are kept."""
    return df.where(~F.coalesce(part, F.lit(False))).unionByName(new, allowMissingColumns=True)


def replace_block(df: DataFrame, new: DataFrame, group: str, block: str, order: str) -> DataFrame:
    """``df`` with the rows of the blocks in ``new`` replaced in their place, new blocks at the end, numbered from 0 within each group."""
    at = df.groupBy(group, block).agg(F.min(order).alias("_at"))
    old = df.join(new.select(group, block).distinct(), [group, block], "left_anti").join(at, [group, block])
    put = new.join(at, [group, block], "left").withColumn("_at", F.coalesce("_at", F.lit(1 << 60)))
    return dense_order(old.unionByName(put), [group], ["_at", block, order], order).drop("_at")


def dense_order(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 within their group."""
    return df.withColumn(name, (F.row_number().over(W.partitionBy(*groups).orderBy(*order)) - 1).cast("long"))


def next_numbers(new: DataFrame, existing: DataFrame, group: str, number: str, order: list[str]) -> DataFrame:
    """New rows with numbers after their group's highest."""
    top = existing.groupBy(group).agg(F.max(number).alias("_top"))
    nth = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return new.join(top, group, "left").withColumn(number, F.coalesce("_top", F.lit(0)) + nth).drop("_top")


def spread_sample(df: DataFrame, groups: list[str], order: list[str], n: int) -> DataFrame:
    """n rows of each group at even places of its order, or all of a smaller group."""
    w = W.partitionBy(*groups)
    at, size = F.row_number().over(w.orderBy(*order)) - 1, F.count(F.lit(1)).over(w)
    placed = df.withColumns({"_at": at, "_size": size})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("_size") - 1) / F.lit(max(1, n - 1))))
    return placed.where((F.col("_size") <= n) | F.array_contains(wanted, F.col("_at").cast("long"))).drop("_at", "_size")


def pending(df: DataFrame, done: DataFrame, keys: list[str], fingerprint: str | None = None) -> DataFrame:
    """Rows not done yet; with a fingerprint, also those done with another one."""
    return df.join(done, keys + ([fingerprint] if fingerprint else []), "left_anti")


def merge_settings(existing: DataFrame, known: DataFrame, submitted: DataFrame, key: str) -> DataFrame:
    """What was set outside the known keys, and what was submitted, each once."""
    return existing.select(key).join(known.select(key), key, "left_anti").unionByName(submitted.select(key)).distinct()


def pages_once(figures: DataFrame, key: str, page: str, span: int = 3) -> DataFrame:
    """(page, key): each figure's page and the following ones, a shared page once, with the first figure by page."""
    return figures.select(key, F.explode(F.sequence(F.col(page), F.col(page) + span - 1)).alias("page"), F.col(page).alias("_from")).groupBy("page").agg(F.min_by(key, F.struct("_from", key)).alias(key))


def complement(spark, low: int, high: int, excluded: DataFrame, name: str) -> DataFrame:
    return spark.range(low, high + 1).select(F.col("id").alias(name)).join(excluded.select(name), name, "left_anti")


def has_text(df: DataFrame, columns: list[str], wanted: str) -> DataFrame:
    """Rows with the text, in either case, in one of the columns."""
    return df.where(F.lower(F.concat_ws(" ", *columns)).contains(wanted.lower()))


def preserve_scores(new: DataFrame, old: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """New rows with the old rows' annotations where all keys agree."""
    return new.drop(*columns).join(old.select(*keys, *columns), keys, "left")


def upload_refusals(uploads: DataFrame, stored: DataFrame, name: str, facts: list[str], in_use: str) -> DataFrame:
    """Uploads under a name whose stored file is in use and differs in some fact."""
    s = stored.select(name, in_use, *[F.col(f).alias(f"_was_{f}") for f in facts])
    differs = F.lit(False)
    for f in facts:
        differs = differs | ~F.col(f).eqNullSafe(F.col(f"_was_{f}"))
    return uploads.join(s, name).where(F.col(in_use) & differs).select(*uploads.columns)
