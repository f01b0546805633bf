"""Evaluation: ranks to metrics, paired tests, summaries, masks, expert scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.functions import scoring as S


def rank_metrics(ranks: DataFrame, by: list[str], ks: list[int], pool: int, rank: str = "rank") -> DataFrame:
    """For each group: n, found, both means of reciprocal ranks (over found ones; with misses as 0), the median rank
    with misses as pool + 1, and for each k the hits and their share."""
    r = F.col(rank)
    aggs = [
        F.count(F.lit(1)).alias("n"), F.count(r).alias("found"), F.avg(1 / r).alias("mrr_found"),
        (F.sum(F.coalesce(1 / r, F.lit(0.0))) / F.count(F.lit(1))).alias("mrr_all"),
        F.percentile(F.coalesce(r, F.lit(pool + 1)), 0.5).alias("median_rank"),
    ]
    for k in ks:
        aggs += [F.count_if(r <= k).alias(f"top_{k}"), (F.count_if(r <= k) / F.count(F.lit(1))).alias(f"top_{k}_share")]
    return ranks.groupBy(*by).agg(*aggs)


def recall_curve(ranks: DataFrame, by: list[str], most: int, rank: str = "rank") -> DataFrame:
    """(by, k, hits, n, recall, low, high) for k up to ``most``. Ranks are counted once each; the running sums have ``most`` rows a group."""
    counts = ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    per = ranks.where(F.col(rank) <= most).groupBy(*by, F.col(rank).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    lists = per.groupBy(*by).agg(F.collect_list(F.struct("k", "c")).alias("seen"))
    grid = counts.join(lists, by, "left").select(*by, "n", "seen", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k"))
    hits = F.coalesce(F.aggregate(F.col("seen"), F.lit(0).cast("long"), lambda s, x: s + F.when(x["k"] <= F.col("k"), x["c"]).otherwise(0)), F.lit(0)).cast("long")
    out = grid.withColumn("hits", hits).withColumn("ci", S.wilson(F.col("hits"), F.col("n")))
    return out.select(*by, "k", "hits", "n", (F.col("hits") / F.col("n")).alias("recall"), F.col("ci.low").alias("low"), F.col("ci.high").alias("high"))


def paired_test(a: DataFrame, b: DataFrame, key: str, k: int, rank: str = "rank") -> DataFrame:
    """(only_a, only_b, p): common keys hit within k by one side alone, and the exact two-sided p."""
    both = a.select(key, F.coalesce(F.col(rank) <= k, F.lit(False)).alias("_a")).join(b.select(key, F.coalesce(F.col(rank) <= k, F.lit(False)).alias("_b")), key)
    n = both.agg(F.count_if(F.col("_a") & ~F.col("_b")).alias("only_a"), F.count_if(~F.col("_a") & F.col("_b")).alias("only_b"))
    return n.withColumn("p", S.mcnemar(F.col("only_a"), F.col("only_b")))


def distribution(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, median, population deviation, least, 5th, 25th, 75th and 95th percentile, and most of a column."""
    v = F.col(value)
    # One state of counted values for all percentiles.
    shares = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    out = df.groupBy(*(by or [])).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"), F.percentile(v, F.array(*map(F.lit, shares.values()))).alias("_cuts"),
    )
    cuts = {n: F.get("_cuts", i).alias(n) for i, n in enumerate(shares)}
    return out.select(*(by or []), "n", "mean", cuts["median"], "std", "least", cuts["p05"], cuts["p25"], cuts["p75"], cuts["p95"], "most")


def threshold_counts(value: Column, thresholds: list[float]) -> list[Column]:
    """Aggregates: rows at or above each threshold."""
    return [F.count_if(value >= t).alias(f"at_least_{int(round(t * 100))}") for t in thresholds]


def mask_metrics(pixels: DataFrame, pair: str, predicted: str, truth: str) -> DataFrame:
    """For each pair: common, union, different, iou, dice, precision, recall and area ratio of two masks given as flags
    on rows (1 inside). Both empty: invalid, with nulls."""
    p, t = F.coalesce(predicted, F.lit(0)) == 1, F.coalesce(truth, F.lit(0)) == 1
    n = pixels.groupBy(pair).agg(F.count_if(p & t).alias("common"), F.count_if(p | t).alias("union"), F.count_if(p).alias("n_predicted"), F.count_if(t).alias("n_truth"))
    some = lambda a, b: F.when(b > 0, a / b)
    c = F.col
    return n.select(
        pair, "common", "union", (c("union") - c("common")).alias("different"), some(c("common"), c("union")).alias("iou"),
        some(2 * c("common"), c("n_predicted") + c("n_truth")).alias("dice"), some(c("common"), c("n_predicted")).alias("precision"),
        some(c("common"), c("n_truth")).alias("recall"), some(c("n_predicted"), c("n_truth")).alias("area_ratio"), (c("union") > 0).alias("valid"),
    )


def micro_macro(pairs: DataFrame) -> DataFrame:
    """The ratio of sums and the mean of ratios over valid pairs."""
    ok = pairs.where("valid")
    return ok.agg((F.sum("common") / F.sum("union")).alias("micro_iou"), F.avg("iou").alias("macro_iou"), F.count(F.lit(1)).alias("n_pairs"))


def best_threshold(scores: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """(threshold, dice) with the highest Dice, the first of equals."""
    s, t = F.col(score), F.col(truth) == 1
    sums = scores.agg(F.count_if(t).alias("truth"), *[F.count_if((s >= x) & t).alias(f"both_{i}") for i, x in enumerate(thresholds)], *[F.count_if(s >= x).alias(f"found_{i}") for i, x in enumerate(thresholds)])
    dice = [2 * F.col(f"both_{i}") / F.nullif(F.col(f"found_{i}") + F.col("truth"), F.lit(0)) for i in range(len(thresholds))]
    each = F.array(*[F.struct(F.coalesce(v, F.lit(-1.0)).alias("rank"), F.lit(-x).alias("least"), F.lit(x).alias("threshold"), v.alias("dice")) for x, v in zip(thresholds, dice, strict=True)])
    return sums.select(F.array_max(each).alias("b")).select("b.threshold", "b.dice")


def expert_distribution(scores: DataFrame, by: list[str], score: str) -> DataFrame:
    """Counts of 0 to 3, the mean, and the shares of 2 or better and of 3."""
    s = F.col(score)
    return scores.groupBy(*by).agg(
        *[F.count_if(s == i).alias(f"n_{i}") for i in range(4)], F.avg(s).alias("mean"), (F.count_if(s >= 2) / F.count(s)).alias("share_2"), (F.count_if(s == 3) / F.count(s)).alias("share_3"),
    )


def overlap_at(a: DataFrame, b: DataFrame, key: str, id_: str, k: int, rank: str = "rank") -> DataFrame:
    """(key, common): ids within the first k of both."""
    x, y = (d.where(F.col(rank) <= k).groupBy(key).agg(F.collect_set(id_).alias(n)) for d, n in ((a, "_a"), (b, "_b")))
    return x.join(y, key).select(key, F.size(F.array_intersect("_a", "_b")).cast("long").alias("common"))


def guarded_corr(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Pearson's correlation, null where either column doesn't vary."""
    varies = (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return df.groupBy(*(by or [])).agg(F.when(varies, F.corr(x, y)).alias("corr"), F.count(F.lit(1)).alias("n"))


def cohorts(df: DataFrame, cohort: str, aggs: list[Column]) -> DataFrame:
    """The aggregates for each cohort and, as ``all``, over everything."""
    return df.rollup(cohort).agg(F.grouping(cohort).alias("_all"), *aggs).withColumn(cohort, F.when(F.col("_all") == 1, "all").otherwise(F.col(cohort))).drop("_all")


def group_evidence(fields: DataFrame, by: list[str], group: str, value: str, cap: float = 4.0) -> DataFrame:
    """The sum over groups of cap * tanh(sum / cap)."""
    per = fields.groupBy(*by, group).agg((cap * F.tanh(F.sum(value) / cap)).alias("_e"))
    return per.groupBy(*by).agg(F.sum("_e").alias("evidence"))


def group_cost(fields: DataFrame, by: list[str], group: str, compat: str, strength: str, all_weights: float) -> DataFrame:
    """(by, cost, strength, coverage): groups' mean costs by strength, weighted by each group's highest strength."""
    per = fields.groupBy(*by, group).agg((F.sum((1 - F.col(compat)) * F.col(strength)) / F.sum(strength)).alias("_c"), F.max(strength).alias("_w"), F.sum(strength).alias("_s"))
    return per.groupBy(*by).agg(F.round(F.sum(F.col("_c") * F.col("_w")) / F.sum("_w"), 6).alias("cost"), F.round(F.sum("_w"), 6).alias("strength"), F.round(F.sum("_s") / all_weights, 6).alias("coverage"))
