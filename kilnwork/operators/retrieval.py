"""Two-channel retrieval: descriptor scan, ranks, shortlist, cascade, voting.

Queries are a stated, bounded set that is sent to every task, in blocks of MOST_QUERIES; references are scanned where
they lie. A reference's rank in a channel is one more than the number of better ones, so ranks come from counts that
tasks add up, and no query's references ever meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries in one scan.
MOST_QUERIES = 512


@dataclass(frozen=True)
class Channel:
    """Places [begin, end) of the descriptor."""

    name: str
    begin: int
    end: int


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def distances(queries: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Squared distances of each query (rows: variants of one, if three-dimensional) to each reference; the least over variants."""
    q = queries if queries.ndim == 3 else queries[:, None, :]
    out = np.empty((len(q), len(refs)))
    for i in range(len(q)):
        d = refs[None, :, :] - q[i][:, None, :]
        out[i] = (d * d).sum(axis=2).min(axis=0)
    return out


@dataclass
class _Queries:
    ids: np.ndarray
    vectors: np.ndarray

    def of(self, c: Channel, refs: np.ndarray) -> np.ndarray:
        return distances(self.vectors[:, c.begin : c.end], refs[:, c.begin : c.end])


def _blocks(queries: DataFrame) -> Iterator[_Queries]:
    rows = queries.toLocalIterator()
    some: list = []
    for r in rows:
        some.append(r)
        if len(some) == MOST_QUERIES:
            yield _Queries(np.array([x[0] for x in some]), np.array([x[1] for x in some], float))
            some = []
    if some:
        yield _Queries(np.array([x[0] for x in some]), np.array([x[1] for x in some], float))


def _best(block: _Queries, channels: list[Channel], keep: int):
    """Each partition's best references of each query and channel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            ids, refs = batch.column(0).to_numpy(), _vectors(batch.column(1))
            for c, channel in enumerate(channels):
                d = block.of(channel, refs)
                for i in range(len(block.ids)):
                    old_d, old_i = best.get((i, c), (np.zeros(0), np.zeros(0, ids.dtype)))
                    x, k = np.concatenate([old_d, d[i]]), np.concatenate([old_i, ids])
                    order = np.lexsort((k, x))[:keep]
                    best[i, c] = x[order], k[order]
        for (i, c), (d, k) in best.items():
            n = len(k)
            yield pa.RecordBatch.from_arrays([pa.array([int(block.ids[i])] * n, pa.int64()), pa.array([channels[c].name] * n), pa.array(k.astype(np.int64)), pa.array(d)], ["query_id", "channel", "ref_id", "score"])

    return run


def top_k(queries: DataFrame, refs: DataFrame, channels: list[Channel], keep: int) -> DataFrame:
    """(query_id, channel, ref_id, score, rank) of each query's best ``keep`` references by (score, id) in each channel.

    ``queries`` and ``refs`` have an id and a vector; references without a vector are left out. Partitions send on at
    most ``keep`` rows for each query and channel.
    """
    usable = refs.where(F.col(refs.columns[1]).isNotNull() & F.col(refs.columns[0]).isNotNull())
    parts = [usable.mapInArrow(_best(b, channels, keep), "query_id long, channel string, ref_id long, score double") for b in _blocks(queries)]
    if not parts:
        return refs.sparkSession.createDataFrame([], "query_id long, channel string, ref_id long, score double, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(W.partitionBy("query_id", "channel").orderBy("score", "ref_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= keep)


def _near_variants(ids: np.ndarray, queries: np.ndarray, keep: int):
    """Each partition's best ``keep`` ids of each query (queries: one of (n, variants, places)) by the least squared distance of any variants."""
    n, variants, places = queries.shape
    norms = (queries * queries).sum(axis=2)
    # A product of these with (r, |r|^2, 1) is a squared distance but for its last digits.
    sides = [np.concatenate([-2 * queries[:, v], np.ones((n, 1)), norms[:, v, None]], axis=1) for v in range(variants)]

    def exact(q: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The least sum, place by place in order, of each pair of rows."""
        best = np.full(len(q), np.inf)
        for v in range(q.shape[1]):
            for w in range(r.shape[1]):
                total = np.zeros(len(q))
                for i in range(places):
                    d = q[:, v, i] - r[:, w, i]
                    total += d * d
                np.minimum(best, total, out=best)
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, far, near = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)  # places of queries, scores, ids
        limit = np.full(n, np.inf)
        for batch in batches:
            for begin in range(0, batch.num_rows, _CHUNK):
                some = batch.slice(begin, _CHUNK)
                own, refs = _few_of_equals(some.column(0).to_numpy(), _vectors(some.column(1)), keep)
                refs = refs.reshape(len(own), -1, places)
                squares = (refs * refs).sum(axis=2)
                about = np.full((n, len(own)), np.inf)
                for w in range(refs.shape[1]):
                    other = np.concatenate([refs[:, w], squares[:, w, None], np.ones((len(own), 1))], axis=1).T
                    for side in sides:
                        np.minimum(about, side @ other, out=about)
                slack = 1e-12 * (norms.max(axis=1) + squares.max())
                # So many rows have keep ids besides the query's own.
                most = (keep + 1) * int(np.unique(own, return_counts=True)[1].max())
                bound = np.minimum(limit, np.partition(about, most - 1, axis=1)[:, most - 1]) if most < len(own) else limit
                i, k = np.nonzero((about <= (bound + slack)[:, None]) & (ids[:, None] != own[None, :]))
                score = np.concatenate([exact(queries[i[x : x + _CHUNK]], refs[k[x : x + _CHUNK]]) for x in range(0, len(i), _CHUNK)] or [np.zeros(0)])
                at, far, near = np.concatenate([at, i]), np.concatenate([far, score]), np.concatenate([near, own[k]])
                order = np.lexsort((far, near, at))
                at, far, near = at[order], far[order], near[order]
                first = np.r_[True, (at[1:] != at[:-1]) | (near[1:] != near[:-1])][: len(at)]
                at, far, near = at[first], far[first], near[first]
                order = np.lexsort((near, far, at))
                at, far, near = at[order], far[order], near[order]
                place = np.arange(len(at)) - np.searchsorted(at, at)
                at, far, near, place = (x[place < keep] for x in (at, far, near, place))
                limit[at[place == keep - 1]] = far[place == keep - 1]
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(near), pa.array(far)], ["query_id", "ref_id", "score"])

    return run


#: Rows of references that are compared at once.
_CHUNK = 1024


def _few_of_equals(ids: np.ndarray, vectors: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors, those of the ``keep`` + 1 smallest ids: one more than can be found, as one can be the query."""
    same = np.unique((vectors + 0.0).view(f"V{vectors.shape[1] * 8}").ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((ids, same))
    order = order[np.r_[True, (same[order][1:] != same[order][:-1]) | (ids[order][1:] != ids[order][:-1])]]
    place = np.arange(len(order)) - np.searchsorted(same[order], same[order])
    order = order[place <= keep]
    return ids[order], vectors[order]


def near_variants(queries: DataFrame, refs: DataFrame, keep: int) -> DataFrame:
    """(query_id, ref_id, score): at least the best ``keep`` other references of each query by (score, id), the least
    squared distance of any two variants.

    Both have an id and an array of variants, arrays of one length; no null, and finite numbers of about one size, as
    distances come from products first and are summed place by place where they could be among the best. Partitions send
    on at most ``keep`` rows for each row of ``queries``, in blocks of MOST_QUERIES.
    """
    id_, variants = refs.columns
    flat = refs.select(F.col(id_).cast("long"), F.flatten(variants))
    parts, some = [], []
    rows = list(queries.toLocalIterator())
    for begin in range(0, len(rows), MOST_QUERIES):
        some = rows[begin : begin + MOST_QUERIES]
        parts.append(flat.mapInArrow(_near_variants(np.array([r[0] for r in some], np.int64), np.array([r[1] for r in some], float), keep), "query_id long, ref_id long, score double"))
    found = parts[0] if parts else refs.sparkSession.createDataFrame([], "query_id long, ref_id long, score double")
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def _counts(block: _Queries, channels: list[Channel], wanted: dict[int, list[tuple[int, list[float]]]]):
    """How many references are better than each candidate in each channel, a partition's part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {int(q): i for i, q in enumerate(block.ids)}
        total = {q: np.zeros((len(channels), len(cs)), np.int64) for q, cs in wanted.items()}
        for batch in batches:
            ids, refs = batch.column(0).to_numpy(), _vectors(batch.column(1))
            for c, channel in enumerate(channels):
                d = block.of(channel, refs)
                for q, cs in wanted.items():
                    x = d[at[q]]
                    order = np.argsort(x, kind="stable")
                    s, k = x[order], ids[order]
                    score = np.array([v[c] for _, v in cs])
                    low, high = np.searchsorted(s, score, "left"), np.searchsorted(s, score, "right")
                    total[q][c] += low + np.array([(k[a:b] < r).sum() for a, b, (r, _) in zip(low, high, cs, strict=True)])
        for q, cs in wanted.items():
            n = len(cs)
            arrays = [pa.array([q] * n, pa.int64()), pa.array([r for r, _ in cs], pa.int64())] + [pa.array(total[q][c]) for c in range(len(channels))]
            yield pa.RecordBatch.from_arrays(arrays, ["query_id", "ref_id", *[f"n_{c.name}" for c in channels]])

    return run


def shortlist(queries: DataFrame, refs: DataFrame, channels: list[Channel], keep: int, method_keep: int = 150) -> DataFrame:
    """(query_id, ref_id, <channel>_score, <channel>_rank for both channels, score, position, selected_by) of each query's best ``keep``.

    The order is (least rank, sum of ranks, id). Anything among the first ``keep`` is among the first ``keep`` of one
    channel, so only those candidates are ranked in both. selected_by names the channels in which the rank is within
    ``method_keep``, or combined_fill.
    """
    usable = refs.where(F.col(refs.columns[1]).isNotNull() & F.col(refs.columns[0]).isNotNull())
    id_, vector = usable.columns[:2]
    spark = refs.sparkSession
    schema = "query_id long, ref_id long, " + ", ".join(f"n_{c.name} long" for c in channels)
    out = None
    for block in _blocks(queries):
        some = spark.createDataFrame([(int(q), v.tolist()) for q, v in zip(block.ids, block.vectors)], "query_id long, vector array<double>")
        near = top_k(some, usable, channels, keep).select("query_id", "ref_id").distinct()
        # Candidates number at most channels * keep for each query of the block.
        rows = near.join(usable.select(F.col(id_).alias("ref_id"), vector), "ref_id").dropDuplicates(["query_id", "ref_id"]).collect()
        at = {int(q): i for i, q in enumerate(block.ids)}
        wanted: dict[int, list[tuple[int, list[float]]]] = {}
        scores = []
        for r in rows:
            one = np.array(r[vector], float)[None, :]
            v = [float(distances(block.vectors[at[r.query_id]][None, c.begin : c.end], one[:, c.begin : c.end])[0, 0]) for c in channels]
            wanted.setdefault(r.query_id, []).append((r.ref_id, v))
            scores.append((r.query_id, r.ref_id, *v))
        counted = usable.mapInArrow(_counts(block, channels, wanted), schema).groupBy("query_id", "ref_id").agg(*[(F.sum(f"n_{c.name}") + 1).alias(f"{c.name}_rank") for c in channels])
        known = spark.createDataFrame(scores, "query_id long, ref_id long, " + ", ".join(f"{c.name}_score double" for c in channels))
        part = known.join(counted, ["query_id", "ref_id"])
        out = part if out is None else out.unionByName(part)
    if out is None:
        fields = ", ".join(f"{c.name}_score double, {c.name}_rank long" for c in channels)
        return spark.createDataFrame([], f"query_id long, ref_id long, {fields}, score double, position int, selected_by string")
    ranks = [F.col(f"{c.name}_rank") for c in channels]
    order = [F.least(*ranks), sum(ranks[1:], ranks[0]), F.col("ref_id")]
    placed = out.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("position") <= keep)
    by = F.concat_ws("+", *[F.when(F.col(f"{c.name}_rank") <= min(method_keep, keep), F.lit(c.name)) for c in channels])
    return placed.withColumns({"score": F.least(*[F.col(f"{c.name}_score") for c in channels]), "selected_by": F.when(by == "", "combined_fill").otherwise(by)})


def cascade(candidates: DataFrame, keep: int, reserve: int, by: list[str], score: str = "score", ranks: tuple[str, ...] = ("outline_rank", "ribbon_rank"), id_: str = "ref_id") -> DataFrame:
    """Survivors of a stage: the best ``keep`` of each group by (score, id), then for each channel in turn the first
    ``reserve`` of those not chosen yet by (rank, score, id); in order of (score, id) as ``place``.

    With no reserve, or no more rows than ``keep``, only the best."""
    nth = F.row_number().over(W.partitionBy(*by).orderBy(score, id_))
    out = candidates.withColumn("_nth", nth).withColumn("_in", F.col("_nth") <= keep)
    if reserve > 0:
        for r in ranks:
            turn = F.row_number().over(W.partitionBy(*by, "_in").orderBy(F.coalesce(r, F.lit(10**9)), score, id_))
            out = out.withColumn("_turn", turn).withColumn("_in", F.col("_in") | (F.col("_turn") <= reserve)).drop("_turn")
    return out.where("_in").withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(score, id_))).drop("_nth", "_in")


def margins(ranked: DataFrame, by: list[str], score: str = "score", id_: str = "ref_id") -> DataFrame:
    """Each group's best row and how far the second is behind; null with one row."""
    first = F.array_sort(F.collect_list(F.struct(score, id_)))
    top = ranked.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(score, id_))).where("_n <= 2").groupBy(*by).agg(first.alias("_two"))
    return top.select(*by, F.col("_two")[0][id_].alias(id_), F.col("_two")[0][score].alias(score), (F.get("_two", F.lit(1))[score] - F.col("_two")[0][score]).alias("margin"))


def vote(neighbours: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(query_id, label, votes) of the commonest label among each query's first k neighbours, the smallest of equals."""
    named = neighbours.where(F.col("rank") <= k).join(labels.select(F.col("ref_id"), "label"), "ref_id")
    return named.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("votes")).groupBy("query_id").agg(F.min_by(F.struct("label", "votes"), F.struct(-F.col("votes"), "label")).alias("b")).select("query_id", "b.label", "b.votes")
