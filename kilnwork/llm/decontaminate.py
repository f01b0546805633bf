"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words at a mask's places, the words between are ignored; MASKS are all masks of WEIGHT places
within SPAN words. The seeds of the documents, those that a Bloom table of the benchmark's seeds lets through, are
joined with the benchmark's. A hit lies on a diagonal of a document and an item. Diagonals with enough hits are
compared word by word, and the best stretch decides.

Enough is what every overlap has (``least_hits``): the beginning of a best stretch up to its needed-th equal word never
has a score below 0, and of all such arrangements of equal and other words the least number of hits is found by dynamic
programming. No overlap is lost. Items of fewer than LEAST_NEEDED words are looked up by the seed of their whole word
sequence.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnwork.llm.shared import bounded_batches, stored
from kilnwork.llm.textops import ALNUM, Words, mix, slices, words

U = np.uint64
#: Places of a seed, and the neighbouring words that they lie in.
WEIGHT, SPAN = 3, 5
MASKS = [(0, *rest) for rest in itertools.combinations(range(1, SPAN), WEIGHT - 1)]
#: A stretch counts each equal word 1 and each other PENALTY; it is an overlap with the least number of equal words.
PENALTY = 1.5
MOST_NEEDED, LEAST_NEEDED, SHARE_NEEDED = 13, 7, 0.7
#: The Bloom table has 32 bits for each seed, from 2**16 to 2**29 bits (64 MB, sent to every task); a larger benchmark's lets more through.
LEAST_BITS, MOST_BITS = 16, 29
#: Seeds of a benchmark that is sent whole to every task (three numbers each); a larger one is shuffled.
MOST_BROADCAST = 1_000_000
#: In a shuffled join, seeds with more hits than HOT are dealt out over SALTS parts.
HOT, SALTS = 1 << 20, 64


def needed(n_words: int) -> int:
    """Equal words that make an overlap with an item of so many words: all of fewer than LEAST_NEEDED."""
    if n_words < LEAST_NEEDED:
        return max(1, n_words)
    return max(LEAST_NEEDED, min(MOST_NEEDED, math.ceil(SHARE_NEEDED * n_words)))


@functools.cache
def least_hits(n_words: int) -> int:
    """Hits that every overlap with an item of so many words has on its diagonal."""
    if n_words < LEAST_NEEDED:
        return 1
    goal, least = needed(n_words), math.inf
    # Fewest hits of beginnings by (which of the last words are equal, score, equal words).
    states = {(0, 0.0, 0): 0}
    while states:
        longer: dict[tuple[int, float, int], int] = {}
        for (bits, score, n), hits in states.items():
            for equal in (0, 1):
                seen, value = bits << 1 | equal, score + (1 if equal else -PENALTY)
                if value < 0:
                    continue
                total = hits + equal * sum(all(seen >> (mask[-1] - o) & 1 for o in mask) for mask in MASKS)
                if n + equal == goal:
                    least = min(least, total)
                else:
                    key = seen & ((1 << (SPAN - 1)) - 1), value, n + equal
                    longer[key] = min(total, longer.get(key, total))
        states = longer
    return int(least)


def tokens(column: pa.Array) -> Words:
    """Lower-cased runs of letters, digits and characters outside ASCII."""
    return words(pc.utf8_lower(pc.fill_null(column, "")), ALNUM)


def seeds(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The seed of each place: of the words at the mask's offsets from there."""
    n = len(hashes) - mask[-1]
    if n <= 0:
        return np.zeros(0, U)
    total = np.full(n, U(len(mask)), U)
    for o in mask:
        total += hashes[o : o + n] * (mix(np.array([o + 101], U))[0] | U(1))
    return mix(total)


def whole(n_words: int) -> tuple[int, ...]:
    """The mask of a short item's whole word sequence."""
    return tuple(range(n_words))


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(equal words, begin, end) of the stretch with the highest score, the first and longest of several."""
    score = np.concatenate([[0.0], np.cumsum(np.where(equal, 1.0, -PENALTY))])
    low = np.minimum.accumulate(score)
    end = int(np.argmax(score - low))
    begin = int(np.flatnonzero(score[: end + 1] == low[end])[0])
    return int(equal[begin:end].sum()), begin, end


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with their words and seeds."""
    for batch in batches:
        w = tokens(batch.column(2))
        rows = []
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            own = w.hash[a:b]
            parts = [(s, np.arange(len(s))) for m in (MASKS if b - a >= LEAST_NEEDED else [whole(b - a)] if b > a else []) for s in [seeds(own, m)]]
            rows.append([{"seed": s, "place": p} for x, y in parts for s, p in zip(x.view(np.int64).tolist(), y.tolist(), strict=True)])
        lists = pa.ListArray.from_arrays(pa.array(w.first.astype(np.int32)), pa.array(w.hash.view(np.int64)))
        counts = w.counts.tolist()
        made = [pa.array(counts, pa.int32()), pa.array([needed(n) for n in counts], pa.int32()), pa.array([least_hits(n) for n in counts], pa.int32()), lists]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made, pa.array(rows, pa.list_(pa.struct([("seed", pa.int64()), ("place", pa.int32())])))], ["item", "item_id", "n", "needed", "least", "own", "seeds"])


class Benchmark:
    """A benchmark's items and seeds in the shared folder, and what every task gets of them: the Bloom table, the sizes of
    short items, and the fewest hits and most words of the others."""

    def __init__(self, benchmark: DataFrame) -> None:
        spark = benchmark.sparkSession
        kind = benchmark.schema["item_id"].dataType
        schema = T.StructType(
            [T.StructField("item", T.LongType()), T.StructField("item_id", kind), *[T.StructField(c, T.IntegerType()) for c in ("n", "needed", "least")], T.StructField("own", T.ArrayType(T.LongType()))]
            + [T.StructField("seeds", T.ArrayType(T.StructType([T.StructField("seed", T.LongType()), T.StructField("place", T.IntegerType())])))]
        )
        self.items = stored(benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", "text").mapInArrow(_posted, schema), "items")
        postings = self.items.select("item", "least", F.explode("seeds").alias("s")).select("item", "least", "s.seed", F.col("s.place").alias("at"))
        self.postings = postings
        long_ = F.col("n") >= LEAST_NEEDED
        facts = self.items.agg(F.coalesce(F.sum(F.size("seeds")), F.lit(0)).alias("n"), F.max(F.when(long_, F.col("n"))).alias("longest"), F.min(F.when(long_, F.col("least"))).alias("least"), F.collect_set(F.when(~long_ & (F.col("n") > 0), F.col("n"))).alias("short")).first()
        self.n_seeds = facts["n"]
        self.bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(32 * max(1, self.n_seeds)))))
        spot = F.shiftrightunsigned("seed", 64 - self.bits)
        lanes = postings.groupBy(F.shiftright(spot, 6).alias("lane")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)).cast("int"))).alias("set")).toArrow()
        table = np.zeros(1 << (self.bits - 6), U)
        table[lanes["lane"].to_numpy()] = lanes["set"].to_numpy().view(U)
        self.sent = spark.sparkContext.broadcast((table, self.bits, facts["longest"], facts["least"], sorted(facts["short"])))


def _dense(spread: np.ndarray, least: int, longest: int) -> np.ndarray:
    """Which of the ascending places lie among ``least`` ones within ``longest`` words."""
    keep = np.zeros(len(spread) + 1, np.int64)
    begin = np.flatnonzero(spread[least - 1 :] - spread[: len(spread) - least + 1] < longest) if len(spread) >= least else np.zeros(0, int)
    np.add.at(keep, begin, 1)
    np.add.at(keep, begin + least, -1)
    return np.cumsum(keep[:-1]) > 0


def _sighted(sent):
    """Texts (h1, h2, text) with hits that could make an overlap: their hashes and hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits, longest, least, short = sent.value
        masks = ([*MASKS] if longest else []) + [whole(n) for n in short]
        for batch in batches:
            for x, y in slices(batch.column(2)):
                w = tokens(batch.column(2).slice(x, y - x))
                text, ends = w.text_of_word(), np.repeat(w.first[1:], w.counts)
                places, found = [], []
                for mask in masks:
                    s = seeds(w.hash, mask)
                    spot = s >> U(64 - bits)
                    at = np.flatnonzero((table[(spot >> U(6)).astype(np.int64)] >> (spot & U(63))) & U(1))
                    at = at[at + mask[-1] < ends[at]]
                    places.append(at)
                    found.append(s[at])
                # Hits of long items stand several together; texts lie apart by more than the longest item.
                n_long = sum(map(len, places[: len(MASKS)])) if longest else 0
                place, seed = np.concatenate(places or [np.zeros(0, np.int64)]), np.concatenate(found or [np.zeros(0, U)])
                order = np.argsort(place[:n_long], kind="stable")
                dense = order[_dense(place[order] + text[place[order]] * longest, least, longest)] if n_long else order
                chosen = np.concatenate([dense, np.arange(n_long, len(place))])
                chosen = chosen[np.argsort(place[chosen], kind="stable")]
                if len(chosen):
                    place, seed = place[chosen], seed[chosen]
                    rows, n_hits = np.unique(text[place], return_counts=True)
                    hit = pa.StructArray.from_arrays([pa.array(seed.view(np.int64)), pa.array((place - w.first[text[place]]).astype(np.int32))], ["seed", "place"])
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_hits)]).astype(np.int32)), hit)
                    yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(x, y - x).take(pa.array(rows)) for i in range(2)], lists], ["h1", "h2", "hits"])

    return run


def _verified(keep: list[str]):
    """Each row's overlaps with its candidate items. Columns: ``keep``, text, found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(len(keep) + 1)
            kind = found.type.value_type.field("item_id").type
            row, ids, made = [], [], []
            for x, y in slices(batch.column(len(keep))):
                w = tokens(batch.column(len(keep)).slice(x, y - x))
                for r in range(x, y):
                    own, items = w.hash[w.first[r - x] : w.first[r - x + 1]], found[r].values
                    hashes, diagonals, least = items.field("own"), items.field("diagonals"), items.field("needed").to_pylist()
                    for k in range(len(items)):
                        v, best = hashes[k].values.to_numpy().view(U), (1, 0, 0)
                        for g in diagonals[k].values.to_numpy().tolist():
                            a, b = max(0, g), min(len(own), g + len(v))
                            equal, begin, end = best_stretch(own[a:b] == v[a - g : b - g])
                            if equal >= least[k]:
                                best = min(best, (-equal, a + begin, a + end))
                        if best[0] < 0:
                            row.append(r)
                            ids.append(items.field("item_id")[k].as_py())
                            made.append((-best[0], best[1], best[2], -best[0] / (best[2] - best[1])))
            if row:
                columns = [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(row)) for i in range(len(keep))], pa.array(ids, kind), *columns], [*keep, "item_id", "n_equal", "first_word", "end_word", "share"])

    return run


def _dealt(hits: DataFrame, bench: Benchmark, most_broadcast: int, hot: int) -> DataFrame:
    """Hits joined with the benchmark's seeds."""
    if bench.n_seeds <= most_broadcast:
        return hits.join(F.broadcast(bench.postings), "seed")
    # Seeds with very many hits are few; their items are repeated for each salt.
    often = stored(hits.groupBy("seed").count().where(F.col("count") > hot).select("seed", F.lit(SALTS).alias("salts")), "often")
    often = F.broadcast(often) if often.count() <= most_broadcast else often
    salts = F.coalesce("salts", F.lit(1))
    left = hits.join(often, "seed", "left").select("h1", "h2", "seed", "place", F.pmod(F.xxhash64("h1", "h2", "place"), salts).cast("int").alias("salt"))
    right = bench.postings.join(often, "seed", "left").select("seed", "item", "least", "at", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return left.join(right, ["seed", "salt"])


def _found(rows: DataFrame, keep: list[str], benchmark: DataFrame, most_broadcast: int, hot: int) -> DataFrame:
    """The ``keep`` columns and the overlaps' of ``rows`` (keep, h1 and h2, which tell texts apart, and text)."""
    bounded_batches(rows.sparkSession)
    bench = Benchmark(benchmark)
    sighted = rows.select("h1", "h2", "text").mapInArrow(_sighted(bench.sent), "h1 long, h2 long, hits array<struct<seed:long,place:int>>")
    # The join with a broadcast benchmark reads the hits once, as they come; a shuffled one reads them twice.
    sighted = stored(sighted, "sighted") if bench.n_seeds > most_broadcast else sighted
    hits = sighted.select("h1", "h2", F.explode("hits").alias("h")).select("h1", "h2", "h.seed", "h.place")
    # Copies of a text add to each other's hits: more diagonals are compared, none fewer.
    diagonals = (
        _dealt(hits, bench, most_broadcast, hot)
        .groupBy("h1", "h2", "item", (F.col("place") - F.col("at")).alias("diagonal"))
        .agg(F.count(F.lit(1)).alias("hits"), F.max("least").alias("least"))
        .where("hits >= least")
    )
    # One text's candidates meet in one row: at most its hits' diagonals.
    candidates = (
        diagonals.groupBy("h1", "h2", "item")
        .agg(F.collect_list("diagonal").alias("diagonals"))
        .join(bench.items.select("item", "item_id", "needed", "own"), "item")
        .groupBy("h1", "h2")
        .agg(F.collect_list(F.struct("item_id", "needed", "own", "diagonals")).alias("found"))
    )
    candidates = stored(candidates, "candidates")
    # Few texts have candidates; the others' rows stay where they are.
    if candidates.count() <= most_broadcast:
        rows = rows.join(F.broadcast(candidates.select("h1").distinct()), "h1", "left_semi")
    held = [rows.schema[c] for c in keep]
    out = T.StructType([*held, T.StructField("item_id", benchmark.schema["item_id"].dataType), *[T.StructField(c, T.LongType()) for c in ("n_equal", "first_word", "end_word")], T.StructField("share", T.DoubleType())])
    return rows.join(candidates, ["h1", "h2"]).select(*keep, "text", "found").mapInArrow(_verified(keep), out)


def _keyed(docs: DataFrame) -> tuple[Column, Column]:
    """128 bits of each text, in two longs; null counts as empty."""
    return tuple(F.xxhash64(*salt, F.coalesce(docs["text"], F.lit(""))) for salt in ((), (F.lit(1),)))


def overlaps(docs: DataFrame, benchmark: DataFrame, most_broadcast: int = MOST_BROADCAST, hot: int = HOT) -> DataFrame:
    """doc_id, item_id, n_equal, first_word, end_word and share for each document and item of ``benchmark`` (item_id,
    text) that overlap; one row for each pair, with its best stretch in words of the document (of equal ones the first,
    then the shortest).

    Null and empty texts overlap nothing. Repeated rows of either table each give rows; null ids are kept. Other
    columns are ignored. A benchmark of more than most_broadcast seeds is shuffled, with seeds of more than ``hot`` hits salted.
    """
    h1, h2 = _keyed(docs)
    return _found(docs.select("doc_id", h1.alias("h1"), h2.alias("h2"), "text"), ["doc_id"], benchmark, most_broadcast, hot)


def without_overlaps(docs: DataFrame, benchmark: DataFrame, most_broadcast: int = MOST_BROADCAST, hot: int = HOT) -> DataFrame:
    """The rows of ``docs`` that overlap no item, unchanged. Rows of equal texts go or stay together."""
    h1, h2 = _keyed(docs)
    found = _found(docs.select(h1.alias("h1"), h2.alias("h2"), "text"), ["h1", "h2"], benchmark, most_broadcast, hot)
    dirty = stored(found.select(F.col("h1").alias("_kw_h1"), F.col("h2").alias("_kw_h2")).distinct(), "dirty")
    small = dirty.count() <= most_broadcast
    return docs.join(F.broadcast(dirty) if small else dirty, (h1 == F.col("_kw_h1")) & (h2 == F.col("_kw_h2")), "left_anti")
