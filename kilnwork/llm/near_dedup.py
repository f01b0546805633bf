"""Near-duplicate groups by MinHash with fast similarity sketching.

A text's set has its distinct runs of K words. Its sketch has one coordinate for each bin: in round r every element
falls into a hashed bin with a value above all of earlier rounds', a bin keeps its smallest value, and rounds go on
until every bin is full; from round T on each round fills one bin, so 2 T rounds always do. Coordinates of two sketches
agree with the probability of the sets' similarity, with concentration as good as that of independent hashes. Bands of
ROWS coordinates give the buckets.

No bucket is expanded into all its pairs. Texts of equal word sequences are one node. First, every member of a bucket
is held against the bucket's smallest member alone; links found so give components. Then members of different
components are compared: in small buckets pair by pair, in large ones, whose families may have any size, in blocks of
bounded size that a kernel compares by matrix products, giving only the links that join components. Every link is
confirmed on the full sets of the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.llm.components import components
from kilnwork.llm.shared import bounded_batches, drop_stored, stored
from kilnwork.llm.textops import mix, shingles, slices, words

U = np.uint64
_FULL = U(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Settings:
    """Texts are linked if 100 times the common part of their sets is at least ``percent`` times the union."""

    percent: int = 80
    k: int = 5
    #: A pair at the threshold shares no band with a probability of (1 - (percent / 100) ** rows) ** bands, here 4e-8.
    rows: int = 6
    bands: int = 56
    #: Members of a bucket that are paired row by row; families of larger buckets are compared in blocks of so many rows.
    most_members: int = 40
    block: int = 256
    #: Rows that are broadcast at most (three longs each, about 24 MB); beyond, both sides are shuffled.
    most_broadcast: int = 500_000

    def least_shared(self) -> int:
        """Bands that a true pair shares but for a chance of one in a million."""
        p, total, m = (self.percent / 100) ** self.rows, 0.0, 0
        while True:
            total += math.comb(self.bands, m) * p**m * (1 - p) ** (self.bands - m)
            if total > 1e-6:
                return max(1, m)
            m += 1


#: At 85 percent, where longer bands tell more apart: no shared band with a probability of 7e-8.
AT_85 = Settings(percent=85, rows=8, bands=52)


def sketches(values: np.ndarray, first: np.ndarray, bins: int) -> np.ndarray:
    """A row of ``bins`` coordinates for each segment of distinct 64-bit values; all ones for an empty segment."""
    n = len(first) - 1
    out = np.full((n, bins), _FULL, U)
    live = np.flatnonzero(np.diff(first))
    sizes = np.diff(first)[live]
    for r in range(2 * bins):
        if not len(live):
            break
        h = mix(values ^ mix(np.array([r + 1], U))[0])
        place = ((h >> U(32)) * U(bins) >> U(32)).astype(np.int64) if r < bins else np.full(len(h), r - bins)
        row = np.repeat(np.arange(len(live)), sizes)
        part = out[live]
        np.minimum.at(part.reshape(-1), row * bins + place, (h & U(0xFFFFFFFF)) | U(r << 32))
        out[live] = part
        open_ = (part == _FULL).any(axis=1)
        values = values[np.repeat(open_, sizes)]
        live, sizes = live[open_], sizes[open_]
    return out


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A hash for each band of each row."""
    n, bins = sketch.shape
    weight = mix(np.arange(1, rows + 1, dtype=U)) | U(1)
    total = (mix(sketch).reshape(n, bins // rows, rows) * weight).sum(axis=2, dtype=U)
    return mix(total + mix(np.arange(bins // rows, dtype=U) + U(77)))


def _sketched(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            for a, b in slices(column):
                w = words(column.slice(a, b - a))
                sets, first = shingles(w, s.k)
                keys = band_keys(sketches(sets, first, s.rows * s.bands), s.rows).view(np.int64)
                # Two hashes of the whole word sequence: the sums of its words' hashes, each at its place.
                at = np.arange(len(w.hash), dtype=U) - np.repeat(w.first[:-1], w.counts).astype(U)
                sums = []
                for salt in (3, 4):
                    total = np.concatenate([[U(0)], np.cumsum(mix(w.hash + mix(at + U(salt << 40))))])
                    sums.append(mix(total[w.first[1:]] - total[w.first[:-1]] + w.counts.astype(U)).view(np.int64))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, s.bands), pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(3)] + [pa.array(np.diff(first)), pa.array(sums[0]), pa.array(sums[1]), flat], ["doc_id", "h1", "h2", "n", "s1", "s2", "bands"])

    return run


def text_hashes(text: str | Column) -> tuple[Column, Column]:
    """128 bits of a text, in two longs; null counts as empty."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.xxhash64(c), F.xxhash64(F.lit(1), c)


def _confirmed(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for x, y in slices(batch.column(3)):
                sets, first = shingles(words(batch.column(3).slice(x, y - x)), s.k)
                for i in range(x, y):
                    if last[0] != a[i]:
                        last = a[i], shingles(words(batch.column(2).slice(i, 1)), s.k)[0]
                    own = sets[first[i - x] : first[i - x + 1]]
                    common = len(np.intersect1d(last[1], own, assume_unique=True))
                    if 100 * common >= s.percent * (len(own) + len(last[1]) - common):
                        keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])

    return run


def _families(s: Settings):
    """Links between two blocks of a family, as many as join components."""

    def run(table: pa.Table) -> pa.Table:
        column = table["text"].combine_chunks()
        node, label, side = table["node"].to_numpy(), table["label"].to_numpy(), table["side"].to_numpy()
        parts = [shingles(words(column.slice(a, b - a)), s.k) for a, b in slices(column)]
        sizes = np.concatenate([np.diff(f) for _, f in parts])
        values, inverse = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
        row = np.repeat(np.arange(len(sizes)), sizes)
        # Runs of words of one text alone are common to none.
        shared = np.flatnonzero(np.bincount(inverse, minlength=len(values)) > 1)
        place = np.full(len(values), -1)
        place[shared] = np.arange(len(shared))
        at = place[inverse]
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == side.max())
        common = np.zeros((len(x), len(y)), np.float32)
        order = np.argsort(at, kind="stable")
        at, row = at[order], row[order]
        for a in range(0, len(shared), 4096):
            low, high = np.searchsorted(at, [a, a + 4096])
            part = np.zeros((len(sizes), 4096), np.float32)
            part[row[low:high], at[low:high] - a] = 1
            common += part[x] @ part[y].T
        union = sizes[x][:, None] + sizes[y][None, :] - common
        linked = (100 * common.astype(np.int64) >= s.percent * union.astype(np.int64)) & (label[x][:, None] != label[y][None, :])
        over: dict[int, int] = {}

        def root(c: int) -> int:
            while over.get(c, c) != c:
                over[c] = over.get(over[c], over[c])
                c = over[c]
            return c

        links = []
        for i, j in zip(*(z.tolist() for z in np.nonzero(linked)), strict=True):
            p, q = root(int(label[x[i]])), root(int(label[y[j]]))
            if p != q:
                over[max(p, q)] = min(p, q)
                links.append((int(node[x[i]]), int(node[y[j]])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


class Groups:
    """The steps over one table of documents; every step's table is in the shared folder."""

    def __init__(self, docs: DataFrame, s: Settings) -> None:
        bounded_batches(docs.sparkSession)
        self.s = s
        h1, h2 = text_hashes("text")
        self.texts = docs.select(h1.alias("h1"), h2.alias("h2"), F.coalesce("text", F.lit("")).alias("text"))
        kind = docs.schema["doc_id"].dataType.simpleString()
        rows = docs.select("doc_id", h1.alias("h1"), h2.alias("h2"), F.coalesce("text", F.lit("")).alias("text"))
        made = rows.mapInArrow(_sketched(s), f"doc_id {kind}, h1 long, h2 long, n long, s1 long, s2 long, bands array<long>")
        self.rows = stored(made.withColumn("uid", F.monotonically_increasing_id()), "sketches")
        self.classes = stored(self.rows.where("n > 0").groupBy("s1", "s2").agg(F.min("uid").alias("node")), "classes")
        self.nodes = stored(self.rows.join(self.classes.select("node"), F.col("uid") == F.col("node")).select("node", "n", "h1", "h2", "bands"), "nodes")

    def _near(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes and shared bands allow a link."""
        a, b = (self.nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bands").alias(f"bands{c}")) for c in "ab")
        least, most = F.least("na", "nb"), F.greatest("na", "nb")
        return (
            pairs.join(a, "a")
            .join(b, "b")
            .where((100 * least >= self.s.percent * most) & (F.size(F.array_intersect("bandsa", "bandsb")) >= self.s.least_shared()))
            .select("a", "b")
        )

    def _texts(self, nodes: DataFrame) -> DataFrame:
        """(node, text) of distinct nodes; of equal texts only one goes on."""
        wanted = stored(nodes.join(self.nodes.select("node", "h1", "h2"), "node"), "wanted")
        texts = self.texts
        if wanted.count() <= self.s.most_broadcast:
            texts = texts.join(F.broadcast(wanted.select("h1").distinct()), "h1", "left_semi")
        found = stored(texts.dropDuplicates(["h1", "h2"]).join(wanted, ["h1", "h2"]).select("node", "text"), "texts")
        drop_stored(wanted)
        return found

    def _links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that the full sets confirm."""
        near = stored(self._near(pairs), "pairs")
        found = self._texts(near.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        a, b = (found.select(F.col("node").alias(c), F.col("text").alias(f"text{c}")) for c in "ab")
        both = near.join(b, "b").join(a, "a").select("a", "b", "texta", "textb")
        links = stored(both.mapInArrow(_confirmed(self.s), "a long, b long"), "confirmed")
        for t in (near, found):
            drop_stored(t)
        return links

    def _crossing(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """Links between members of one bucket whose components differ. members: key, node, leader, size."""
        known = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"), "leader", "size")
        known = stored(known, "known")
        mixed = stored(known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key"), "mixed")
        # A few keys go to where their members are; a large bucket's members then stay spread.
        open_ = stored(known.join(F.broadcast(mixed) if mixed.count() <= self.s.most_broadcast else mixed, "key"), "open")
        drop_stored(known)
        few = open_.where((F.col("size") <= self.s.most_members) & (F.col("node") != F.col("leader")))
        x, y = (few.select("key", F.col("node").alias(c), F.col("label").alias(f"label{c}")) for c in "ab")
        links = self._links(x.join(y, "key").where((F.col("a") < F.col("b")) & (F.col("labela") != F.col("labelb"))).select("a", "b").distinct())
        many = open_.where(F.col("size") > self.s.most_members)
        if many.limit(1).count():
            links = links.unionByName(self._blocks(many))
        return links

    def _blocks(self, many: DataFrame) -> DataFrame:
        """Links within families, the texts that large buckets bring together, by comparing their blocks two by two."""
        families = components(many.select(F.col("leader").alias("a"), F.col("node").alias("b"))).select("node", F.col("label").alias("family"))
        own = many.select("node", "label").distinct().join(families, "node")
        sizes = own.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / self.s.block).cast("int").alias("blocks"))
        own = stored(own.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "families")
        texts = self._texts(own.select("node"))
        # Block b meets blocks up to itself as the second of two, and from itself on as the first.
        meets = F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda c: F.struct(F.least(c, F.col("block")).alias("first"), F.greatest(c, F.col("block")).alias("second")),
        )
        dealt = own.join(texts, "node").select("family", "node", "label", "text", "block", F.explode(meets).alias("m"))
        dealt = dealt.select("family", "m.first", "m.second", "node", "label", "text", F.when(F.col("block") == F.col("m.first"), 0).otherwise(1).alias("side"))
        return stored(dealt.groupBy("family", "first", "second").applyInArrow(_families(self.s), "a long, b long"), "family_links")

    def labels(self) -> DataFrame:
        """(node, label) of all nodes that have a link."""
        banded = self.nodes.select("node", F.explode("bands").alias("key"))
        leaders = banded.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1")
        members = stored(banded.join(leaders, "key").select("key", "node", "leader", "size"), "members")
        star = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
        first = self._links(star)
        labels = components(first)
        second = self._crossing(members.where("size > 2"), labels)
        drop_stored(members)
        if not second.limit(1).count():
            return labels
        own = labels.select(F.col("node").alias("at"), "label")
        ends = second
        for c in "ab":
            ends = ends.join(own.select(F.col("at").alias(c), F.col("label").alias(f"label{c}")), c, "left").withColumn(f"end{c}", F.coalesce(f"label{c}", c))
        joined = components(ends.select(F.col("enda").alias("a"), F.col("endb").alias("b")))
        over = joined.select(F.col("node").alias("label"), F.col("label").alias("over"))
        known = labels.unionByName(joined.join(labels, "node", "left_anti"))
        return stored(known.join(over, "label", "left").select("node", F.coalesce("over", "label").alias("label")), "labels")

    def result(self) -> DataFrame:
        """uid, doc_id, h1, h2, n_shingles and the component's label, null for an empty set."""
        labels = self.labels()
        classes = self.classes.join(labels, "node", "left").select("s1", "s2", F.coalesce("label", "node").alias("label"))
        blank = self.rows.where("n = 0").select("uid", "doc_id", "h1", "h2", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("label"))
        full = self.rows.where("n > 0").join(classes, ["s1", "s2"]).select("uid", "doc_id", "h1", "h2", F.col("n").alias("n_shingles"), "label")
        return full.unionByName(blank)


def _of_several(rows: DataFrame, value: Column, s: Settings) -> DataFrame:
    """(label, value, several) of labels that several rows have. They are few; a large group's rows stay where they are
    if the table is small enough to be sent to them."""
    out = rows.where("label is not null").groupBy("label").agg(value.alias("value"), F.count(F.lit(1)).alias("n")).where("n > 1")
    out = stored(out.select("label", "value", F.lit(True).alias("several")), "several")
    return F.broadcast(out) if out.count() <= s.most_broadcast else out


def groups(docs: DataFrame, settings: Settings = AT_85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id among the rows that links reach, itself included; kept says whether it is the
    row's own (also where both are null). Null and empty texts, and texts of white space, have no shingles and stand
    alone. Repeated rows and equal texts are one node and share a component; null ids take part, and give a null
    component only where no other id is reached. Other columns are ignored.
    """
    rows = stored(Groups(docs, settings).result(), "grouped")
    least = _of_several(rows, F.min("doc_id"), settings)
    out = rows.join(least, "label", "left").withColumn("component_id", F.when(F.col("several"), F.col("value")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of each group of ``docs``, that with the smallest doc_id (null last), with all columns; rows without words all stay.

    Of repeated rows one stays. Rows are told apart by doc_id and text.
    """
    rows = stored(Groups(docs, settings).result(), "grouped")
    chosen = _of_several(rows, F.min(F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", "uid")), settings)
    kept = rows.join(chosen, "label", "left").withColumn("stays", F.when(F.col("several"), F.col("uid") == F.col("value.uid")).otherwise(True))
    # What goes: rows whose doc_id and text are no kept row's. Only those are named, they are fewer than what stays.
    stays = kept.groupBy("doc_id", "h1", "h2").agg(F.bool_or("stays").alias("stays"), F.count(F.lit(1)).alias("copies"), F.bool_or(F.col("label").isNull()).alias("blank"))
    gone = stored(stays.where(~F.col("stays")).select(F.col("doc_id").alias("_kw_id"), F.col("h1").alias("_kw_h1"), F.col("h2").alias("_kw_h2")), "gone")
    h1, h2 = text_hashes(docs["text"])
    small = gone.count() <= settings.most_broadcast
    left = docs.join(F.broadcast(gone) if small else gone, docs["doc_id"].eqNullSafe(F.col("_kw_id")) & (h1 == F.col("_kw_h1")) & (h2 == F.col("_kw_h2")), "left_anti")
    if not stays.where(F.col("stays") & ~F.col("blank") & (F.col("copies") > 1)).limit(1).count():
        return left
    # Rows repeated with their ids: one of each.
    again = left.withColumns({"_kw_h1": text_hashes("text")[0], "_kw_h2": text_hashes("text")[1], "_kw_own": F.when(F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"), -1).otherwise(F.monotonically_increasing_id())})
    return again.dropDuplicates(["doc_id", "_kw_h1", "_kw_h2", "_kw_own"]).select(*docs.columns)
