"""Document fingerprints from prefix polynomial hashes.

``Prefixes`` holds, for one text, the sums of c[j] * B**j modulo 2**31 - 1 over each prefix, for two bases. Any span's
hash follows from two entries, whatever its place, so span equality takes constant time and the longest common
extension of two places takes a binary search.

A fingerprint has the number of code points, the hash of the whole text and a sketch: the SKETCH smallest hashes of the
distinct spans of SPAN code points (a shorter text is one span). Two fingerprints' likeness is 1 if the whole texts'
hashes agree, and otherwise the share of common spans that the sketches estimate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnwork.llm.shared import bounded_batches
from kilnwork.llm.textops import mix
from kilnwork.session import partitions_for

U = np.uint64
PRIME = (1 << 31) - 1
BASES = (1_234_567_891, 987_654_323)
SPAN = 16
SKETCH = 48

_tables: dict[str, list[np.ndarray]] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, in 0 to PRIME - 1."""
    x = (x & U(PRIME)) + (x >> U(31))
    x = (x & U(PRIME)) + (x >> U(31))
    x[x == U(PRIME)] = U(0)
    return x


def _power_tables(n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """B**i and its inverse below n, for both bases; doubled as needed."""
    if not _tables or len(_tables["up"][0]) < n:
        size = max(n, 1 << 14, 2 * len(_tables["up"][0]) if _tables else 0)
        for key, bases in (("up", BASES), ("down", [pow(b, -1, PRIME) for b in BASES])):
            _tables[key] = []
            for b in bases:
                t = np.ones(1, U)
                while len(t) < size:
                    t = np.concatenate([t, _fold(t * U(pow(b, len(t), PRIME)))])
                _tables[key].append(t)
    return _tables["up"], _tables["down"]


class Prefixes:
    """Prefix hashes of a text."""

    def __init__(self, text: str) -> None:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U) + U(1)
        self.n = len(codes)
        up, self.down = _power_tables(self.n + 1)
        self.sums = []
        for t in up:
            total = np.zeros(self.n + 1, U)
            np.cumsum(_fold(codes * t[: self.n]), out=total[1:])
            self.sums.append(_fold(total))

    def span(self, begin: int, size: int) -> tuple[int, int]:
        """The hash of a span: equal for equal spans."""
        return tuple((int(s[begin + size]) - int(s[begin])) * int(d[begin]) % PRIME for s, d in zip(self.sums, self.down, strict=True))

    def same(self, begin: int, other: Prefixes, at: int, size: int) -> bool:
        return self.span(begin, size) == other.span(at, size)

    def extension(self, begin: int, other: Prefixes, at: int, most: int | None = None) -> int:
        """How far the texts agree from these places on."""
        low, high = 0, min(self.n - begin, other.n - at, self.n if most is None else most)
        while low < high:
            mid = (low + high + 1) // 2
            if self.same(begin + low, other, at + low, mid - low):
                low = mid
            else:
                high = mid - 1
        return low

    def spans(self, size: int = SPAN) -> np.ndarray:
        """Mixed 64-bit hashes of all spans of a size; of the whole text if it is shorter, of none if it is empty."""
        k = min(size, self.n)
        if not k:
            return np.zeros(0, U)
        m = self.n - k + 1
        a, b = (_fold(_fold(s[k:] - s[:m] + U(PRIME)) * d[:m]) for s, d in zip(self.sums, self.down, strict=True))
        return mix((a << U(31)) | b)


def sketch(hashes: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """The smallest distinct hashes, by their upper 32 bits."""
    if len(hashes) > 8 * size:
        least = np.unique(hashes[hashes < U(int(3 * size / len(hashes) * 2**64))] >> U(32))
        if len(least) >= size:
            return least[:size]
    return np.unique(hashes >> U(32))[:size]


def fingerprint(n: int, whole: tuple[int, int], least: np.ndarray) -> str:
    return f"{n:x}.{whole[0]:08x}{whole[1]:08x}." + "".join([f"{x:08x}" for x in least.tolist()])


def likeness(a: str, b: str, size: int = SKETCH) -> float:
    """Of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    x, y = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (a.rpartition(".")[2], b.rpartition(".")[2]))
    both = sorted(x | y)[:size]
    return sum(h in x and h in y for h in both) / len(both) if both else 0.0


def edited_text(text: str, following: str) -> str:
    """The text whose last half gives way to the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pair(text: str, own: Prefixes, hashes: np.ndarray, following: str, other: Prefixes, others: np.ndarray) -> tuple:
    """The result's columns of one document, from its own prefix hashes and those of the next."""
    n, half = own.n, own.n // 2
    edited = edited_text(text, following)
    begin = n - half
    taken = len(edited) - begin
    mark = fingerprint(n, own.span(0, n), sketch(hashes))
    after = fingerprint(other.n, other.span(0, other.n), sketch(others))
    if begin >= SPAN and taken >= SPAN:
        # Spans of the edited text: those of the text's part, those of the next one's part, and those over the seam.
        seam = Prefixes(edited[begin - SPAN + 1 : begin + SPAN - 1]).spans()
        parts = np.concatenate([hashes[: begin - SPAN + 1], seam, others[: taken - SPAN + 1]])
        whole = tuple((int(s[begin]) + int(o[taken]) * pow(b, begin, PRIME)) % PRIME for s, o, b in zip(own.sums, other.sums, BASES, strict=True))
    else:
        p = Prefixes(edited)
        parts, whole = p.spans(), p.span(0, p.n)
    edited_mark = fingerprint(len(edited), whole, sketch(parts))
    common = begin + own.extension(begin, other, 0, taken)
    return n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark, edited_mark, likeness(mark, edited_mark), likeness(mark, after), common


_MADE = [("n_chars", T.LongType(), pa.int64()), ("edited_sha256", T.StringType(), pa.string()), ("fingerprint", T.StringType(), pa.string()), ("edited_fingerprint", T.StringType(), pa.string()), ("near_edited", T.DoubleType(), pa.float64()), ("near_next", T.DoubleType(), pa.float64()), ("edit_common_prefix", T.LongType(), pa.int64())]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one bucket in order, the bucket's own first, then those borrowed from the next bucket."""
    ids: list = []
    made: list[tuple] = []
    before = None
    ended = False
    for batch in batches:
        for doc_id, text, borrowed in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["borrowed"].to_pylist(), strict=True):
            if ended:
                continue
            prefixes = Prefixes(text)
            now = (doc_id, text, prefixes, prefixes.spans())
            if before is not None:
                ids.append(before[0])
                made.append(_pair(before[1], before[2], before[3], text, now[2], now[3]))
            before, ended = now, bool(borrowed)
        if len(made) >= 1000:
            yield _batch(ids, made)
            ids, made = [], []
    if made:
        yield _batch(ids, made)


def _batch(ids: list, made: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())] + [pa.array([r[i] for r in made], kind) for i, (_, _, kind) in enumerate(_MADE)], ["doc_id", *[n for n, _, _ in _MADE]])


class Ranges:
    """The first keys of ranges of rows in order: null ids first, then ids, rows of one id by a hash of the text."""

    def __init__(self, ids: np.ndarray, blank: np.ndarray, hashes: np.ndarray) -> None:
        order = np.lexsort((hashes, ids, ~blank))
        self.ids, self.blank, self.hashes = ids[order], blank[order], hashes[order]
        self.n_blank = int(blank.sum())

    def __len__(self) -> int:
        return len(self.ids)

    def of(self, ids: np.ndarray, blank: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's range, and whether its key is the range's first."""
        named = self.ids[self.n_blank :]
        low = np.where(blank, 0, self.n_blank + np.searchsorted(named, ids, "left"))
        high = np.where(blank, self.n_blank, self.n_blank + np.searchsorted(named, ids, "right"))
        at = low - 1
        # Ids that begin a range, perhaps amid their rows, or several: those ranges are told apart by the hash.
        one = high == low + 1
        at[one] += hashes[one] >= self.hashes[low[one]]
        for begin, end in set(zip(low[high > low + 1].tolist(), high[high > low + 1].tolist(), strict=True)):
            rows = np.flatnonzero((low == begin) & (high == end))
            at[rows] = begin + np.searchsorted(self.hashes[begin:end], hashes[rows], "right") - 1
        at = np.maximum(at, 0)
        return at, (self.blank[at] == blank) & (blank | (self.ids[at] == ids)) & (self.hashes[at] == hashes)


_KEYS = "doc_id long, blank boolean, hash long"


def _first_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of a partition that is in order."""
    for batch in batches:
        if len(batch):
            yield batch.slice(0, 1)
            return


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and edit_common_prefix of
    each row of ``docs`` (doc_id long, text string), held against the next one by ascending doc_id, after the last the first.

    Null ids come first, rows of one id by a hash of their text and then by the text, repeated rows one after another; a
    null text is empty; a lone row is its own next one. Two empty texts have a likeness of 1, an empty and another of 0.
    Other columns are ignored.

    Keys alone are sorted first, into ranges at bounds that the sort samples; the ranges' first keys, a bounded number,
    come to the driver. Each range then becomes one partition (texts are moved once), and gets besides the first row of
    the next range. Rows of one id are cut like any others; only equal rows stay together.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    n = ranges or partitions_for(rows)
    keys = rows.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("blank"), "hash")
    order = [F.col("blank").desc(), "doc_id", "hash"]
    heads = keys.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_first_key, _KEYS).toArrow() if n > 1 else keys.orderBy(*order).limit(1).toArrow()
    found = Ranges(*[heads[c].to_numpy() for c in ("doc_id", "blank", "hash")])
    sent, size = spark.sparkContext.broadcast(found), max(1, len(found))

    @F.pandas_udf("struct<at:int,first:boolean>")
    def place(ids: pd.Series, blank: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        at, first = sent.value.of(ids.to_numpy(), blank.to_numpy(), hashes.to_numpy())
        return pd.DataFrame({"at": at.astype(np.int32), "first": first})

    own = F.struct(F.col("place.at").alias("part"), F.lit(0).alias("borrowed"))
    lent = F.struct(F.pmod(F.col("place.at") - 1, F.lit(size)).alias("part"), F.lit(1).alias("borrowed"))
    dealt = (
        rows.withColumn("place", place(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.col("hash")))
        .withColumn("to", F.explode(F.when(F.col("place.first"), F.array(own, lent)).otherwise(F.array(own))))
        .select("doc_id", "text", "hash", F.col("to.part").alias("part"), F.col("to.borrowed").alias("borrowed"))
        .repartitionById(size, "part")
        .sortWithinPartitions("borrowed", "doc_id", "hash", "text")
    )
    return dealt.select("doc_id", "text", "borrowed").mapInArrow(_walk, T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(m, t) for m, t, _ in _MADE]))
