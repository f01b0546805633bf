"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round looks up the rank of every adjacent pair by binary search
over the sorted pair keys, takes each word's lowest rank, and merges all its occurrences from left to right. That is
the order of the usual one-at-a-time merging, because every token comes from exactly one merge and so every pair that
a merge makes has a higher rank than the merge itself (``load`` checks this).
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kilnwork.llm.shared import bounded_batches

#: Words kept with their encodings by one Python worker.
CACHE = 200_000
#: Longest word, in symbols, that is merged in rounds over whole words.
LONG = 256
_NONE = np.int64(1) << 40


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


@dataclass
class Vocabulary:
    tokens: list[str]
    special: dict[str, int]
    single: np.ndarray  # id of each byte within a word
    last: np.ndarray  # id of each byte at a word's end
    keys: np.ndarray  # sorted (left << 32 | right)
    ranks: np.ndarray
    merged: np.ndarray
    words: regex.Pattern
    cuts: re.Pattern | None

    def __post_init__(self) -> None:
        self.known: dict[str, str] = {}
        self.shown: dict[str, str] = {}


@functools.lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """Read a tokenizer file with NFC, lower case, white space removed, byte-level symbols and word ends."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    vocab, suffix = model["vocab"], model["end_of_word_suffix"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [""] * (1 + max([*vocab.values(), *special.values()]))
    for t, i in {**vocab, **special}.items():
        tokens[i] = t
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    left, right = np.array([vocab[a] for a, _ in pairs], np.int64), np.array([vocab[b] for _, b in pairs], np.int64)
    merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
    made = np.full(len(tokens), -1, np.int64)
    made[merged] = np.arange(len(pairs))
    if len(set(merged.tolist())) != len(pairs) or (np.maximum(made[left], made[right]) >= np.arange(len(pairs))).any():
        raise ValueError("merges are not in the order of their making")
    keys = left << 32 | right
    order = np.argsort(keys)
    symbols = byte_symbols()
    split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return Vocabulary(
        tokens, special, np.array([vocab[s] for s in symbols]), np.array([vocab[s + suffix] for s in symbols]), keys[order], order.astype(np.int64), merged[order],
        regex.compile(split.replace(r"[^\s", r"[^\p{White_Space}")), re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None,
    )


def _looked_up(left: np.ndarray, right: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each pair, _NONE without one, and the place of its merge."""
    key = left << 32 | right
    at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
    return np.where(v.keys[at] == key, v.ranks[at], _NONE), at


def _every_second(places: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of ascending places, those that merge: in a run, in which each is the ``after`` of the one before, every second from the first on."""
    new = np.concatenate([[True], places[1:] != after[:-1]])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))
    return (np.arange(len(places)) - begin) % 2 == 0


def merge_words(words: list[bytes], v: Vocabulary) -> list[list[int]]:
    """The token ids of each word (not empty)."""
    long_ = [i for i, w in enumerate(words) if len(w) > LONG]
    out: list[list[int]] = [[]] * len(words)
    for i, ids in zip(long_, merge_long([words[i] for i in long_], v), strict=True):
        out[i] = ids
    short = np.array([i for i, w in enumerate(words) if len(w) <= LONG], np.int64)
    sizes = np.array([len(words[i]) for i in short], np.int64)
    ids, ends = _symbols(b"".join([words[i] for i in short]), sizes, v)
    word = np.repeat(short, sizes)
    while len(ids):
        inner = word[1:] == word[:-1]
        rank = np.full(len(ids), _NONE, np.int64)
        found, at = _looked_up(ids[:-1], ids[1:], v)
        rank[:-1] = np.where(inner, found, _NONE)
        head = np.flatnonzero(np.concatenate([[True], ~inner]))
        low = np.minimum.reduceat(rank, head)
        size = np.diff(np.append(head, len(ids)))
        for i, a, n in zip(word[head[low == _NONE]].tolist(), head[low == _NONE].tolist(), size[low == _NONE].tolist(), strict=True):
            out[i] = ids[a : a + n].tolist()
        chosen = np.flatnonzero((rank == np.repeat(low, size)) & (rank != _NONE))
        if len(chosen):
            chosen = chosen[_every_second(chosen, chosen + 1)]
            ids[chosen] = v.merged[at[chosen]]
        keep = np.repeat(low != _NONE, size)
        keep[chosen + 1] = False
        ids, word = ids[keep], word[keep]
    return out


def _symbols(joined: bytes, sizes: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words' bytes, and the words' ends."""
    flat, ends = np.frombuffer(joined, np.uint8), np.cumsum(sizes)
    ids = v.single[flat]
    ids[ends - 1] = v.last[flat[ends - 1]]
    return ids, ends


def merge_long(words: list[bytes], v: Vocabulary) -> list[list[int]]:
    """As merge_words, in rounds by rank over a linked list of symbols."""
    if not words:
        return []
    ids, ends = _symbols(b"".join(words), np.array([len(w) for w in words], np.int64), v)
    n = len(ids)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends - 1] = n  # n: none
    before[np.concatenate([[0], ends[:-1]])] = n
    rank = np.full(n + 1, _NONE)
    waiting: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def look(places: np.ndarray) -> None:
        """Find the ranks of the pairs that begin at these places, and put them to wait."""
        right = after[places]
        inner = right < n
        rank[places[~inner]] = _NONE
        places, right = places[inner], right[inner]
        found, _ = _looked_up(ids[places], ids[right], v)
        rank[places] = found
        some = found != _NONE
        places, found = places[some], found[some]
        order = np.argsort(found, kind="stable")
        places, found = places[order], found[order]
        cuts = np.flatnonzero(np.diff(found)) + 1
        for r, part in zip(found[np.concatenate([[0], cuts])].tolist() if len(found) else [], np.split(places, cuts), strict=False):
            if r not in waiting:
                heapq.heappush(heap, r)
                waiting[r] = []
            waiting[r].append(part)

    look(np.arange(n))
    while heap:
        r = heapq.heappop(heap)
        places = np.unique(np.concatenate(waiting.pop(r)))
        # Pairs that an earlier round changed or took away wait under their new rank, if any.
        places = places[rank[places] == r]
        if not len(places):
            continue
        places = places[_every_second(places, after[places])]
        gone = after[places]
        _, at = _looked_up(ids[places], ids[gone], v)
        ids[places] = v.merged[at]
        rank[gone] = _NONE
        follow = after[gone]
        after[places] = follow
        before[follow[follow < n]] = places[follow < n]
        ids[gone] = -1
        left = before[places]
        look(np.unique(np.concatenate([places, left[left < n]])))
    kept = ids >= 0
    return [part[keep].tolist() for part, keep in zip(np.split(ids, ends[:-1]), np.split(kept, ends[:-1]), strict=True)]


def _normal(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # one character at a time: no final sigma
    return text.lower()


def pieces(text: str, v: Vocabulary) -> Iterator[tuple[list[str], str | None]]:
    """The words up to each special token, and that token; None after the last."""
    parts = v.cuts.split(text) if v.cuts and "<" in text else [text]
    for i in range(0, len(parts), 2):
        yield v.words.findall(_normal(parts[i])), parts[i + 1] if i + 1 < len(parts) else None


def encode(texts: list[str], v: Vocabulary) -> list[tuple[str, str]]:
    """For each text its ids in decimal and its decoding, each joined by one space."""
    split = [list(pieces(t, v)) for t in texts]
    here = {w for parts in split for ws, _ in parts for w in ws}
    if len(v.known) > CACHE:
        # Words of this batch, the common ones among them, stay.
        for held in (v.known, v.shown):
            kept = {w: held[w] for w in here if w in held}
            held.clear()
            held.update(kept)
    new = list(here.difference(v.known))
    for at in range(0, len(new), 50_000):
        some = new[at : at + 50_000]
        for w, ids in zip(some, merge_words([w.encode() for w in some], v), strict=True):
            v.known[w] = " ".join(map(str, ids))
            v.shown[w] = " ".join([v.tokens[i] for i in ids])
    out = []
    for parts in split:
        ids, text = [], []
        for ws, token in parts:
            ids += map(v.known.__getitem__, ws)
            text += map(v.shown.__getitem__, ws)
            if token is not None:
                ids.append(str(v.special[token]))
                text.append(token)
        out.append((" ".join(ids), " ".join(text)))
    return out


def ids_of(joined: str) -> list[int]:
    return [int(x) for x in joined.split()]


def decode(ids: Iterable[int], v: Vocabulary) -> str:
    """Tokens joined by one space; special tokens stay."""
    return " ".join([v.tokens[i] for i in ids])


def _batches(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) with token_ids array<int>, n_tokens long and decoded_sha256, the lowercase
    hex digest of the decoding in UTF-8.

    A null or empty text has no tokens and an empty decoding. Rows, repeated ones too, each get their answer; columns
    of the input with the names of the results are replaced. ``path`` must be readable on every executor.
    """

    def made(coded: list[tuple[str, str]]) -> list[pa.Array]:
        n = _sizes(coded)
        flat = np.fromstring(" ".join([ids for ids, _ in coded if ids]), np.int32, sep=" ") if n.any() else np.zeros(0, np.int32)
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(n), _digests([shown for _, shown in coded])]

    return _mapped(docs, path, text, keep, made, [("token_ids", T.ArrayType(T.IntegerType())), ("n_tokens", T.LongType()), ("decoded_sha256", T.StringType())])


def digest_documents(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """As ``encode_documents``, with n_tokens, ids_sha256, the digest of the ids joined by spaces, and decoded_sha256."""

    def made(coded: list[tuple[str, str]]) -> list[pa.Array]:
        return [pa.array(_sizes(coded)), _digests([ids for ids, _ in coded]), _digests([shown for _, shown in coded])]

    return _mapped(docs, path, text, keep, made, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())])


def _sizes(coded: list[tuple[str, str]]) -> np.ndarray:
    return np.array([ids.count(" ") + 1 if ids else 0 for ids, _ in coded], np.int64)


def _digests(texts: list[str]) -> pa.Array:
    return pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])


def _mapped(docs: DataFrame, path: str, text: str, keep: list[str] | None, made, fields: list[tuple[str, T.DataType]]) -> DataFrame:
    bounded_batches(docs.sparkSession)
    names = [n for n, _ in fields]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(path)
        for batch in batches:
            at = 0
            for some in _batches([t or "" for t in batch.column("_kw_text").to_pylist()]):
                columns = [batch.column(c).slice(at, len(some)) for c in kept]
                yield pa.RecordBatch.from_arrays(columns + made(encode(some, v)), [*kept, *names])
                at += len(some)

    return docs.select(*[docs[c] for c in kept], docs[text].alias("_kw_text")).mapInArrow(run, schema)
