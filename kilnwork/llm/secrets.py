"""Secret scans: key patterns, and values in credential contexts that are costly to guess.

The guess cost of a value is that of its cheapest segmentation into dictionary words, dates, repeats, keyboard walks
or sequences, and brute-force spans; a dynamic program over the value's prefixes finds it. Costs are in bits. The
dictionary has common parts of passwords, and after them the corpus's own words, those that most documents have: what
stands in many texts is soon guessed.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.llm.shared import bounded_batches

#: Patterns of the base kinds, in order, and the least length of what they must match (fixed values).
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

KINDS = ("assign", "access", "hex", "guess")
#: A value after one of these, of LEAST_VALUE characters and LEAST_BITS of guess cost, is taken for a secret.
CONTEXT = re.compile(
    r"(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|bearer|auth(?:orization)?|(?:api|access|private|secret|client|auth)[_ -]?(?:key|secret|token))"
    r"[\"']?\s{0,3}(?::=|=>|[:=]|\bis\b)\s{0,3}[\"']?([^\s\"'<>,;]+)",
    re.IGNORECASE | re.ASCII,
)
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth")
LEAST_VALUE, LEAST_BITS = 8, 40.0
#: Costs are counted up to so many bits: beyond, a value is as good as random.
MOST_BITS = 256.0
#: Words of the corpus in the dictionary: the commonest of this many letters that at least so many documents have.
MOST_WORDS, LEAST_LETTERS, MOST_LETTERS, LEAST_DOCUMENTS = 30_000, 4, 20, 20

#: Common parts of passwords, commonest first (fixed values).
WORDS = """password admin welcome login letmein qwerty dragon monkey master hello love secret token change changeme default test
guest root user pass access account service server system network internet computer office windows linux oracle mysql postgres
database backup private public summer winter spring autumn monday friday sunday january february march april may june july august
september october november december football baseball soccer hockey sunshine princess shadow superman batman starwars pokemon
michael daniel thomas robert charlie jordan ashley jessica andrew george james john david maria anna laura flower freedom money
house family friend angel cookie chocolate coffee orange apple banana purple yellow green blue black white silver golden diamond
tiger eagle lion wolf horse chicken company manager security support example sample demo temp none null true false value string
key api auth your here insert enter placeholder dummy redacted hidden""".split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LEET = str.maketrans("@4301!$5+7", "aaeoiisstt")
PLAIN = re.compile(rf"(?<![a-z0-9])[a-z]{{{LEAST_LETTERS},{MOST_LETTERS}}}(?![a-z0-9])")
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
#: Bits for choosing what the next segment is.
SEGMENT = 2.0
#: Bits for a walk's first key, length and direction (each step takes one more), and for each repetition of a character.
WALK, RUN = math.log2(47) + 4, 0.5


def _walks(a: str, b: str) -> bool:
    """Whether b follows a on the keyboard or in the alphabet or digits."""
    p, q = _PLACE.get(a), _PLACE.get(b)
    near = p is not None and q is not None and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1
    return near or (a.isalnum() and b.isalnum() and abs(ord(a) - ord(b)) == 1)


def _alphabet(value: str) -> float:
    """Bits of one character of the value: of all kinds of characters that it has."""
    kinds = (
        26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value) + 10 * any("0" <= c <= "9" for c in value)
        + 33 * any(c.isascii() and not c.isalnum() for c in value) + 1000 * (not value.isascii())
    )
    return math.log2(kinds)


def _date_bits(s: str) -> float | None:
    """The cost of digits, with or without separators, as a year or a date."""
    if re.fullmatch(r"(?:19|20)\d\d", s):
        return math.log2(200)
    m = re.fullmatch(r"(\d{4})([-/._]?)(\d\d)\2(\d\d)|(\d\d)([-/._]?)(\d\d)\6(\d{4}|\d\d)", s)
    if not m:
        return None
    year, a, b = (m[1], m[3], m[4]) if m[1] else (m[8], m[5], m[7])
    good = (len(year) == 2 or 1900 <= int(year) <= 2099) and 1 <= min(int(a), int(b)) <= 12 and 1 <= max(int(a), int(b)) <= 31
    return math.log2(365 * (100 if len(year) == 2 else 200)) + 2 if good else None


def _word_bits(part: str, low: str, plain: str, rank: int) -> float:
    """A dictionary word's cost: its rank, letters written as others, and capitals (the first or all are usual)."""
    changed = sum(a != b for a, b in zip(low, plain, strict=True))
    capitals = 0 if part == low else 1 if (part[0] != low[0] and part[1:] == low[1:]) or part.isupper() else 3
    return math.log2(rank + 1) + changed + capitals


def guess_bits(value: str, rank: dict[str, int] = RANK) -> float:
    """The bits of the cheapest segmentation, at most MOST_BITS; 0 for an empty value."""
    if not value:
        return 0.0
    n, low = len(value), value.lower() if len(value.lower()) == len(value) else value
    plain, each = low.translate(LEET), _alphabet(value)
    longest = MOST_LETTERS
    reach = max(longest, 2 * 16)
    best = [0.0] + [math.inf] * n
    brute = walk = run = math.inf  # cheapest if a brute-force span, a walk, or a run of one character ends here
    for i in range(1, n + 1):
        brute = min(best[i - 1] + SEGMENT, brute) + each
        walk = min(walk + 1 if i > 1 and _walks(low[i - 2], low[i - 1]) else math.inf, best[i - 1] + SEGMENT + WALK)
        run = min(run + RUN if i > 1 and low[i - 2] == low[i - 1] else math.inf, best[i - 1] + SEGMENT + each + 1)
        cost = min(brute, walk, run)
        for size in range(3, min(longest, i) + 1):
            j = i - size
            known = rank.get(plain[j:i])
            if known is not None:
                cost = min(cost, best[j] + SEGMENT + _word_bits(value[j:i], low[j:i], plain[j:i], known))
        for size in (4, 6, 8, 10):
            if size <= i and (value[i - 1].isdigit() and value[i - size].isdigit()) and (bits := _date_bits(value[i - size : i])) is not None:
                cost = min(cost, best[i - size] + SEGMENT + bits)
        for size in range(2, min(16, i // 2) + 1):
            # A block that came just before, once more.
            if low[i - size : i] == low[i - 2 * size : i - size]:
                cost = min(cost, best[i - size] + SEGMENT + 1)
        best[i] = cost
        # All that follows goes on from one of these, and no step lowers a cost.
        if cost >= MOST_BITS and min(brute, walk, run, *best[max(0, i - reach) : i]) >= MOST_BITS:
            return MOST_BITS
    return min(best[n], MOST_BITS)


def dictionary(docs: DataFrame, most: int = MOST_WORDS, least: int = LEAST_DOCUMENTS) -> dict[str, int]:
    """Ranks of WORDS, and after them of the ``most`` words of ASCII letters that most rows of ``docs`` (text) have, at
    least ``least``; of equal counts in order."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(set(PLAIN.findall((text or "").lower())))
            if len(held) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    counts = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most).collect()
    new = [r["word"] for r in rows if r["word"] not in RANK]
    return RANK | {w: len(RANK) + i + 1 for i, w in enumerate(new)}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start and then kind as listed."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low or not text.isascii():
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return _ordered(out)


def _ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _union(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Begins and ends of what spans, ordered by start, cover together."""
    begins: list[int] = []
    ends: list[int] = []
    for a, b, _ in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    return begins, ends


def guessed_spans(text: str, taken: list[tuple[int, int, str]], least_bits: float = LEAST_BITS, rank: dict[str, int] = RANK) -> tuple[list[tuple[int, int, str]], float]:
    """Costly values in credential contexts that taken spans don't cover entirely, and the highest cost of any such value."""
    low, out, most = text.lower(), [], 0.0
    if any(h in low for h in HINTS):
        begins, ends = _union(taken)
        for m in CONTEXT.finditer(text):
            if len(m[1]) < LEAST_VALUE:
                continue
            bits = guess_bits(m[1], rank)
            most = max(most, bits)
            k = bisect.bisect_right(begins, m.start(1)) - 1
            if bits >= least_bits and not (k >= 0 and m.end(1) <= ends[k]):
                out.append((m.start(1), m.end(1), "guess"))
    return out, most


def find(text: str | None, least_bits: float = LEAST_BITS, rank: dict[str, int] = RANK) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], float]:
    """Base spans, all spans, and the highest guess cost."""
    text = text or ""
    base = base_spans(text)
    more, most = guessed_spans(text, base, least_bits, rank)
    return base, _ordered(base + more), most


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with each stretch that spans cover replaced by the mark."""
    out, at = [], 0
    for a, b, _ in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


_SCAN = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, most_bits double"


def scan(docs: DataFrame, least_bits: float = LEAST_BITS) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, counts of the base kinds, the SHA-256 of the joined base spans,
    all spans joined, the number of guessed ones and the highest guess cost.

    The dictionary is that of ``docs``. Spans are kind:start:end in code points. A null text is empty; rows without spans have zeros, the digest of the
    empty string and an empty string. Repeated rows and null ids each get their answer; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(dictionary(docs))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_SCAN}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, spans, most = find(text.as_py(), least_bits, sent.value)
                kinds = [k for _, _, k in base]
                rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base), most))
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "most_bits"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact(docs: DataFrame, least_bits: float = LEAST_BITS, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span in text replaced by the mark; null texts stay null, other rows and columns as they are."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(dictionary(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [None if (t := x.as_py()) is None else redacted(t, find(t, least_bits, sent.value)[1], mark) for x in batch.column(at)]
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.schema)
