import hashlib
import itertools
import math
import random
import re
import time

import pytest

from kilnwork.llm import secrets as s


def brute(text):
    """The base kinds by their plain patterns, position by position."""
    out = []
    for kind, pattern in (("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")):
        p, at = re.compile(pattern, re.ASCII | (re.IGNORECASE if kind == "assign" else 0)), 0
        while at < len(text):
            m = p.match(text, at)
            if not m:
                at += 1
                continue
            if {"assign": lambda: len(m[2]) >= 12, "access": lambda: len(m[0]) >= 18, "hex": lambda: len(m[0]) >= 16}[kind]():
                out.append((m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}"))
            at = m.end()
    return ",".join(x for _, _, x in sorted(out))


def texts():
    rng = random.Random(5)
    parts = ["password", "PASSWD", "Secret", "token", "api_key", "ApiKey", "\"", "'", " ", "  ", "\n", "=", ":", "AKIA", "AKIA" + "Z9" * 8, "0123456789abcdef", "deadbeef", "abcDEF123+/", "x" * 13, "é", "ſecret=", "toKen", "_", "12"]
    return ["", "token=" + "a" * 12, "token=" + "a" * 11, "İtoken = abcdefghijklmnop"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(3000)]


def test_base_spans_against_brute_force():
    for t in texts():
        assert s.joined(s.base_spans(t)) == brute(t), repr(t)


def every_segmentation(value, rank):
    """The cheapest of all ways to cut a value, each part at its cheapest kind, kind by kind."""
    low = value.lower()
    plain, each = low.translate(s.LEET), s._alphabet(value)

    def part(i, j):
        n, out = j - i, [(j - i) * each]
        if all(s._walks(low[k], low[k + 1]) for k in range(i, j - 1)):
            out.append(s.WALK + n - 1)
        if len(set(low[i:j])) == 1:
            out.append(each + 1 + s.RUN * (n - 1))
        if 3 <= n and plain[i:j] in rank:
            out.append(s._word_bits(value[i:j], low[i:j], plain[i:j], rank[plain[i:j]]))
        if n in (4, 6, 8, 10) and (bits := s._date_bits(value[i:j])) is not None:
            out.append(bits)
        if 2 <= n <= min(16, i) and low[i - n : i] == low[i:j]:
            out.append(1)
        return s.SEGMENT + min(out)

    n, best = len(value), math.inf
    for cuts in itertools.product([0, 1], repeat=n - 1):
        at = [0, *[k + 1 for k, c in enumerate(cuts) if c], n]
        best = min(best, sum(part(a, b) for a, b in zip(at, at[1:])))
    return min(best, s.MOST_BITS)


def test_guess_cost_against_every_segmentation():
    rng = random.Random(3)
    rank = s.RANK | {"vorstand": 400, "andere": 500}
    parts = ["love", "P4ss", "Key", "qwe", "123", "2019", "1231", "aa", "abab", "x", "Z", "9", "!", "vorstand", "AnDere"]
    values = ["".join(rng.choice(parts) for _ in range(4))[: rng.randint(1, 11)] for _ in range(120)]
    for v in values:
        assert s.guess_bits(v, rank) == pytest.approx(every_segmentation(v, rank)), v


def test_guess_cost_orders_values():
    cheap = ["password", "Password1", "qwertyuiop", "aaaaaaaaaaaa", "20240131", "31-12-1999", "abcabcabcabc", "p@ssw0rd2023", "changeme123", "letmein!"]
    dear = ["x9$Kq2!vLp0z", "Tr7#mmQw82pLzz", "zRk4vN8sQwJ2", "9f8e7d1c2b3a4f5e6d", "x7Kq9ZpL"]
    assert max(map(s.guess_bits, cheap)) < s.LEAST_BITS < min(map(s.guess_bits, dear))
    assert s.guess_bits("") == 0 and s.guess_bits("aa") <= s.guess_bits("ab9") <= s.guess_bits("ab9Zk")


def test_long_values_and_many_spans_take_little_time():
    rng = random.Random(4)
    began = time.time()
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    assert s.guess_bits("".join(rng.choice(letters) for _ in range(1_000_000))) == s.MOST_BITS == s.guess_bits("a" * 1_000_000)
    lines = [f"pwd: {''.join(rng.choice(letters) for _ in range(14))} token={''.join(rng.choice(letters) for _ in range(14))}" for _ in range(8000)]
    base, spans, _ = s.find("\n".join(lines))
    assert len(base) == 8000 and len(spans) == 16_000 and time.time() - began < 20


def test_dictionary_of_the_corpus(spark):
    rows = [(f"Wahrscheinlichkeit und noch {'selten' if i < 5 else 'mehr'} x1y2 Wahrscheinlichkeit",) for i in range(30)] + [(None,), ("",)]
    rank = s.dictionary(spark.createDataFrame(rows, "text string").repartition(5), least=10)
    assert {w: r - len(s.RANK) for w, r in rank.items() if w not in s.RANK} == {"noch": 1, "wahrscheinlichkeit": 2, "mehr": 3}
    text = "pwd: Wahrscheinlichkeit"
    assert s.find(text)[1] and not s.find(text, rank=rank)[1]
    assert s.dictionary(spark.createDataFrame([], "text string")) == s.RANK


def test_guessed_spans_and_redaction():
    text = 'login\npwd: "x9$Kq2!vLp0z" and pwd: password123 token = 0123456789abcdef01 end'
    base, spans, most = s.find(text)
    assert [k for _, _, k in spans] == ["guess", "assign", "hex"] and set(base) < set(spans) and most > s.LEAST_BITS
    assert s.redacted(text, spans) == 'login\npwd: "[SECRET]" and pwd: password123 [SECRET] end'


def test_documents(spark):
    rows = [(1, "token=" + "a1" * 10, "c"), (1, "token=" + "a1" * 10, "c"), (2, None, "c"), (None, "", "c"), (4, "word " * 50_000 + "AKIA" + "B" * 16, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(repr(tuple(r)[:6]) for r in s.scan(docs).collect())
    expected = []
    for i, t, _ in rows:
        b = brute(t or "")
        expected.append(repr((i, b.count("assign"), b.count("access"), b.count("hex"), hashlib.sha256(b.encode()).hexdigest(), b)))
    assert got == sorted(expected)
    clean = s.redact(docs)
    assert clean.schema == docs.schema and clean.where("doc_id = 1").first().text == "[SECRET]" and clean.where("doc_id = 2").first().text is None
    assert s.scan(docs.limit(0)).count() == 0 == s.redact(docs.limit(0)).count()


def test_values_that_base_spans_cover_in_part():
    for text, left in (("password=Abcdef123456$Tail!x9Q end", "[SECRET] end"), ("pwd: Zq7!k9" + "0123456789abcdef" + " end", "pwd: [SECRET] end"), ("pwd: " + "0123456789abcdef" + "$Tail!x9Q", "pwd: [SECRET]")):
        base, spans, _ = s.find(text)
        assert base == s.base_spans(text) and [k for _, _, k in spans].count("guess") == 1
        assert s.redacted(text, spans) == left
    text = "token=x9Kq2vLp0zTr7mm"
    assert [k for _, _, k in s.find(text)[1]] == ["assign"]
