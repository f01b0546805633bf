import math
import random
import re
from collections import Counter

import pytest

from kilnwork.llm import licenses as li

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for label, p in li.BASE for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(ws), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def texts():
    rng = random.Random(4)
    parts = ["under the MIT license", "Under", "the", "mit", "license", "Apache License, Version 2.0", "apache", "version", "2", "CC BY-NC 4.0", "cc", "by", "nc", "é", "ÉCC", "x_y", "\x7f", "2É", "İ", "K"]
    return [None, "", "cc", "cc by nc cc by nc", "by nc", "nc cc by", *(rng.choice([" ", "\n", ", "]).join(rng.choice(parts) for _ in range(rng.randint(1, 20))) for _ in range(800))]


def test_base_columns_against_brute_force(spark):
    rows = [(i % 300, t, 1) for i, t in enumerate(texts())] + [(None, "under the mit license", 2), (9, "word " * 60_000 + "cc by nc", 3)]
    got = li.scan(spark.createDataFrame(rows, "doc_id long, text string, score int")).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == sorted(repr((i, *brute(t))) for i, t, _ in rows)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in got)


def test_notices(spark):
    notice = "This work is licensed under the GNU General Public License, version 3."
    bsd = "Redistribution and use in source and binary forms, with or without any modification, are permitted provided the following conditions are met"
    rows = [(1, "a b c\n" + notice + "\nd"), (2, bsd), (3, "gnu public general license 3 version"), (4, "Released under the MIT License."), (5, "redistribution forms")]
    got = {r.doc_id: (r.labels, r.score) for r in li.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("gpl-3", 1.0) and got[2][0] == "bsd" and li.LEAST <= got[2][1] < 1 and got[3] == ("", 0.0) and got[4] == ("mit", 1.0) and got[5] == ("", 0.0)


def plain_labels(text, having, n_docs):
    """Labels and the best score by a sliding comparison of every notice with the text, from the places that its rarest words give."""
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    idf = lambda x: math.log((n_docs + 1) / (having.get(x, 0) + 1)) + 1e-3
    labels, best = {label for label, p in li.BASE if any(ws[i : i + len(p.split())] == p.split() for i in range(len(ws)))}, 0.0
    if labels:
        best = 1.0
    for label, notice, phrases in li.NOTICES:
        own = notice.split()
        total, slack = sum(map(idf, own)), len(own) // li.SLACK
        anchors = sorted({x for x in own if x in ws}, key=lambda x: (-idf(x), x))[: li.ANCHORS]
        for start in {i - j for i, x in enumerate(ws) for j, v in enumerate(own) if x == v and x in anchors}:
            a, b = max(0, start - slack), min(len(ws), start + len(own) + slack)
            score = sum(idf(x) for j, x in enumerate(own) if any(a <= p < b and ws[p] == x for p in range(start + j - slack, start + j + slack + 1))) / total
            if score >= li.LEAST and all(any(ws[p : p + len(q.split())] == q.split() for p in range(a, b - len(q.split()) + 1)) for q in phrases):
                labels.add(label)
                best = max(best, min(1.0, score))
    return ",".join(sorted(labels)), best


def test_labels_and_scores_against_a_sliding_comparison(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(120):
        own = rng.choice([n for _, n, _ in li.NOTICES] + [p for _, p in li.BASE]).split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            at = rng.randrange(len(own))
            own[at : at + rng.randint(0, 1)] = rng.choice([[], ["x"], ["the"], ["license"]])
        texts.append(" ".join([rng.choice(["a", "the", "license", "software", "of", "z"]) for _ in range(rng.randint(0, 15))] + own + ["the", "work"]))
    having = Counter(x for t in texts for x in set(t.split()))
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.labels, r.score) for r in li.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(bool(x) for x, _ in got.values()) > 60
    for i, t in rows:
        labels, best = plain_labels(t, having, len(rows))
        assert got[i] == (labels, pytest.approx(best)), t


def test_published_header(spark):
    text = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    row = li.scan(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")).where("doc_id = 1").first()
    assert row.labels == "gpl-3" and row.score > 0.9


def test_empty_table(spark):
    assert li.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
