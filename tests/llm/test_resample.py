"""Importance resampling against plain Python, its cutoff at ties and widened brackets, and odd rows."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspan.llm import resample

DOC = "doc_id long, text string"


def runs(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [crc32(f.encode()) % resample.BUCKETS for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]]


def brute(docs, target, percent=25, least=20):
    source, wanted = Counter(b for _, t in docs for b in runs(t)[1]), Counter(b for t in target for b in runs(t)[1])
    big_s, big_t, size = source.total(), wanted.total(), resample.BUCKETS
    rows = []
    for i, text in docs:
        words, buckets = runs(text)
        gains = [math.floor(1000 * math.log((wanted[b] + 1) * (big_s + size) / ((source[b] + 1) * (big_t + size)))) for b in buckets]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(words), len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = [r[:1] + r[2:] + (n,) for n, r in enumerate(order[: percent * len(order) // 100], 1)]
    left = Counter(r[:1] + r[2:] for r in rows) - Counter(r[:-1] for r in drawn)
    return Counter(drawn) + Counter(r + (None,) for r in left.elements())


def result(spark, docs, target, **more):
    frame = spark.createDataFrame(docs, DOC).withColumns({c: F.lit("x") for c in ("row", "rank", "score", "place", "digest", "nth", "part", "weight")})
    rows = resample.resampled(frame, spark.createDataFrame([(t,) for t in target], "text string"), **more)
    return Counter((r.row.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in rows.collect())


def test_equals_brute_force(spark):
    r = np.random.default_rng(1)
    text = lambda n, base: " ".join(f"w{base + x}é" for x in r.zipf(1.5, n) % 300)
    docs = [(int(i), text(int(r.integers(0, 90)), 100 * int(r.integers(0, 3)))) for i in r.permutation(200)]
    docs += [(500, docs[0][1])] * 40 + [(None, docs[1][1])] * 3  # equal keys across the cutoff
    target = [text(200, 100) for _ in range(5)] + [None, ""]
    assert result(spark, docs, target) == brute(docs, target)
    assert result(spark, docs, target, percent=90, least_words=1) == brute(docs, target, 90, 1)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n."), (None, "one two"), (4, "word " * 30_000), (5, "same text"), (5, "same text"), (6, "naïve Ünïcode ß\x0b end")]
    for target in ([], [None], ["word word", "naïve"]):
        assert result(spark, docs, target) == brute(docs, target)
        assert result(spark, docs, target, percent=100, least_words=0) == brute(docs, target, 100, 0)
    assert not result(spark, [], ["word"])


def test_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 2.0)], "doc_id int, text string, score string, rank double")
    got = resample.resampled(docs, docs.select("text"), percent=100, least_words=1).first()
    assert got.row.asDict() == {"doc_id": 1, "text": "a b", "score": "x", "rank": 2.0} and got["rank"] == 1


@pytest.mark.parametrize("accuracy", [10_000, 3])
def test_bracket_holds_the_cutoff(spark, monkeypatch, accuracy):
    monkeypatch.setattr(resample, "ACCURACY", accuracy)
    r = np.random.default_rng(2)
    scores = [int(x) for x in r.integers(0, 40, 3000)]
    rows = spark.createDataFrame([(s, i, 0, i) for i, s in enumerate(scores)], "score long, doc_id long, digest long, place long").repartition(7)
    order = sorted(range(3000), key=lambda i: (-scores[i], i))
    for k in (1, 2, 750, 2999, 3000):
        cut = resample.cutoff(rows, k, 3000)
        assert cut["doc_id"] == order[k - 1]
        assert rows.where(resample.not_after(cut)).count() == k
