"""CRC-32 by positions against zlib, and the draw against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import cases
from chatterlake.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def features(text, shortest=1, longest=1):
    words = WORD.findall((text or "").translate(UPPER))
    return words, [" ".join(words[i : i + k]) for k in range(shortest, longest + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, shortest=1, longest=1, n=10_000, least=20, percent=10, seed=2024):
    """docs: (key, text); target: texts."""
    bucket = lambda f: zlib.crc32(f.encode()) % n
    found = [(key, *features(text, shortest, longest)) for key, text in docs]
    s = Counter(bucket(f) for _, _, fs in found for f in fs)
    t = Counter(bucket(f) for text in target for f in features(text, shortest, longest)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + n) / ((s[b] + 1) * (big_t + n))))
    rows = []
    for key, words, fs in found:
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    drawn = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    ranks = {id(r): i + 1 for i, r in enumerate(drawn[: len(drawn) * percent // 100])}
    return sorted(repr((*r[:4], ranks.get(id(r)))) for r in rows)


def test_crc_of_spans():
    rng = random.Random(5)
    data = rng.randbytes(30_000)
    starts = np.array([rng.randrange(20_000) for _ in range(2_000)] + [0])
    lengths = [rng.choice([1, 2, 8, 63, 64, 65, 127, 128, 129, 191, 193, 640, 4095, 9999]) for _ in range(2_000)] + [30_000]
    ends = starts + np.array(lengths)
    got = importance.crc32_spans(np.frombuffer(data, np.uint8), starts, ends)
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in zip(starts, ends)]
    assert importance.crc32_spans(np.zeros(0, np.uint8), np.zeros(0, int), np.zeros(0, int)).tolist() == []


def test_buckets_of_features():
    texts = [None, "", "Ab cd", "é1 ÀB É", "x" * 300 + " y", "a", "b,c\x7f{d", "\x00z@", "日本 語x", "z"]
    for widths in ((1, 1), (1, 3), (2, 4)):
        got, bounds, n_words = importance.feature_buckets(pa.array(texts), *widths, 997)
        for i, text in enumerate(texts):
            words, found = features(text, *widths)
            assert n_words[i] == len(words)
            assert got[bounds[i] : bounds[i + 1]].tolist() == [zlib.crc32(f.encode()) % 997 for f in found]


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_draw_equals_brute(spark):
    docs = cases.near_copies(n=90) + [cases.row(None, "null key " * 30), cases.row(7, "same key " * 15), cases.row(7, "same key " * 15), cases.row(None, None)]
    target = [("q", "abc ab a"), ("r", None), ("s", "bcd " * 40)]
    wanted = spark.createDataFrame(target, "id string, text string").selectExpr("1L AS item_id", "text", "id AS doc_id")
    for options in ({}, {"shortest": 1, "longest": 2, "n_buckets": 64, "percent": 35, "seed": 9}):
        got = rows_of(importance.draw(cases.frame(spark, docs), wanted, **options))
        renamed = {"n_buckets": "n"}
        want = brute([r[:2] for r in docs], [t for _, t in target], **{renamed.get(k, k): v for k, v in options.items()})
        assert got == want


def test_draw_without_rows(spark):
    docs, none = cases.frame(spark, cases.near_copies()[:9]), spark.createDataFrame([], "item_id long, text string")
    assert importance.draw(docs.where("false"), none).count() == 0
    assert importance.draw(docs, none).where(F.col("weight").isNull()).count() == 0
