"""Features by suffix arrays and the draw, against plain counts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from twinspect.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, max_n):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, max_n + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, percent, min_words, max_n, m, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % m
    s = Counter(bucket(f) for _, t in docs for f in grams(t, max_n)[1])
    t = Counter(bucket(f) for x in target for f in grams(x, max_n)[1])
    S, T = sum(s.values()), sum(t.values())
    out = []
    for d, text in docs:
        n, fs = grams(text, max_n)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + m) / ((s[b] + 1) * (T + m)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def drawn(spark, docs, target, *args):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    t = spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string")
    return sorted((tuple(r) for r in resampling.resample(d, t, *args).collect()), key=str)


def test_suffix_order_and_runs():
    rng = np.random.default_rng(1)
    for depth in (1, 2, 3, 5, 8):
        ids = rng.integers(0, 4, 300)
        order, lcp = resampling.suffix_order(ids, depth)
        padded = np.concatenate((ids, np.zeros(depth, int)))
        heads = [tuple(padded[p : p + depth]) for p in order]
        assert heads == sorted(heads) and sorted(order) == list(range(300))
        for a, b, n in zip(heads, heads[1:], lcp[1:]):
            assert n == next((k for k in range(depth) if a[k] != b[k]), depth)
    assert resampling.suffix_order(np.zeros(0, np.int64), 2)[0].tolist() == []


def test_draw_equals_plain_counts(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(60)] + ["Ärger", "ÄRGER", "été", "中文"]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 50)))) for k in range(200)]
    docs += [(3, "w1 w2"), (3, "w1 w2"), (None, "W1 w2 " * 12), (None, None), (500, ""), (501, "!? --"), (502, "w7 " * 30_000), *((600 + k, "copied words here " * 9) for k in range(30))]
    target = [" ".join(rng.choices(vocabulary[:20], k=30)) for _ in range(10)] + [None, ""]
    for args in ((10, 20, 1, 10_000), (25, 5, 3, 500), (100, 1, 2, 70_000)):
        assert drawn(spark, docs, target, *args) == plain(docs, target, *args)


def test_chunks_change_nothing():
    texts = [[b"a", b"b", b"a"], [], [b"a", b"b"], [b"c"]]
    whole = resampling.bucket_ids(texts, 3, 1000)
    for text, found in zip(texts, whole):
        assert (found == resampling.bucket_ids([text], 3, 1000)[0]).all()


def test_empty_tables_and_other_columns(spark):
    assert drawn(spark, [], ["a b"]) == [] and drawn(spark, [], []) == []
    docs = [(1, "a b c"), (2, "b")]
    assert drawn(spark, docs, [], 50, 1, 1, 100) == plain(docs, [], 50, 1, 1, 100)
    d = spark.createDataFrame([(1, "a b c", 5, "x")], "doc_id long, text string, id long, rank string")
    assert resampling.resample(d, d, 100, 1).count() == 1
