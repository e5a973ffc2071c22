"""The bit-sliced index against plain scores."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from twinspect.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def plain(docs, items, k):
    """Sets of (item_id, rank, doc_id, score) of rows (doc_id, text) and (item_id, text)."""
    found = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = []
    for i, ts in wanted.items():
        scores = []
        for d, c in found:
            m = 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if no else d, -s) for r, (s, no, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def ranked(spark, docs, items, k=5, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    queries = lexical.item_terms(i)
    rows = lexical.search(lexical.build_index(d, queries, **options), queries, k, 20).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=str)


def test_slices_add_multiply_and_choose():
    rng = np.random.default_rng(3)
    for _ in range(200):
        values = rng.integers(0, 2 ** int(rng.integers(1, 21)), 64)
        at = np.arange(64)
        x = np.ascontiguousarray(lexical.sliced(values, at >> 3, at & 7, np.arange(0, 64, 8), 20).T)
        weight = int(rng.integers(1, 20000))
        back = lambda s: sum(np.unpackbits(r.view(np.uint8), bitorder="little").astype(object) << j for j, r in enumerate(s))
        product = lexical.times(x, weight)
        assert (back(product) == values.astype(object) * weight).all()
        total, carry = np.zeros((2, 44, 8), np.uint8)
        many = [product, x, product[:30] if (values * weight).max() < 2**30 else product, x]
        for y in many:
            lexical.add_slices(total, carry, y)
        want = 2 * values * weight + 2 * values
        got = lexical.resolved(total, carry)
        assert (back(got) == want).all()
        k = int(rng.integers(1, 70))
        ids = rng.permutation(64)
        at, scores = lexical.best(got.view(np.uint64), ids, k)
        order = [p for p in np.lexsort((ids, -want)) if want[p] > 0][:k]
        assert set(at.tolist()) == set(order) and (scores == want[at]).all()


def test_ranks_equal_plain_scores(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(40)] + ["Öl", "ÖL", "naïve", "中文", "a1"]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for k in range(300)]
    docs += [(7, "w1 w1 w2"), (7, "w1 w1 w2"), (None, "w1 W1 w2"), (900, None), (901, ""), (902, "!?"), (903, "w3 " * 20_000)] + [(1000 + k, "same text, w5") for k in range(40)]
    items = [(k, " ".join(rng.choices(vocabulary, k=8))) for k in range(12)] + [(20, "w5 same"), (21, None), (22, ""), (23, "nowhere"), (24, "w1"), (24, "w2"), (None, "w3 öl ÖL")]
    want = plain(docs, items, 5)
    assert ranked(spark, docs, items) == want
    assert ranked(spark, docs, items, block_docs=17) == want


def test_index_without_a_list_of_terms_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "one two", "x"), (2, "two", "y")], "doc_id long, text string, term string")
    items = lexical.item_terms(spark.createDataFrame([(1, "two three")], "item_id long, text string"))
    rows = lexical.search(lexical.build_index(docs), items, 3).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in rows) == plain([(1, "one two"), (2, "two")], [(1, "two three")], 3)


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame([], f"{n} long, text string") for n in ("doc_id", "item_id"))
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lexical.rank_documents(docs, items).collect() == []
    assert lexical.rank_documents(some, items).collect() == []
    assert lexical.rank_documents(docs, some.withColumnRenamed("doc_id", "item_id")).collect() == []
