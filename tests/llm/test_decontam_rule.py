"""Decontamination against its rule, applied to every diagonal of every document and passage."""

import itertools
import random

import pytest

from twinspect.llm import decontam


def brute(doc, passage):
    """(places, agreeing) of the longest run of agreeing places that the rule allows, or None."""
    best, least = None, min(13, len(passage))
    for shift in range(-len(passage) + 1, len(doc)):
        a, b = max(0, -shift), min(len(passage), len(doc) - shift)
        same = [doc[k + shift] == passage[k] for k in range(a, b)]
        for i in range(len(same)):
            for j in range(i + least, len(same) + 1):
                hit = sum(same[i:j])
                if 5 * hit >= 4 * (j - i) and (best is None or (j - i, hit) > best):
                    best = (j - i, hit)
    return best if passage else None


@pytest.mark.parametrize("block_words", [400_000, 20])
def test_equals_the_rule(spark, block_words):
    rng = random.Random(51)
    word = lambda: f"w{rng.randrange(400)}"
    items = [[word() for _ in range(n)] for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 20, 26, 40) for _ in range(2)]
    docs = []
    for k, item in enumerate(items):
        for subs in range(len(item) // 4 + 2):
            w = list(item)
            for at in rng.sample(range(len(w)), min(subs, len(w))):
                w[at] = word()
            cut = rng.randrange(3) if len(item) > 13 else 0
            docs.append([word() for _ in range(rng.randrange(12))] + w[cut:] + [word() for _ in range(rng.randrange(12))])
    want = {(i, k, *x) for i, d in enumerate(docs) for k, p in enumerate(items) if (x := brute(d, p))}
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_overlap, r.n_same) for r in decontam.contaminated(d, b, block_words).collect()}
    assert got == want and len({k for _, k, _, _ in want}) == len(items)


def test_masks_meet_every_pattern_of_substitutions():
    for n in range(5, 26):
        least = min(n, decontam.OVERLAP)
        masks = decontam.masks_for(n)
        assert least == n or n >= 13
        for gone in itertools.combinations(range(n), n // 5):
            assert any(not {s + o for o in m} & set(gone) for m in masks for s in range(n - m[-1])), (n, gone)


@pytest.mark.parametrize("block_words", [400_000, 1])
def test_repeated_rows_and_missing_ids(spark, block_words):
    docs = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (1, "else"), (None, "x one two three y"), (2, None), (3, "")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three"), (8, "one two three"), (None, "one two three"), (9, None)], "item_id long, text string")
    got = decontam.contaminated(docs, items, block_words).collect()
    assert sorted((str(r.doc_id), str(r.item_id)) for r in got) == [(d, i) for d in ("1", "None") for i in ("7", "8", "None")]
    assert decontam.overlapping(docs, items, block_words).select("doc_id", "k1").distinct().count() == 2


def test_a_common_phrase_lists_no_pairs(spark, monkeypatch):
    """Documents and passages that all share eight words, and overlap in a few cases only."""
    rng = random.Random(57)
    word = lambda: f"w{rng.randrange(10**6)}"
    phrase = [f"common{k}" for k in range(8)]
    items = [[word() for _ in range(rng.randrange(0, 9))] + phrase + [word() for _ in range(rng.randrange(0, 9))] for _ in range(60)]
    items += [phrase[:6]] * 2 + [["Short", "one"], ["short", "one"], *([f"Short{'.' * k}", "one"] for k in range(1, 20))]
    docs = [[word() for _ in range(20)] + phrase + [word() for _ in range(20)] for _ in range(90)]
    for k in range(0, 60, 6):
        w = list(items[k])
        for at in rng.sample(range(len(w)), len(w) // 6):
            w[at] = word()
        docs.append([word() for _ in range(k % 7)] + w + [word() for _ in range(3)])
    docs += [["a", "short", "one", "b"], []]
    tidy = lambda w: [x.lower().strip(".") for x in w]
    want = {(i, k, *x) for i, d in enumerate(docs) for k, p in enumerate(items) if (x := brute(tidy(d), tidy(p)))}
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    seen, real = [], decontam._crowded
    monkeypatch.setattr(decontam, "_crowded", lambda *a: (lambda out: seen.append(out.count()) or out)(real(*a)))
    for side, reach in ((2048, 1000), (7, 3)):
        monkeypatch.setattr(decontam, "SIDE", side)
        monkeypatch.setattr(decontam, "SPREAD", reach)
        got = {(r.doc_id, r.item_id, r.n_overlap, r.n_same) for r in decontam.contaminated(d, b, 20).collect()}
        assert got == want
    assert all(n < 400 for n in seen) and len(seen) == 2  # of 6,000 pairs that share the phrase


def test_passages_without_words_are_not_fetched(spark):
    items = spark.createDataFrame([(k, " \n" if k % 2 else None) for k in range(500)] + [(500, "one two")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "one two"), (2, " ")], "doc_id long, text string")
    for block_words in (400_000, 1):
        assert [(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items, block_words).collect()] == [(1, 500)]
