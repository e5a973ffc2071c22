"""Pairwise interactions that additive weights cannot learn, and scores against the sum over all pairs."""

import math
import random
import tracemalloc

import numpy as np
import pytest

from twinspect.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string"


def tables(spark, kind_of):
    rng = random.Random(61)
    filler = [f"word{i}" for i in range(120)]
    rows, labels = [], []
    for i in range(1500):
        text, kind = [rng.choice(filler) for _ in range(25)], i % 4
        text += [["blargh", "zonk"], ["blargh"], ["zonk"], []][kind]
        rng.shuffle(text)
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, 1, int(kind_of(kind))))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def accuracy(got, labels):
    held = got[got.held_out]
    return (held.predicted == held.doc_id.map({r[0]: r[2] for r in labels})).mean()


def test_exclusive_or_needs_factors(spark):
    docs, marks, labels = tables(spark, lambda kind: kind in (1, 2))  # one of the two, not both
    sample = toxicity.training_terms(docs, marks)
    scores = {}
    for rank in (6, 0):
        machine = toxicity.train(*sample, rank=rank)
        got = toxicity.score_texts(docs, machine).selectExpr("row.doc_id", "predicted").toPandas()
        got["held_out"] = [__import__("zlib").crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]
        scores[rank] = accuracy(got, labels)
    assert scores[6] > 0.97 and scores[0] < 0.8
    assert accuracy(toxicity.toxicity(docs, marks).toPandas(), labels) > 0.97


def test_scores_equal_the_sum_over_pairs(spark):
    rng, words = np.random.default_rng(62), [f"term{i}" for i in range(30)]
    terms = np.array(sorted({t for w in words for t in toxicity.terms_of(w)}), np.int64)
    machine = toxicity.Machine(-0.3, terms, rng.normal(size=len(terms)), rng.normal(size=(len(terms), 4)))
    texts = [" ".join(rng.choice(words, 6)) for _ in range(20)] + ["", None, "unknown", "Term1, TERM1! term1"]
    place = {int(t): i for i, t in enumerate(terms)}

    def plain(text):
        there = sorted({place[t] for w in (text or "").split() for t in toxicity.terms_of(w) if t in place})
        z = machine.bias + sum(machine.w[a] for a in there)
        for a in there:
            for b in there:
                if a < b:
                    z += sum(machine.v[a][k] * machine.v[b][k] for k in range(4))
        return 1 / (1 + math.exp(-max(-40, min(40, z))))

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score_texts(df, machine).selectExpr("row.doc_id", "score").collect()}
    assert [got[i] for i in range(len(texts))] == [pytest.approx(plain(t)) for t in texts]


def test_rows_come_back_whole(spark):
    docs, marks, _ = tables(spark, lambda kind: kind == 0)
    docs = docs.selectExpr("*", "'x' AS score", "array(1, 2) AS predicted", "doc_id AS row")
    got = toxicity.toxicity(docs, marks, rows=True).select("row.*")
    assert got.schema == docs.schema and sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))


def all_pairs(y, sets, common):
    """The terms of strong pairs, by one matrix of all."""
    x = np.array([np.isin(common, t) for t in sets], np.float64).reshape(len(sets), len(common))
    n, p, both, toxic = x.sum(0), y @ x, x.T @ x, (x * y[:, None]).T @ x
    chi = toxicity.chi_square(n[:, None], p[:, None], both, toxic)
    strong = (np.minimum(chi, chi.T) >= toxicity.PAIR_CHI) & (both < n[:, None]) & (both < n)
    return set(common[strong.any(1)].tolist())


def pair_sample(n_rows, n_terms, each, seed):
    """Random sets of terms; the label of a row follows from two pairs, one of them of terms far apart."""
    rng = np.random.default_rng(seed)
    common = np.sort(rng.choice(1 << 30, n_terms, replace=False)).astype(np.int64)
    has = rng.random((n_rows, 3)) < 0.5
    y = ((has[:, 0] ^ has[:, 1]) | (has[:, 1] ^ has[:, 2])).astype(np.float32)
    marks = common[[0, n_terms - 1, n_terms // 2]]
    rest = np.setdiff1d(common, marks)
    strange = np.array([(1 << 30) + 7])  # not a common term
    return y, [np.sort(np.concatenate((rng.choice(rest, each, replace=False), marks[h], strange))) for h in has], common, marks


@pytest.mark.parametrize("block", [1, 7, 60, 64, 512])
def test_pairs_by_blocks_equal_all_pairs(block):
    y, sets, common, marks = pair_sample(400, 60, 12, 63)
    want = all_pairs(y, sets, common)
    assert set(marks.tolist()) <= want and toxicity.paired_terms(y, sets, common, block) == want
    none = np.zeros(0, np.int64)
    assert toxicity.paired_terms(y, sets, none, block) == toxicity.paired_terms(y, [none] * len(y), common, block) == set()


def test_training_is_bounded_on_the_driver():
    y, sets, common, marks = pair_sample(2000, 4000, 100, 64)
    sample = [(int(k), t[np.isin(t, common[:2000])]) for k, t in zip(y, sets)]
    peaks = []
    for work in (lambda: toxicity.paired_terms(y, sets, common), lambda: toxicity.train(sample, 900, 1100, steps=8)):
        tracemalloc.start()
        found = work()
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
        if len(peaks) == 1:
            assert set(marks.tolist()) <= found
    # one matrix of floats would be 32 MB in the pairs (and a copy with labels as much), 16 MB in training
    assert peaks[0] < 32 and peaks[1] < 16, peaks
