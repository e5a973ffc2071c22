"""Outliers against a NumPy version that shares no expression with the operator."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from twinspect.llm import quality

FLOOR = np.array([0.14, 0.05, 0.17, 0.08]) * 1024
CUTOFF, CONSISTENCY = 28.47, 1.485


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    five = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(five)
    covered = {i + k for i, f in enumerate(five) if often[f] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(covered)


def vector(n, chars, symbols, n_lines, dup, repeat):
    raw = (math.log(chars / n), math.sqrt(symbols / chars), math.sqrt(dup / n_lines), math.sqrt(repeat / n))
    return [math.floor(1024 * x + 0.5) for x in raw]


def squared(x, mean, cov):
    return np.einsum("ij,ij->i", x - mean, np.linalg.solve(cov, (x - mean).T).T)


def estimate(x):
    """Mean and covariance of the start whose last covariance has the least determinant."""
    middle = np.median(x, axis=0)
    scale = np.maximum(1.4826 * np.median(abs(x - middle), axis=0), FLOOR)
    off = ((x - middle) / scale) ** 2
    best = None
    for start in (off.sum(1), off[:, 0] + off[:, 1], off[:, 2] + off[:, 3], ((x[:, 1:] / FLOOR[1:]) ** 2).sum(1)):
        distance = start
        for _ in range(8):
            grade = np.minimum(65535, np.floor(16 * distance))
            near = x[grade <= np.percentile(grade, 75)]
            mean = near.mean(0)
            cov = CONSISTENCY * ((near - mean).T @ (near - mean) / len(near)) + np.diag(FLOOR**2)
            distance = squared(x, mean, cov)
        size = round(np.linalg.slogdet(cov)[1] / 2, 9)
        if best is None or size < best[0]:
            best = size, mean, cov, len(near)
    return best[1:]


def plain(docs):
    """{row: (base_failed, kept, distance)} of rows (doc_id, text, lang, source)."""
    out, passed = {}, {}
    for k, (_, text, *_) in enumerate(docs):
        s = statistics(text)
        failed = s[0] < 10 or 100 * s[5] > 20 * s[0]
        out[k] = (*s, failed, False, None)
        if not failed:
            passed[k] = vector(*s)
    pairs = Counter((docs[k][2], docs[k][3]) for k in passed)
    langs = Counter()
    for (lang, _), n in pairs.items():
        langs[lang] += n if n < 50 else 0
    groups = defaultdict(list)
    for k in passed:
        lang, source = docs[k][2:]
        groups[("pair", lang, source) if pairs[lang, source] >= 50 else ("lang", lang) if langs[lang] >= 50 else "all"].append(k)
    for ks in groups.values():
        x = np.array([passed[k] for k in ks], float)
        mean, cov, n = estimate(x)
        for k, d in zip(ks, squared(x, mean, cov) if n >= 15 else np.zeros(len(ks))):
            out[k] = (*out[k][:7], d <= CUTOFF, d)
    return out


def made():
    rng = random.Random(6)
    docs = []
    for k in range(420):
        lang, source = rng.choice([("en", "a")] * 5 + [("en", "b"), ("de", "a"), (None, "a"), ("fr", None), ("xx", "rare")])
        w = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(rng.randint(5, 120))]
        if k % 17 == 0:
            w = [x + rng.choice("#*$%") for x in w]
        if k % 23 == 0:
            w = ["".join(rng.choices("abc", k=40)) for _ in range(20)]
        lines = [" ".join(w[i : i + 9]) for i in range(0, len(w), 9)]
        if k % 29 == 0:
            lines += ["same short line"] * 3
        docs.append((k, "\n".join(lines), lang, source))
    return docs + [(500, None, "en", "a"), (501, "", "en", "a"), *docs[:5], *docs[:5]]


@pytest.mark.parametrize("case", ["made", "sf0.01", "few"])
def test_equals_the_plain_version(spark, case):
    docs = made() if case == "made" else duckdb.sql(f"SELECT doc_id, text, lang, source FROM '/root/testdata/{'sf0.01' if case == 'sf0.01' else 'sf0.001'}/documents.parquet'").fetchall()
    docs = docs[:12] if case == "few" else docs
    want = plain(docs)
    # Rows are told apart by a number in place of the id.
    df = spark.createDataFrame([(k, *d[1:]) for k, d in enumerate(docs)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    assert got.keys() == want.keys()
    for k, (n, chars, symbols, _, dup, repeat, failed, kept, distance) in want.items():
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, dup, repeat, failed)
        assert (r.distance is None) == (distance is None)
        if distance is not None:
            assert abs(r.distance - distance) <= 1e-6 * max(1, distance) and (r.kept == kept or abs(distance - CUTOFF) < 1e-6)
    assert case == "few" or any(not w[6] and not w[7] for w in want.values())
