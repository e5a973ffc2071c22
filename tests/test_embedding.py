"""Batches of texts of like length over a whole table."""

import hashlib
import random

import numpy as np
import pytest

from twinspect.operators import embedding


def writer(folder):
    """Notes each batch in a file of its own; the vector is (1, length of the text)."""

    class Written:
        def embed(self, texts):
            import os
            import uuid

            with open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w") as f:
                f.write(",".join(str(len(t)) for t in texts))
            return [[1.0, float(len(t))] for t in texts]

    return Written


def test_a_batch_is_full_by_number_or_by_characters():
    assert list(embedding.filled([10] * 40)) == [16, 16, 8]
    assert list(embedding.filled([23_999, 1, 24_000, 30_000, 5])) == [2, 1, 1, 1]  # 23,999 and a text of 256 at least
    assert list(embedding.filled([11_999, 11_999, 2, 7])) == [3, 1]
    assert list(embedding.filled([])) == []


@pytest.mark.parametrize("parts", [1, 7])
def test_padding_is_near_that_of_a_global_sort(spark, tmp_path, parts):
    rng = random.Random(3)
    sizes = [min(int(rng.paretovariate(1.1) * 20), 20_000) for _ in range(6000)] + [0, 0]
    df = spark.createDataFrame([(f"h{k}", "x" * n) for k, n in enumerate(sizes)], "hash string, text string").repartition(parts)
    folder = tmp_path / f"b{parts}"
    folder.mkdir()
    name = str(folder)
    got = {r.hash: r.vec for r in embedding.embed(df, "hash", writer(name), name).collect()}
    assert len(got) == len(sizes)
    for k, n in enumerate(sizes):
        assert abs(got[f"h{k}"][1] * (1 + n * n) ** 0.5 - n) < 1e-3 * max(1, n)
    batches = [[int(x) for x in p.read_text().split(",")] for p in folder.iterdir()]
    assert sorted(n for b in batches for n in b) == sorted(sizes)
    assert all(len(b) <= 16 and sum(max(n, 256) for n in b[:-1]) < 24_000 for b in batches)
    order, ideal = sorted(sizes), 0
    for n in embedding.filled(order):
        ideal += n * max(order[:n])
        order = order[n:]
    assert sum(len(b) * max(b) for b in batches) <= 1.05 * ideal
    assert embedding.embed(df.limit(0), "hash", writer(name), name).count() == 0


def test_an_embedder_that_loses_a_text_is_an_error(spark):
    class Short:
        def embed(self, texts):
            return [[1.0]] * (len(texts) - 1)

    df = spark.createDataFrame([("a", "x"), ("b", "y")], "hash string, text string")
    with pytest.raises(Exception, match="vectors for"):
        embedding.embed(df, "hash", Short, "short").collect()


def test_hashed_tokens_come_in_small_batches(spark):
    """Vectors are laid out a few hundred rows at a time, and equal plain counts across their bounds; null keys and no tokens too."""
    texts = [(k if k else None, " ".join(f"w{j}" for j in range(k % 7) for _ in range(j + 1)) if k % 5 else None) for k in range(1300)]
    got = embedding.hashed_tokens(spark.createDataFrame(texts, "k long, text string").coalesce(1), "k", 64)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan and embedding.MOST_ROWS < 1000
    rows = {r.k: np.array(r.vec) for r in got.collect()}
    assert len(rows) == 1300
    for k, text in texts:
        want = np.zeros(64)
        for t in (text or "").split():
            want[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 64] += 1
        norm = np.sqrt((want * want).sum())
        assert np.allclose(rows[k], want / norm if norm else want, atol=1e-15)


def test_unique_keys_need_no_shuffle_and_others_count_together(spark, monkeypatch):
    """Both ways give the counts of a plain loop, also where slices are cut by tokens; texts of one key are added up."""
    monkeypatch.setattr(embedding, "MOST_TOKENS", 40)
    texts = [(k, None if k % 11 == 0 else " ".join(f"Wört{j * k % 90}" for j in range(k % 60))) for k in range(300)]

    def plain(rows):
        out = {}
        for k, text in rows:
            v = out.setdefault(k, np.zeros(64))
            for t in (text or "").split():
                v[int(hashlib.md5(t.lower().encode()).hexdigest()[:8], 16) % 64] += 1
        return {k: v / np.sqrt((v * v).sum()) if v.any() else v for k, v in out.items()}

    def same(got, want):
        rows = got.collect()
        assert len(rows) == len(want)
        assert all(np.allclose(r.vec, want[r.k], atol=1e-15) for r in rows)

    one = embedding.hashed_tokens(spark.createDataFrame(texts, "k long, text string"), "k", 64, unique=True)
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    same(one, plain(texts))
    twice = [(k % 40, t) for k, t in texts]
    same(embedding.hashed_tokens(spark.createDataFrame(twice, "k long, text string").repartition(5), "k", 64), plain(twice))
