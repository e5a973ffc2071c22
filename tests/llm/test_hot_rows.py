"""Rows that repeat by the thousand: results stay right, and no task gets them all."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from twinspect.llm import neardup, repeats


@pytest.fixture
def spread(spark):
    """Partitions as they are dealt, none put together."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_empty_texts_and_copies_in_repeats(spread):
    copy = "a text of many copies, " * 20
    rows = [(k, "") for k in range(4000)] + [(None, None)] * 2000 + [(10_000 + k, copy) for k in range(3000)] + [(20_000, "one of its own")]
    df = spread.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = repeats.remove_repeats(df)
    assert largest_share(out.select("doc_id")) < 0.4
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256): r.n for r in out.groupBy("n_bytes", "n_removed", "n_spans", "kept_sha256").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, 0, 0, sha(b"")): 6000, (len(copy), len(copy), 1, sha(b"")): 3000, (14, 0, 0, sha(b"one of its own")): 1}


def test_copies_without_ids_in_near_duplicates(spread):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    near = [*words[:-1], "other"]
    rows = [(None, " ".join(words))] * 3000 + [(None, " ".join(near))] * 2000 + [(7, " ".join(near)), (8, "else"), (None, "")]
    out = neardup.near_duplicates(spread.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = {(r.doc_id, r.component_id, r.kept): r.n for r in out.groupBy("doc_id", "component_id", "kept").agg(F.count("*").alias("n")).collect()}
    assert got == {(None, 7, False): 5000, (7, 7, True): 1, (8, 8, True): 1, (None, None, True): 1}
    assert largest_share(out.select("doc_id")) < 0.5


def test_one_row_a_key_before_sets_are_made(spread, monkeypatch):
    made = []
    monkeypatch.setattr(neardup, "full_sets", lambda rows, f=neardup.full_sets: made.append(rows.count()) or f(rows))
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = [(None, " ".join(words))] * 500 + [(1, " ".join([*words[:-1], "x"]))] * 500
    neardup.near_duplicates(spread.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert made == [2]
