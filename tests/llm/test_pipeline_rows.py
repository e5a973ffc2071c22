"""Every stage of the pipeline on odd rows, against plain Python that shares nothing with the operators."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests_llm_plain import components, mixed, overlaps

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["row", "key", "of", "score", "predicted", "size", "taken", "k1", "k2", "col", "_id", "_n", "_k", "shard", "pid", "rep", "component"]


def documents(spark, rows):
    """rows: (doc_id, text, source); extra columns are named as the stages' own."""
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)
    return df.select("*", *[F.lit(c).alias(c) for c in CLASHING])


def sf(tmp_path, spark, labels=(), benchmark=()):
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def came_out(out, docs):
    assert out.columns == docs.columns
    return Counter((r.doc_id, r.text, r.source) for r in out.collect())


def test_toxic_rows_go_with_and_without_id(spark, tmp_path):
    rng = random.Random(71)
    rows, labels = [], []
    for i in range(400):
        words = [f"word{rng.randrange(80)}" for _ in range(20)] + (["blargh"] if i % 4 == 0 else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), "a"))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(None, "word1 blargh word2", "a"), (None, "word1 word2", "a"), (7, "blargh word3", None), (7, "blargh word3", None), (8, None, "a"), (8, "", "b"), (9, "word5", "b"), (9, "word5", "b")]
    docs = documents(spark, rows)
    want = Counter(r for r in rows if "blargh" not in (r[1] or "").split())
    assert came_out(corpus_pipeline.drop_toxic(spark, docs, sf(tmp_path, spark, labels)), docs) == want
    assert came_out(corpus_pipeline.drop_toxic(spark, docs, sf(tmp_path, spark)), docs) == Counter(rows)


def test_one_row_of_each_group_stays(spark, tmp_path):
    rng = random.Random(72)
    text = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    a, b, c, d = text(40), text(40), text(40), text(40)
    near = lambda w: " ".join([*w[:1], "other", *w[2:]])
    rows = [(5, " ".join(a), "s"), (5, " ".join(a), "s"), (5, " ".join(a), "r"), (6, " ".join(a), "s"), (None, " ".join(b), "s"), (None, near(b), "s"), (None, " ".join(b), "s"), (3, near(c), "s"), (None, " ".join(c), None), (3, " ".join(d), "s"), (1, "", "s"), (1, "", "s"), (2, None, "s"), (None, " \n", "s"), (4, "a b", "s"), (9, "A  b", "s"), (10, "a b c", "s")]
    docs = documents(spark, rows)
    got = came_out(corpus_pipeline.drop_near_duplicates(spark, docs, ""), docs)
    blank = Counter(r for r in rows if not (r[1] or "").split())
    assert sum((got & blank).values()) == sum(blank.values()) and got[(5, " ".join(a), "r")] == 1 and got[(3, near(c), "s")] == 1
    groups = components([r for r in rows if (r[1] or "").split()], 8)
    left = got - blank
    assert all(sum(1 for r in set(g) if left[r]) == 1 and max(left[r] for r in set(g)) == 1 for g in groups) and sum(left.values()) == len(groups)


def test_equal_rows_are_told_apart_by_any_column_in_any_order(spark):
    rows = [(i, "some words that repeat here", "en", "s", 5, url, {"k": url}) for i in (1, None) for url in ("u3", "u1", "u2", None, "u1")]
    kept = set()
    for seed in range(6):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, DOCS + ", url string, extra map<string, string>").repartition(seed + 1)
        kept.add(tuple(tuple(r[:6]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()))
    assert len(kept) == 1 and kept.pop() == ((1, "some words that repeat here", "en", "s", 5, "u1"),)  # the first `extra` as JSON


def test_contaminated_rows_go_with_and_without_id(spark, tmp_path):
    rng = random.Random(73)
    word = lambda: f"w{rng.randrange(300)}"
    items = [[word() for _ in range(n)] for n in (4, 9, 13, 30)]
    rows = []
    for item in items:
        for subs in range(0, len(item) // 4 + 2):
            w = list(item)
            for at in rng.sample(range(len(w)), subs):
                w[at] = word()
            rows.append((rng.choice([None, 1, 2, 3]), " ".join([word(), word(), *w, word()]), "s"))
    rows += [rows[0], rows[-1], (1, "clean words only", "s"), (1, None, "s"), (None, "", "s")]
    docs = documents(spark, rows)
    want = Counter(r for r in rows if not any(overlaps((r[1] or "").split(), item) for item in items))
    bench = [(k, " ".join(x)) for k, x in enumerate(items)] + [(8, None), (9, "")]
    assert 0 < len(want) < len(set(rows)) - 3
    assert came_out(corpus_pipeline.drop_contaminated(spark, docs, sf(tmp_path, spark, benchmark=bench)), docs) == want


@pytest.mark.parametrize("case", ["spread", "no ids", "one row"])
def test_each_row_is_mixed_by_its_own_draw(spark, tmp_path, case):
    rng = random.Random(74)
    size = lambda: " ".join(["w"] * rng.randrange(0, 9)) or rng.choice([None, ""])
    rows = {
        "spread": [(rng.randrange(60), size(), rng.choice(["a", "b", None, "big", "big", "big"])) for _ in range(400)],
        "no ids": [(None, size(), rng.choice(["a", "b"])) for _ in range(200)] + [(None, "x y z", "a")] * 50,
        "one row": [(1, "a b c", None)],
    }[case]
    docs = documents(spark, rows)
    got = came_out(corpus_pipeline.mix_sources(spark, docs, ""), docs)
    assert got == mixed(rows)


def test_sharding_lays_every_row(spark):
    rng = random.Random(75)
    rows = [(rng.choice([None, *range(50)]), rng.choice([None, "", "é" * rng.randrange(80), "same"]), "s") for _ in range(500)]
    got = sorted((r.shard, r.slot, r["size"]) for r in corpus_pipeline.shard(spark, documents(spark, rows).repartition(3), "").collect())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, __import__("zlib").crc32((r[1] or "").encode()), len((r[1] or "").encode())))
    sizes = [len((t or "").encode()) + 8 for _, t, _ in order]
    total, before, want, slots = sum(sizes), 0, [], Counter()
    for s in sizes:
        at = min(23, 24 * (2 * before + s) // (2 * total))
        want.append((at, slots[at], s))
        slots[at] += 1
        before += s
    assert got == want


def test_empty_tables(spark, tmp_path):
    docs, folder = documents(spark, []), sf(tmp_path, spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0 and (name == "sharding" or out.columns == docs.columns)


def test_run_leaves_one_folder(spark, tmp_path):
    from twinspect.session import checkpoint_dir
    from urllib.parse import urlparse
    import os

    docs = spark.createDataFrame([(i, f"some words of text {i} " * 3, "en", "s", 5) for i in range(20)], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    folder = urlparse(checkpoint_dir(spark)).path
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, sf(tmp_path, spark)).count() > 0
    new = [d for d in set(os.listdir(folder)) - before if d.startswith("pipeline-")]
    assert len(new) == 1 and os.listdir(f"{folder}/{new[0]}") == ["sharding"]
