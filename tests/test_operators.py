"""Clusters, overlaps, similarity, components: small cases with known results, and operators held against each other."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinspect.functions.vectors import dot, from_bytes, normalized, packed, to_bytes
from twinspect.operators import clusters, evaluate, overlap, similar
from twinspect.operators.graph import components, forests
from twinspect.operators.joins import by_suffix, join_heavy


def hot(dim, at):
    return [1.0 if i == at else 0.0 for i in range(dim)]


def units(spark, rows):
    return spark.createDataFrame(rows, "unit_id long, path string, start_line int, end_line int, unit_kind string")


def test_sparse_finds_identical_vectors(spark):
    df = spark.createDataFrame([(0, hot(768, 7)), (1, hot(768, 7)), (2, hot(768, 99))], "unit_id long, vec array<double>")
    assert [(r.i, r.j) for r in similar.similar_pairs(df, 0.99, "sparse").collect()] == [(0, 1)]


def test_exact_blocks_equal_row_by_row_dot(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((130, 16))
    m /= np.linalg.norm(m, axis=1)[:, None]
    m[129] = m[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "unit_id long, vec array<double>")
    a = df.select(F.col("unit_id").alias("i"), F.col("vec").alias("va"))
    b = df.select(F.col("unit_id").alias("j"), F.col("vec").alias("vb"))
    want = {(r.i, r.j): r.s for r in a.join(b, F.col("i") < F.col("j")).select("i", "j", dot(F.col("va"), F.col("vb")).alias("s")).where("s >= 0.5").collect()}
    for rows in (8, 50, 1000):
        got = {(r.i, r.j): r.cosine for r in similar.exact_pairs(df, 0.5, rows).collect()}
        assert got.keys() == want.keys() and (0, 129) in got
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_sparse_is_within_exact_and_cap_is_per_left_unit(spark):
    rng = np.random.default_rng(2)
    m = rng.standard_normal((60, 8))
    m /= np.linalg.norm(m, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "unit_id long, vec array<double>").cache()
    exact = {(r.i, r.j) for r in similar.exact_pairs(df, 0.6).collect()}
    assert {(r.i, r.j) for r in similar.sparse_pairs(df, 0.6).collect()} <= exact
    capped = similar.candidates(df, 3).groupBy("i").count().agg(F.max("count")).first()[0]
    assert capped == 3


def test_auto_loses_no_pair_at_any_size():
    assert similar.choose_index("auto") == similar.choose_index("exact") == "exact" and similar.choose_index("sparse") == "sparse"
    with pytest.raises(ValueError):
        similar.choose_index("annoy")


@pytest.mark.parametrize("threshold", [0.4, 0.5, 0.8])
def test_signatures_find_nearly_all_pairs(spark, threshold):
    units = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("vec"))
    if threshold == 0.8:  # the table has no such pairs: rows beside themselves with noise
        rng = np.random.default_rng(4)
        m = rng.normal(size=(400, 64))
        m = np.concatenate((m, m + rng.normal(size=m.shape) * 0.65))
        m /= np.linalg.norm(m, axis=1)[:, None]
        units = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "unit_id long, vec array<double>")
    exact = {(r.i, r.j) for r in similar.exact_pairs(units, threshold).collect()}
    found = {(r.i, r.j) for r in similar.sparse_pairs(units, threshold, block_rows=700).collect()}
    assert found <= exact and len(exact) > 5 and len(found) >= 0.9 * len(exact), (len(found), len(exact))


def test_prefixes_lose_no_pair_and_score_fewer_at_higher_thresholds(spark):
    rng = np.random.default_rng(14)
    m = np.where(rng.random((300, 40)) < 0.15, rng.integers(-3, 6, (300, 40)), 0).astype(float)
    m[250:] = m[:50] + np.where(rng.random((50, 40)) < 0.05, 1.0, 0.0)
    m *= rng.choice([0.5, 1.0, 2.0], 300)[:, None]  # not of length 1
    rows = [(k, f"p{k % 4}", k % 9, k % 9 + k % 30, v.tolist()) for k, v in enumerate(m)] + [(900, "p", 1, 2, [0.0] * 40), (901, "p", 1, 2, [1.0, 2.0]), (902, "q", 1, 2, [1.0, 2.0]), (903, "q", 1, 2, None)]
    spans = spark.createDataFrame(rows, "unit_id long, path string, start_line int, end_line int, vec array<double>").repartition(3)
    scored = []
    for threshold in (5.0, 20.0, 60.0):
        for df, block in ((spans, 2048), (spans.select("unit_id", "vec"), 13)):
            want = {(r.i, r.j): r.cosine for r in similar.exact_pairs(df, threshold).collect()}
            got = similar.prefix_pairs(df, threshold, block).collect()
            assert len(got) == len(want) and all(abs(want[r.i, r.j] - r.cosine) < 1e-9 for r in got)
        scored.append(similar.prefix_sizes(spans, similar.prefixes(spans, threshold)).agg(F.sum(F.col("n") * F.col("n"))).first()[0])
    assert scored[0] > scored[1] > scored[2] and len(want) > 5
    assert similar.prefix_pairs(spans.limit(0), 1.0).count() == 0
    with pytest.raises(ValueError):
        similar.prefix_pairs(spans, 0.0)


def test_votes_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(90, 8)))], "unit_id long, vec array<double>")
    for cap in (None, 4):
        whole, small = (sorted(map(tuple, similar.candidates(df, cap, rows).collect())) for rows in (1000, 11))
        assert whole == small
    values = {r.unit_id: [] for r in df.collect()}
    for r in similar.bands(df).orderBy("unit_id", "band").collect():
        values[r.unit_id].append(r.value)
    want = sorted((i, j, n) for i in values for j in values if i < j and (n := sum(x == y for x, y in zip(values[i], values[j]))))
    assert sorted(map(tuple, similar.candidates(df, None).collect())) == want


def test_planes_are_as_published():
    # Of the first plane: the coordinates of its first three draws, from the published outputs of the stream of seed 1.
    first = [0x910A2DEC89025CC1, 0xBEEB8DA1658EEC67, 0xF893A2EEFB32555E]
    assert similar.splitmix64(1, 3).tolist() == first and [x % 64 for x in first] == [1, 39, 30]
    one = np.zeros(64)
    where, sign = similar.splitmix64(1, 8192)[:32], similar.splitmix64(1, 8192)[4096:4128]
    for w, s in zip(where.tolist(), sign.tolist()):
        one[w % 64] += 1.0 if s & 1 else -1.0
    assert (similar.planes(64)[0] == one).all()


def test_ranks_of_originals_equal_a_sort_of_the_product(spark):
    rng = np.random.default_rng(8)
    q, c = np.round(rng.normal(size=(23, 3)), 1), np.round(rng.normal(size=(60, 3)), 1)  # rounded: many ties
    table = lambda m, base: spark.createDataFrame([(base + k, v.tolist()) for k, v in enumerate(m)], "unit_id long, vec array<double>")
    truth = sorted({(k, 100 + int(rng.integers(0, 60))) for k in range(20) for _ in range(2)} | {(0, 100 + k) for k in range(60)} | {(1, 999)})
    got = {r.q: r for r in similar.rank_originals(table(q, 0), table(c, 100), spark.createDataFrame(truth, "q long, u long"), 6, block_rows=9).collect()}
    want = {}
    for k in range(23):
        s = np.round(q[k] @ c.T, 6)
        order = sorted(range(60), key=lambda u: (-s[u], u))
        true = [u for u in order if (k, 100 + u) in truth]
        others = [u for u in order if (k, 100 + u) not in truth]
        if true:
            want[k] = (order.index(true[0]) + 1, s[true[0]], s[true[0]] - (s[others[0]] if others else 0), 100 + order[0])
    assert got.keys() == want.keys()
    for k, (rank, cos, margin, hit) in want.items():
        r = got[k]
        assert (r["rank"], r.top_hit) == (rank, hit) and abs(r.cos_orig - cos) < 1e-9 and abs(r.margin - margin) < 1e-9


def test_suffixes_meet_as_equal_keys(spark):
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(["a/b.rs", "b.rs", "ab.rs", "é/日本.rs", "", None])], "k long, path string")
    ends = spark.createDataFrame([("b.rs",), ("/b.rs",), ("本.rs",), ("",), (None,), ("much/longer/than/any.rs",)], "end string")
    got = sorted((r.k, r.end) for r in by_suffix(rows, "path", ends, "end").collect())
    want = sorted((r.k, e.end) for r in rows.collect() for e in ends.collect() if r.path is not None and e.end is not None and r.path.endswith(e.end))
    assert got == want
    assert by_suffix(rows, "path", ends.limit(0), "end").count() == 0
    plan = by_suffix(rows, "path", ends, "end")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_passages_contained(spark):
    texts = [(1, "the cat sat"), (2, "a cat"), (3, None), (4, ""), (5, "日本 cat sat日本")]
    passages = [(10, "cat"), (11, "cat"), (12, "cat sat"), (13, ""), (14, None), (15, "日本"), (None, "zzz")]
    t, p = spark.createDataFrame(texts, "u long, text string"), spark.createDataFrame(passages, "q long, text string")
    want = sorted((q, u) for q, a in passages for u, b in texts if a and b and a in b)
    for chars in (4_000_000, 4):
        assert sorted(map(tuple, evaluate.contained(t, p, chars).collect())) == want
    assert evaluate.contained(t, p.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [200_000, 50])
def test_sweeps_equal_comparing_all_spans(spark, monkeypatch, rows):
    monkeypatch.setattr(overlap, "SWEEP_ROWS", rows)
    rng = random.Random(9)
    spans = [(k, rng.choice(["a", "b", "c", None, *(f"f{i}" for i in range(30))]), (s := rng.randrange(400)), s + rng.choice([0, 1, 3, 10, 60, 300]), rng.choice(["block", "block", "function"])) for k in range(900)]
    u = units(spark, spans).repartition(3)
    meets = lambda x, y: x[1] is not None and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3]
    blocks = [x for x in spans if x[4] == "block"]
    want = {x[0] for x in spans if x[4] != "block" or not any(meets(x, y) and x[3] - x[2] > y[3] - y[2] for y in blocks)}
    assert {r.unit_id for r in overlap.drop_overlapping_blocks(u).collect()} == want
    members = u.withColumn("cluster_id", F.col("unit_id") % 5)
    want = {x[0] for x in spans if not any(x[0] % 5 == y[0] % 5 and meets(x, y) and x[3] - x[2] > y[3] - y[2] for y in spans)}
    assert {r.unit_id for r in overlap.drop_larger_members(members).collect()} == want
    ranges = [(rng.choice(["a", "b", "f1", "f2", None, "zz"]), (lo := rng.randrange(400)), lo + rng.randrange(5)) for _ in range(25)]
    got = [r.unit_id for r in overlap.touched(u, spark.createDataFrame(ranges, "path string, lo int, hi int")).collect()]
    assert sorted(got) == sorted(x[0] for x in spans if any(x[1] is not None and x[1] == p and x[2] <= hi and lo <= x[3] for p, lo, hi in ranges))


def test_only_clusters_that_lost_a_member_are_labelled_anew(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(clusters, "labelled", lambda pairs, f=clusters.labelled: seen.append(pairs.count()) or f(pairs))
    u = units(spark, [(k, f"p{k}", 1, 9, "block") for k in range(40)] + [(50, "a", 1, 10, "block"), (51, "a", 3, 5, "block"), (52, "b", 1, 9, "block"), (53, "c", 1, 9, "block")])
    pairs = [(k, k + 1, 0.9) for k in range(39)] + [(50, 52, 0.9), (50, 51, 0.9), (51, 53, 0.9)]
    members, left, _ = clusters.pruned(spark.createDataFrame(pairs, "i long, j long, cosine double"), u)
    assert {(r.unit_id, r.cluster_id, r.parent_id) for r in members.collect()} == {(k, 0, 0) for k in range(40)} | {(51, 51, 50), (53, 51, 50)}
    assert left.count() == 40 and seen == [42, 1]


def test_ragged_and_empty_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0])], "unit_id long, vec array<double>")
    assert [(r.i, r.j) for r in similar.exact_pairs(df, 0.9).collect()] == [(0, 1)]
    assert similar.exact_pairs(df.limit(0), 0.9).count() == 0
    assert packed([]) is None and packed([[]]) is None and packed([[1.0], [1.0, 2.0]]) is None


def test_contained_spans_of_one_file_are_no_pair(spark):
    rows = [(0, "a", 1, 9), (1, "a", 2, 3), (2, "a", 8, 12), (3, "b", 1, 9)]
    df = spark.createDataFrame([(*r, [1.0, 0.0]) for r in rows], "unit_id long, path string, start_line int, end_line int, vec array<double>")
    assert {(r.i, r.j) for r in similar.exact_pairs(df, 0.9).collect()} == {(0, 2), (0, 3), (1, 2), (1, 3), (2, 3)}


def test_overlap_prune_splits_and_counts_hidden(spark):
    u = units(spark, [(0, "a", 1, 10, "block"), (1, "a", 3, 5, "block"), (2, "b", 1, 10, "block"), (3, "b", 3, 5, "block")])
    pairs = spark.createDataFrame([(0, 2, 0.9), (0, 3, 0.9), (1, 3, 0.9)], "i long, j long, cosine double")
    members, left, before = clusters.pruned(pairs, u)
    assert {(r.unit_id, r.cluster_id) for r in members.collect()} == {(1, 1), (3, 1)}
    assert [(r.i, r.j) for r in left.collect()] == [(1, 3)]
    assert [tuple(r) for r in clusters.hidden_overlaps(members, before).collect()] == [(1, 2)]


def test_blocks_go_functions_stay(spark):
    u = units(spark, [(0, "a", 1, 10, "block"), (1, "a", 3, 5, "block"), (2, "a", 12, 20, "block"), (3, "b", 1, 10, "block"), (4, "a", 1, 30, "function")])
    assert {r.unit_id for r in overlap.drop_overlapping_blocks(u).collect()} == {1, 2, 3, 4}


def test_nested_prune_decides_once(spark):
    u = units(spark, [(0, "a", 1, 30, "block"), (1, "a", 2, 20, "block"), (2, "a", 3, 5, "block"), (3, "a", 40, 45, "block"), (4, "a", 41, 46, "block")])
    assert {r.unit_id for r in overlap.drop_overlapping_blocks(u).collect()} == {2, 3, 4}


def test_cluster_order_prefers_long_spans(spark):
    rows = [(0, 2, 1, 10, 0.99), (2, 2, 1, 80, 0.80), (5, 3, 1, 80, 0.85)]
    s = spark.createDataFrame(rows, "cluster_id long, n_members long, n_pairs long, max_span long, top_score double")
    assert [r.cluster_id for r in clusters.ordered(s, top=2).orderBy("place").collect()] == [5, 2]
    assert [r.cluster_id for r in clusters.ordered(s, min_members=3).collect()] == [5]


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7), (5, 6), (6, 5)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: top(v) for v in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def union_find(edges):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return {v: top(v) for v in parent}


def test_components_do_not_depend_on_how_many_edges_a_task_holds(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(-300, 300), rng.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1400)] + [(None, 3), (9, 9), (4, None)]
    order = rng.sample(range(2000, 2400), 400)
    edges += list(zip(order, order[1:])) + [(5000, 5000 + k) for k in range(600)] + [(9000 + k, 9000 + k % 40) for k in range(500)]
    rng.shuffle(edges)
    want, df = union_find(edges), spark.createDataFrame(edges, "a long, b long").repartition(7)
    for chunk in (40, 300, 100_000):
        rows = components(df, chunk).collect()
        assert len(rows) == len(want) and {r.id: r.component for r in rows} == want


def test_tasks_pass_on_forests(spark):
    edges = spark.createDataFrame([(1, k) for k in range(2, 5000)] + [(k, 1) for k in range(2, 5000)], "a long, b long").coalesce(1)
    for seed in (None, 3):
        rows = forests(edges, seed, 100).collect()
        assert len({(r.a, r.b) for r in rows}) >= 4999 and len(rows) <= 2 * 10_000  # at most a star of each piece
    assert forests(edges, None, 100_000).count() == 4999


def test_heavy_keys_are_joined_whole(spark):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 1, k) for k in range(3000)] + [(None, 9)], "key long, n long")
    table = spark.createDataFrame([(1, "hot"), (2, "cold"), (3, "cold")], "key long, name string")
    inner = join_heavy(rows, table, "key", F.col("name") == "hot", ["n"])
    assert inner.count() == rows.where("key IN (1, 2, 3)").count() and inner.where("key = 1 AND name = 'hot'").count() == rows.where("key = 1").count()
    left = join_heavy(rows, table, "key", F.col("name") == "hot", ["n"], inner=False)
    assert left.count() == 3001 and left.where("name IS NULL").count() == rows.where("key IS NULL OR key NOT IN (1, 2, 3)").count()


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(normalized(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert from_bytes(to_bytes([1.5, -2.0])).tolist() == [1.5, -2.0]
    with pytest.raises(ValueError):
        from_bytes(b"12345")


def test_generator_gives_its_published_outputs():
    assert similar.splitmix64(1234567, 3).tolist() == [6457827717110365317, 3203168211198807973, 9817491932198370423]
    p = similar.planes(64)
    assert p.shape == (128, 64) and (abs(p).sum(1) <= 32).all() and len({r.tobytes() for r in p}) == 128


def test_scored_leaves_pairs_out_and_keeps_no_lower_score(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(40, 4))
    rows = spark.createDataFrame([(k, m[k].tolist()) for k in range(40)], "unit_id long, vec array<double>")
    q, gone = rows.where("unit_id % 5 = 0"), [(k, u) for k in range(0, 40, 5) for u in (k, k + 1)]
    out = spark.createDataFrame(gone, "q long, u long")
    s = m @ m.T
    left = {k: sorted((u for u in range(40) if (k, u) not in gone), key=lambda u: (-s[k, u], u)) for k in range(0, 40, 5)}
    got = similar.scored(q, rows, block_rows=7, top=3, pairs_out=out).collect()
    assert sorted((r.q, r["rank"], r.u) for r in got) == [(k, n + 1, u) for k, us in left.items() for n, u in enumerate(us[:3])]
    got = similar.scored(q, rows, block_rows=7, pairs_out=out, least=1.0).collect()
    assert sorted((r.q, r.u) for r in got) == sorted((k, u) for k, us in left.items() for u in us if s[k, u] >= 1.0)
    assert similar.scored(q.limit(0), rows, top=3, pairs_out=out).count() == 0


def test_all_pairs_shuffle_rows_once(spark):
    """However many blocks there are, a pair of blocks is read from where they lie."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    units = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "unit_id long, vec array<double>")
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if v[i] @ v[j] >= 0.6}
    for pairs in (similar.exact_pairs(units, 0.6, block_rows=10), similar.sparse_pairs(units, 0.6, 1e-12, 10), similar.candidates(units, None, 10)):
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan
        if "cosine" in pairs.columns:
            assert {(r.i, r.j) for r in pairs.collect()} == want


def test_products_of_large_and_odd_numbers(spark):
    """What single precision can't hold is multiplied in double; ties at the threshold stay in."""
    side = lambda v: similar.Side(np.arange(len(v)), np.array(v, float), None, np.zeros(len(v), int), np.zeros(len(v), int))
    a = [[1e25, 0.0], [0.6, 0.8], [float("nan"), 1.0], [1e-30, 0.0]]
    for among in (None, np.ones((4, 4), bool)):
        for rows, threshold in ((a, 0.5), (a[1:2] * 4, 1.0), (a[3:] * 4, 0.0)):
            x = side(rows)
            p, q, s = similar.reaching(x, x, threshold, among if len(rows) == 4 else None)
            want = x.vecs @ x.vecs.T
            assert sorted(zip(p.tolist(), q.tolist())) == sorted(zip(*(k.tolist() for k in np.nonzero(want >= threshold))))


def test_pairs_of_few_keys_are_written_out_last(spark):
    """Lists of ids meet; their pairs are spread over tasks, and no exchange or aggregate has a row for each pair."""
    from twinspect.operators import diffs

    side = lambda n, at: spark.range(at, at + n).select(F.col("id").alias("unit_id"), F.lit("n").alias("name"), F.when(F.col("id") % 3 == 0, "./a/f.py").when(F.col("id") % 3 == 1, "f.py").otherwise("x/f.py").alias("path"))
    got = diffs.stale_selves(side(300, 0), side(90, 3000))
    same = lambda a, b: a % 3 == b % 3 or 1 in (a % 3, b % 3)
    rows = [(r.q, r.u) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(a, b) for a in range(300) for b in range(3000, 3090) if same(a, b)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan and "HashAggregate" not in plan
    most = max(n for (n,) in got.select(F.spark_partition_id().alias("p")).groupBy("p").count().select("count").collect())
    assert most < len(rows)


def test_links_give_the_clusters_and_totals_of_all_pairs(spark, monkeypatch):
    """Members, pairs counted and best scores are the same without a list of pairs, also where overlaps split clusters; a task of many
    copies passes on as many rows as it has, not their pairs."""
    monkeypatch.setattr(similar, "MOST_PAIRS", 50)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 16))
    rows = []
    for k in range(260):
        v = base[k % 12] + rng.normal(size=16) * (0.02 if k % 3 else 0.45)
        rows.append((k, (v / np.sqrt(v @ v)).tolist(), f"f{k % 9}", k % 50, k % 50 + k % 31))
    units = spark.createDataFrame(rows, "unit_id long, vec array<double>, path string, start_line int, end_line int").localCheckpoint()
    rows_of = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    for find in (lambda u, **k: similar.exact_pairs(u, 0.9, 40, **k), lambda u, **k: similar.sparse_pairs(u, 0.9, block_rows=40, **k)):
        members, left, before = clusters.pruned(find(units), units)
        mine, totals, mine_before = clusters.pruned_links(units, lambda u: find(u, links=True))
        assert rows_of(mine_before.select(*before.columns)) == rows_of(before) and before.count() > mine.count() > 0
        assert rows_of(mine.select(*members.columns)) == rows_of(members)
        assert rows_of(clusters.with_totals(mine, totals)) == rows_of(clusters.summary(members, left))
    copies = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(300)], "unit_id long, vec array<double>")
    links = similar.exact_pairs(copies, 0.9, links=True).collect()
    assert len(links) == 300 and sum(r.n for r in links) == 300 * 299 // 2 and {r.root for r in links} == {0}


def test_few_rows_are_multiplied_whole_and_no_pair_is_lost(spark, monkeypatch):
    """Of rows in groups only a group's own pairs are multiplied in full; ties at the threshold, zero rows and vectors of any length stay right."""
    monkeypatch.setattr(similar, "LEAST_PAIRS", 1)
    rng = np.random.default_rng(8)
    v = rng.normal(size=(12, 64))[np.arange(1500) % 12] + rng.normal(size=(1500, 64)) * 0.2
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[:20], v[20:40], v[40:60], v[60:64] = 0.0, np.eye(64)[0], 0.95 * np.eye(64)[0], 3 * v[64:68]
    v = v[similar._by_likeness(v)]
    i, j = np.nonzero(np.triu(v @ v.T >= 0.95, 1))
    piece = (64, np.arange(1500).tobytes(), v.tobytes(), None, np.zeros(1500, np.int64).tobytes(), np.zeros(1500, np.int64).tobytes())
    for scores in (True, False):
        seen = []

        def found(a, b):
            seen.append(len(a.ids) * len(b.ids))
            return similar.reaching(a, b, 0.95, scores=scores)

        got = list(similar._pairs_of(found, "cosine" if scores else None, 0.95)([piece], [piece], None))
        pairs = [p for batch in got for p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        assert sorted(pairs) == sorted(zip(i.tolist(), j.tolist())) and len(pairs) > 1000
        assert sum(seen) < 1500 * 1500 // 3
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "unit_id long, vec array<double>")
    assert sorted(map(tuple, similar.exact_pairs(df, 0.95, 400, scores=False).collect())) == sorted(zip(i.tolist(), j.tolist()))


def test_blocks_lie_in_files_and_rows_of_spark_are_paths(spark):
    """However large a block is, no row that Spark joins or sends to Python holds its vectors; files hold each row once."""
    from twinspect.session import read_batch

    rng = np.random.default_rng(9)
    v = rng.normal(size=(700, 24))
    df = spark.createDataFrame([(k, x[: 24 - k % 2].tolist(), f"p{k}") for k, x in enumerate(v)], "unit_id long, vec array<double>, path string")
    blocks = similar._blocks(df, 3)
    assert dict(blocks.dtypes) == {"block": "bigint", "dim": "int", "path": "string"}
    held = {}
    for r in blocks.collect():
        side = similar.Side.of([tuple(read_batch(r.path).column(k)[0].as_py() for k in range(1, 7))], r.dim)
        assert set(similar._block_of(side.ids, 3)) == {r.block} and len(side.ids) > 0
        held |= {int(i): (x, p) for i, x, p in zip(side.ids, side.vecs, side.paths)}
    assert len(held) == 700 and all(p == f"p{k}" and (x == v[k][: 24 - k % 2]).all() for k, (x, p) in held.items())
    plan = similar.exact_pairs(df, 0.9, 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan and "vecs" not in plan


def test_blocks_of_like_rows_lose_no_pair_and_are_bounded(spark, monkeypatch):
    """A tree deals like rows into one block and many copies of one row into several; pairs across blocks, also of other lengths, stay in."""
    monkeypatch.setattr(similar, "LEAST_PAIRS", 1)
    monkeypatch.setattr(similar, "FEW_BLOCKS", 4)
    monkeypatch.setattr(similar, "LARGER", 1)
    rng = np.random.default_rng(10)
    group = np.arange(1600) % 8
    v = rng.normal(size=(8, 64))[group] + rng.normal(size=(1600, 64)) * 0.25
    v[group == 0] = v[0]
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(2000 + k, [1.0, 0.0]) for k in range(20)], "unit_id long, vec array<double>").localCheckpoint()
    i, j = np.nonzero(np.triu(v @ v.T >= 0.94, 1))
    want = sorted(zip(i.tolist(), j.tolist())) + [(2000 + a, 2000 + b) for a in range(20) for b in range(a + 1, 20)]
    assert sorted(map(tuple, similar.exact_pairs(df, 0.94, 100, scores=False).collect())) == want
    tree, n_blocks = similar._tree(df, 1620, 16)
    blocks = tree.blocks(np.arange(1600), v)
    sizes = np.bincount(blocks, minlength=n_blocks)
    assert n_blocks < 64 and sizes.max() <= 2 * 102 and len(set(blocks[group == 0])) > 1
    assert np.mean([len(set(group[blocks == b])) for b in set(blocks)]) < 4  # by id, a block has rows of all 8
