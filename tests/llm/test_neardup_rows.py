"""Near duplicates: ids that repeat or are missing, and many classes that share a passage."""

import random

from twinspect.llm import neardup
from twinspect.operators import graph


def words(rng, n):
    return [f"w{rng.randrange(10**7)}" for _ in range(n)]


def changed(rng, w, at):
    return [*w[:at], f"e{rng.randrange(10**7)}", *w[at + 1 :]]


def result(spark, rows):
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    return neardup.near_duplicates(df).collect()


def test_an_id_on_two_texts_hides_neither(spark):
    rng = random.Random(41)
    a, b = words(rng, 60), words(rng, 60)
    got = result(spark, [(1, a), (1, b), (2, changed(rng, a, 3)), (3, changed(rng, b, 3))])
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]
    assert sorted(r.doc_id for r in got if r.chosen) == [1, 1]
    # two texts of one id that are linked with each other: one of them is chosen
    got = result(spark, [(1, a), (1, changed(rng, a, 2))])
    assert [r.kept for r in got] == [True, True] and sum(r.chosen for r in got) == 1


def test_rows_without_an_id_are_compared(spark):
    rng = random.Random(42)
    a, b = words(rng, 60), words(rng, 60)
    got = result(spark, [(None, a), (5, changed(rng, a, 2)), (None, b), (None, changed(rng, b, 2)), (None, words(rng, 40))])
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("5", "5"), ("None", "5"), ("None", "None"), ("None", "None"), ("None", "None")]
    assert sum(r.chosen for r in got) == 3 and sum(r.kept for r in got) == 3


def test_a_common_passage_links_nobody_and_hides_no_link(spark):
    rng = random.Random(43)
    passage, rows = words(rng, 60), []
    for k in range(1500):
        own = words(rng, 25)
        rows.append((10 * k, passage + own))
        if k % 50 == 0:
            rows.append((10 * k + 1, passage + changed(rng, own, 24)))
    got = {r.doc_id: r.component_id for r in result(spark, rows)}
    assert got == {i: i - i % 10 for i, _ in rows}


def test_blocks_of_all_sizes_give_the_same_components(spark, monkeypatch):
    rng = random.Random(44)
    rows, n = [], 0
    for size in (20, 40, 47, 56, 66, 78):  # sizes at the edge of what can be linked
        base = words(rng, size)
        for _ in range(12):
            w = list(base)
            for _ in range(2):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**7)}"
            rows.append((n, w))
            n += 1
    want = None
    for rows_a_block, chunk in ((512, 512), (5, 3)):
        monkeypatch.setattr(neardup.across, "__defaults__", (rows_a_block, 85))
        monkeypatch.setattr(neardup.confirmed, "__defaults__", (85, chunk))
        got = {r.doc_id: r.component_id for r in result(spark, rows)}
        want = want or got
        assert got == want
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in rows}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                assert want[a] == want[b]


def test_a_few_links_are_settled_without_rounds(spark, monkeypatch):
    rng = random.Random(45)
    passage, rows = words(rng, 60), []
    for k in range(60):
        own = words(rng, 25)
        rows += [(10 * k, passage + own), (10 * k + 1, passage + changed(rng, own, 24))]
    written, cut, calls = [], graph.cut, []
    monkeypatch.setattr(graph, "cut", lambda df, **options: written.append(1) or cut(df, **options))
    monkeypatch.setattr(neardup, "components", lambda edges: calls.append(1) or graph.components(edges))
    got = {r.doc_id: r.component_id for r in result(spark, rows)}
    assert got == {i: i - i % 10 for i, _ in rows}
    assert calls and len(written) == 2 * len(calls)  # the edges and the components of each, no rounds
