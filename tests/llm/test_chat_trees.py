"""Reply trees: branches ranked through jump tables, against a walk up from every leaf."""

import random

from twinspect.llm import chat

SCHEMA = "tree long, node long, parent long, role string, text string, score double"


def plain(rows, keep):
    """{(tree, leaf): (branch, nodes from the leaf up)} of the best branches."""
    above = {(r[0], r[1]): r[2] for r in rows}
    score = {(r[0], r[1]): r[5] or 0.0 for r in rows}
    inner = {(r[0], r[2]) for r in rows if (r[0], r[2]) in above}
    found = {}
    for tree, leaf in above.keys() - inner:
        path, node, seen = [], leaf, set()
        while (tree, node) in above and node not in seen:
            path.append(node)
            seen.add(node)
            node = above[tree, node]
        if node not in seen:
            mean = round(sum(score[tree, n] for n in path) / len(path), 9)
            found.setdefault(tree, []).append((-mean, -len(path), leaf, path))
    return {(t, leaf): (k + 1, path) for t, all_ in found.items() for k, (_, _, leaf, path) in enumerate(sorted(all_)[:keep])}


def chosen(spark, rows, keep):
    out = {}
    for r in chat.choose_paths(spark.createDataFrame(rows, SCHEMA).repartition(3), keep).collect():
        out.setdefault((r.tree, r.leaf), []).append((r.up, r.branch, int(r.text[1:])))
    return {k: (v[0][1], [n for _, _, n in sorted(v)]) for k, v in out.items()}


def test_random_trees_with_cycles_and_missing_parents(spark):
    rng = random.Random(12)
    rows = []
    for tree in [*range(12), None]:
        n = rng.randrange(1, 40)
        for node in range(n):
            parent = rng.choice([None, rng.randrange(n), rng.randrange(max(1, node)), max(0, node - 1), 999])
            rows.append((tree, node, parent, "user", f"t{node}", float(rng.randrange(64)) / 8))
    for keep in (1, 3):
        assert chosen(spark, rows, keep) == plain(rows, keep)


def test_a_long_spine_with_replies_at_every_message(spark, monkeypatch):
    n = 1500
    rows = [(1, k, k - 1 if k else None, "user", f"t{k}", 1.0) for k in range(n)] + [(1, n + k, k, "assistant", f"t{n + k}", 1.0 + (k == 700)) for k in range(n)]
    most, real = [0], chat.cut
    monkeypatch.setattr(chat, "cut", lambda df, **o: (lambda d: most.__setitem__(0, max(most[0], d.count())) or d)(real(df, **o)))
    got = chosen(spark, rows, 2)
    assert got == plain(rows, 2)
    assert most[0] <= 2 * n  # nothing of the size of all paths was written


def test_many_replies_to_one_message(spark):
    rows = [(None, 0, None, "user", "t0", 0.0)] + [(None, k, 0, "user", f"t{k}", float(k % 50)) for k in range(1, 3000)]
    assert chosen(spark, rows, 3) == plain(rows, 3)
