"""The pipeline's stages on planted cases, against plain Python that shares nothing with the operators."""

import random

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def one_of_each_group(rows, tenths):
    """Ids of the first document of each component of documents that share tenths / 10 of their shingles or more."""
    sets, part = {i: shingles(t) for i, t, _ in rows}, {i: i for i, _, _ in rows}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 10 * both >= tenths * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((part[a], part[b]))
                part = {i: low if p == high else p for i, p in part.items()}
    return sorted(set(part.values()))


def test_near_duplicates_go_from_eight_tenths_on(spark):
    rng = random.Random(31)
    rows = []
    for edits in ((), (20,), (20, 60), (20, 50, 80)):  # 1, 0.90, 0.81 and 0.73 of the shingles of 100 words
        for _ in range(6):
            words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
            rows.append(words)
            rows.append([f"e{rng.randrange(10**6)}" if k in edits else w for k, w in enumerate(words)])
    for at in (2, 3):  # 24 of 30 shingles of 31 words, and 23 of 31
        words = [f"w{rng.randrange(10**6)}" for _ in range(31)]
        rows += [words, [*words[:at], "other", *words[at + 1 :]]]
    rows = [(i, " ".join(w), "s") for i, w in enumerate(rows)] + [(900, "", "s"), (901, None, "s"), (902, "a b", "s"), (903, "A  b", "s")]
    got = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), "")
    assert sorted(r.doc_id for r in got.collect()) == one_of_each_group(rows, 8)
    assert len(one_of_each_group(rows, 8)) == len(one_of_each_group(rows, 8.5)) - 7
