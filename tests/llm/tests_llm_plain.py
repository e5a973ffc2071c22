"""Plain Python versions of what the pipeline's stages decide."""

import hashlib
import math
from collections import Counter


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows, tenths):
    """Lists of rows (doc_id, text, ...) that are linked, directly or not, by tenths / 10 of their shingles or more."""
    sets, part = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 10 * both >= tenths * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((part[a], part[b]))
                part = [low if p == high else p for p in part]
    return [[r for r, p in zip(rows, part) if p == k] for k in sorted(set(part))]


def overlaps(doc, passage):
    """Whether 13 words in a row (or a whole shorter passage) agree in four fifths of their places."""
    least = min(13, len(passage))
    for shift in range(-len(passage) + 1, len(doc)):
        a, b = max(0, -shift), min(len(passage), len(doc) - shift)
        same = [doc[k + shift] == passage[k] for k in range(a, b)]
        if any(5 * sum(same[i:j]) >= 4 * (j - i) for i in range(len(same)) for j in range(i + least, len(same) + 1)):
            return True
    return False


def mixed(rows, seed=11):
    """How often each row (doc_id, text, source) is taken by the mix, as a multiset of rows."""
    size = lambda r: len((r[1] or "").split())
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(r) for r in rows if r[2] == s) for s in sources}
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(sources)}
    left, target, open_ = float(sum(total.values())), {}, list(sources)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_} if open_ else {}
        over = [s for s in open_ if share[s] > 3 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
            open_.remove(s)

    def key(r):
        name = str(r[0]) if r[0] is not None else "text:" + hashlib.md5((r[1] or "").encode()).hexdigest()
        u = (int(hashlib.md5(f"{name}:{seed}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        junk = sum(c in "#*$%&|<>!" for c in r[1] or "")
        return -math.log(u) / (max(0.05, 1 - 5 * junk / size(r)) if size(r) else 0.05)

    out = Counter()
    for s in sources:
        epochs, upto = (int(target[s] // total[s]) if total[s] else 0), 0
        rest = target[s] - epochs * total[s]
        for r in sorted((r for r in rows if r[2] == s), key=lambda r: (key(r), r[0] is not None, r[0] or 0, size(r))):
            upto += size(r)
            n = epochs + (upto - size(r) / 2 < rest)
            if size(r) and n:
                out[r] += n
    return out
