"""Benchmark decontamination by spaced-seed hashing with verified, substitution-tolerant overlaps.

Fixed masks look at some of neighbouring words and ignore the others. Their hashes at every place of a benchmark passage
are joined with the hashes at every place of a document, and around a hit the passage and the text are compared word by
word along the hit's diagonal: an overlap counts if OVERLAP words in a row (or all words of a shorter passage) agree in
SHARE of their places or more. No such overlap is missed: every pattern of one substitution in five words leaves a mask
of MASKS unhurt in a row of OVERLAP words or more, and one of SHORT_MASKS in a passage of 5 words or more; passages of fewer
words must agree in all. (Longer rows can be cut into rows of 13 to 25 words of which one has no more substitutions than
its share; tests go through all patterns up to there.)

A benchmark of at most BLOCK_WORDS words (and 40 bytes for each) is a table that is broadcast, and documents are read once. A
larger one is joined: the places of its hashes set the bits of a map of fixed size, which tells the documents' hashes that can meet
none; the others are joined with the passages' hashes, and each document meets its candidates, BLOCK_WORDS words at a time. A
hash of more than LIST passages lists no pairs; the words around its places are compared first, in blocks. Documents are read
two or three times then, whatever the benchmark's size.

Words are split at 0x20 and 0x09-0x0D, A-Z are lower-cased and punctuation at their ends is dropped.

Defined cases: null or empty texts and passages have no words and no overlap; repeated documents are reported once per id
and text; repeated passages once per id; rows without an id are reported with a null id; empty tables give an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinspect.llm.common import heavy_from, join_heavy, text_key, word_list
from twinspect.llm.shingles import LOWER, WordHashes, mixed
from twinspect.session import cut, load

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 8, 9), (0, 1, 4, 8, 10))
SHORT_MASKS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 2, 3, 4), (0, 1, 2, 4))
OVERLAP = 13
SHARE = 0.8
BLOCK_WORDS = 400_000
BYTES_A_WORD = 40
BATCH_BYTES = 4_000_000
LIST = 16  # passages of a seed that are listed
REACH = 24  # words to either side of a crowded seed
SIDE = 2048  # places of a crowded seed in a block
SPREAD = 1000  # documents to a copy of a passage
MAP_BITS = 27
EDGES = b".,;:!?\"'()[]{}|*#%&$<>-"


class PlainHashes(WordHashes):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.strip(EDGES) or word)
        return h


WORDS = PlainHashes()


def words_of(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def seed_hashes(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The mask's hash at every place it fits."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(n, sum(1 << o for o in mask[:60]) & 0xFFFFFFFF, np.uint64)
        for o in mask:
            h = (h ^ words[o : o + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return mixed(h)


def masks_for(n_words: int) -> tuple[tuple[int, ...], ...]:
    """The masks of which one meets every overlap with a passage of n_words words."""
    return MASKS if n_words >= OVERLAP else SHORT_MASKS if n_words >= 5 else (tuple(range(n_words)),)


class Block:
    """Passages with a table of their seeds, by mask."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in items]
        self.words = [words_of(t) for _, t in items]
        found: dict[tuple[int, ...], list] = {}
        for k, w in enumerate(self.words):
            for mask in masks_for(len(w)) if len(w) else []:
                h = seed_hashes(w, mask)
                found.setdefault(mask, []).append((h, np.full(len(h), k, np.int32), np.arange(len(h), dtype=np.int32)))
        self.tables = {}
        for mask, parts in found.items():
            h, k, q = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[h >> np.uint64(44)] = True
            self.tables[mask] = (h[order], k[order], q[order], seen)


def best_overlap(text: np.ndarray, passage: np.ndarray, shift: int) -> tuple[int, int] | None:
    """The longest run of places along a diagonal in which SHARE agree: (places, agreeing). shift: place in the text minus place in the passage."""
    a, b = max(0, -shift), min(len(passage), len(text) - shift)
    least = min(OVERLAP, len(passage))
    if b - a < least:
        return None
    upto = np.concatenate(([0], np.cumsum(text[a + shift : b + shift] == passage[a:b])))
    gain = 10 * upto - round(10 * SHARE) * np.arange(len(upto))
    # A run from i to j counts if gain[j] >= gain[i]: the first such i lies where the least gain so far falls to gain[j].
    first = np.searchsorted(-np.minimum.accumulate(gain), -gain, "left")
    places = np.arange(len(gain)) - first
    if places.max() < least:
        return None
    ends = np.flatnonzero(places == places.max())
    return int(places.max()), int((upto[ends] - upto[first[ends]]).max())


def overlaps(words: np.ndarray, starts: np.ndarray, block: Block) -> list[tuple[int, int, int, int]]:
    """(text, passage, places, agreeing) for texts joined in one array; text i reaches from starts[i] to starts[i + 1]."""
    hits = []
    for mask, (keys, items, places, seen) in block.tables.items():
        h = seed_hashes(words, mask)
        at = np.flatnonzero(seen[h >> np.uint64(44)])
        if not len(at):
            continue
        lo, hi = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
        n = hi - lo
        at, lo = np.repeat(at, n), np.repeat(lo, n)
        if not len(at):
            continue
        row = lo + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        doc = np.searchsorted(starts, at, "right") - 1
        inside = at + mask[-1] < starts[doc + 1]
        hits.append(np.stack([doc, items[row], at - starts[doc] - places[row]], 1)[inside])
    out: dict[tuple[int, int], tuple[int, int]] = {}
    if hits:
        for doc, item, shift in np.unique(np.concatenate(hits), axis=0).tolist():
            known = out.get((doc, item))
            if known and known[0] == known[1] == len(block.words[item]):
                continue
            got = best_overlap(words[starts[doc] : starts[doc + 1]], block.words[item], shift)
            if got and (known is None or got > known):
                out[doc, item] = got
    return [(d, i, *x) for (d, i), x in out.items()]


DOCUMENT = "doc_id long, k1 long, k2 long"
FOUND = [("item_id", pa.int64()), ("item_words", pa.int64()), ("n_overlap", pa.int64()), ("n_same", pa.int64())]


def _batch(rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(columns)], names=[n for n, _ in columns])


IDS = [("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())]


def _texts_in_parts(batches):
    """Lists of (ids, text) of documents with text, about BATCH_BYTES characters each."""
    part, size = [], 0
    for batch in batches:
        ids = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
        for i, t in zip(ids, batch.column(3)):
            if t := t.as_py():
                part.append((i, t))
                size += len(t)
                if size > BATCH_BYTES:
                    yield part
                    part, size = [], 0
    yield part


def _joined(part: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    words = [words_of(t) for _, t in part]
    return np.concatenate(words), np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)


def _look_up(docs: DataFrame, items: list[tuple[int | None, str | None]]) -> DataFrame:
    block = docs.sparkSession.sparkContext.broadcast(Block(items))  # at most about BLOCK_WORDS words

    def run(batches):
        table = block.value
        for part in _texts_in_parts(batches):
            out = []
            if part:
                for d, i, n, same in overlaps(*_joined(part), table):
                    out.append((*part[d][0], table.ids[i], len(table.words[i]), n, same))
            yield _batch(out, IDS + FOUND)

    return docs.mapInArrow(run, DOCUMENT + ", item_id long, item_words long, n_overlap long, n_same long")


def _map_of(seeds: DataFrame) -> np.ndarray:
    """A bitmap of 2 ** MAP_BITS bits with the slots of the seeds."""
    slots = seeds.select(F.shiftrightunsigned("seed", 64 - MAP_BITS).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot % 64 AS INT)))").alias("bits")).toPandas()  # at most 2 ** (MAP_BITS - 6) rows
    table = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    table[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return table


def _in_map(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - MAP_BITS)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _contexts(words: np.ndarray, mask: tuple[int, ...], bits: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(seeds, contexts) of the mask's places whose seed is in the map: REACH words to either side of the place, pad beyond the text."""
    h = seed_hashes(words, mask)
    at = np.flatnonzero(_in_map(h, bits))
    padded = np.full(len(words) + 2 * REACH, pad, np.uint64)
    padded[REACH : REACH + len(words)] = words
    return h[at].view(np.int64), padded[at[:, None] + np.arange(2 * REACH + 1)]


def _crowded(docs: DataFrame, passages: DataFrame, crowded: DataFrame, used: list) -> DataFrame:
    """(d, pid) that may overlap around a crowded seed, one of more than LIST passages. crowded: seed, many (passages).

    Pairs of such a seed aren't listed. Its places in passages and in documents, with the words around them, are dealt into blocks; a
    task lays a block of either side over each other, and passes on the pairs that agree in as many words as an overlap
    takes. That is quadratic in what shares a seed, but in comparisons inside a task alone.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_map_of(crowded))  # 2 ** MAP_BITS bits

    def places(batches, pad, masks_of, n_ids):
        bits = shared.value
        for batch in batches:
            ids = list(zip(*(batch.column(k).to_pylist() for k in range(n_ids))))
            for one, text in zip(ids, batch.column(n_ids)):
                w = words_of(text.as_py())
                least = min(OVERLAP, len(w))
                for mask in masks_of(w):
                    seeds, around = _contexts(w, mask, bits, pad)
                    for lo in range(0, len(seeds), 4096):
                        part = seeds[lo : lo + 4096]
                        yield pa.RecordBatch.from_arrays(
                            [*(pa.array([x] * len(part), pa.int64()) for x in one), pa.array(part), pa.array([len(mask)] * len(part), pa.int32()), pa.array([least] * len(part), pa.int32()), pa.array([x.tobytes() for x in around[lo : lo + 4096]], pa.binary())],
                            names=[f"c{k}" for k in range(n_ids)] + ["seed", "weight", "least", "around"],
                        )

    rest = "seed long, weight int, least int, around binary"
    of_p = passages.select("pid", "text").mapInArrow(lambda b: places(b, 1, lambda w: masks_for(len(w)) if len(w) else (), 1), f"c0 long, {rest}")
    of_d = docs.select("doc_id", "k1", "k2", "text").mapInArrow(lambda b: places(b, 2, lambda w: used if len(w) else (), 3), f"c0 long, c1 long, c2 long, {rest}")
    of_p, of_d = cut(of_p.where("least >= 5").join(crowded.select("seed"), "seed", "left_semi").drop("weight")), cut(of_d)
    counts = of_p.groupBy("seed").agg(F.count("*").alias("np"), F.min("least").alias("fewest")).join(of_d.groupBy("seed").agg(F.count("*").alias("nd")), "seed")
    counts = cut(counts.select("seed", F.ceil(F.col("np") / SIDE).alias("bp"), F.ceil(F.col("nd") / SIDE).alias("bd"), "np", "nd"))
    total = counts.agg(F.coalesce(F.sum(F.col("np") + F.col("nd")), F.lit(0))).first()[0]
    heavy = (F.col("np") + F.col("nd")) >= heavy_from(total)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    p = join_heavy(of_p.withColumn("salt", F.xxhash64("c0", "around")), counts, "seed", heavy, ["salt"])
    p = p.select("seed", F.pmod("salt", F.col("bp")).alias("x"), upto("bd").alias("y"), F.lit(0).alias("side"), F.struct(F.col("c0"), F.lit(None).cast("long").alias("c1"), F.lit(None).cast("long").alias("c2")).alias("who"), "least", "around")
    d = join_heavy(of_d.withColumn("salt", F.xxhash64("c0", "c1", "around")), counts, "seed", heavy, ["salt"])
    d = d.select("seed", upto("bp").alias("x"), F.pmod("salt", F.col("bd")).alias("y"), F.lit(1).alias("side"), F.struct("c0", "c1", "c2").alias("who"), "least", "around")
    rows = p.unionByName(d).repartition("seed", "x", "y").sortWithinPartitions("seed", "x", "y", "side")
    rows = rows.select("seed", "x", "y", "side", "who.c0", "who.c1", "who.c2", "least", "around")

    def compare(batches):
        key, sides = None, ([], [])

        def settle():
            first, second = sides
            found = set()
            if first and second:
                b = np.frombuffer(b"".join(r[4] for r in second), np.uint64).reshape(len(second), -1)
                for lo in range(0, len(first), 64):  # 64 passages' places at a time
                    part = first[lo : lo + 64]
                    a = np.frombuffer(b"".join(r[4] for r in part), np.uint64).reshape(len(part), -1)
                    same = np.zeros((len(part), len(second)), np.uint8)
                    for t in range(a.shape[1]):
                        same += a[:, None, t] == b[None, :, t]
                    least = np.array([-(-round(10 * SHARE) * r[3] // 10) for r in part])
                    for i, j in np.argwhere(same >= least[:, None]).tolist():
                        found.add((*second[j][:3], part[i][0]))
            return list(found)

        names = [*IDS, ("pid", pa.int64())]
        for batch in batches:
            for seed, x, y, side, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (seed, x, y) != key:
                    yield _batch(settle(), names)
                    key, sides = (seed, x, y), ([], [])
                sides[side].append(row)
        yield _batch(settle(), names)

    return rows.mapInArrow(compare, DOCUMENT + ", pid long").select(F.struct("doc_id", "k1", "k2").alias("d"), "pid")


def _join(docs: DataFrame, items: DataFrame, block_words: int) -> DataFrame:
    """As _look_up, for any number of passages (item_id, text). docs: doc_id, k1, k2, text."""
    passages = cut(items.groupBy("text").agg(F.collect_set("item_id").alias("ids"), F.max(F.col("item_id").isNull()).alias("none")).withColumn("pid", F.monotonically_increasing_id()))
    kinds = cut(passages.select(F.size(word_list(F.col("text"))).alias("n")).where("n > 0").distinct())
    used = sorted({m for r in kinds.select(F.least("n", F.lit(OVERLAP)).alias("n")).distinct().collect() for m in masks_for(r[0])})  # a few masks

    def seeds_of_passages(batches):
        for batch in batches:
            rows = []
            for pid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words_of(text)
                for mask in masks_for(len(w)) if len(w) else ():
                    rows += [(int(h), pid, len(w)) for h in np.unique(seed_hashes(w, mask)).view(np.int64)]
            yield _batch(rows, [("seed", pa.int64()), ("pid", pa.int64()), ("n", pa.int64())])

    of_passages = cut(passages.select("pid", "text").mapInArrow(seeds_of_passages, "seed long, pid long, n long").distinct())
    sizes = of_passages.groupBy("seed").agg(F.count("*").alias("many"), F.min("n").alias("fewest"))
    # A passage of fewer than 5 words is its seed, so what shares it does overlap.
    crowded = cut(sizes.where((F.col("many") > LIST) & (F.col("fewest") >= 5)).select("seed", "many"))
    shared = docs.sparkSession.sparkContext.broadcast(_map_of(of_passages))  # 2 ** MAP_BITS bits

    def seeds_of_documents(batches):
        bits = shared.value
        for part in _texts_in_parts(batches):
            for ids, text in part:
                w, found = words_of(text), []
                for mask in used:
                    h = np.unique(seed_hashes(w, mask))
                    found.append(h[_in_map(h, bits)])
                h = np.concatenate(found).view(np.int64)
                if len(h):
                    yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(h), pa.int64()) for x in ids), pa.array(h)], names=["doc_id", "k1", "k2", "seed"])

    of_documents = cut(docs.mapInArrow(seeds_of_documents, DOCUMENT + ", seed long")).withColumn("row_no", F.monotonically_increasing_id())
    often = of_documents.groupBy("seed").agg(F.count("*").alias("often"))
    # Passages of one seed in lists of LIST at most; of a crowded seed none are listed, unless they are too short to be looked at around it.
    nth = F.floor((F.row_number().over(Window.partitionBy("seed").orderBy("pid")) - 1) / LIST)
    lists = of_passages.join(crowded.select("seed"), "seed", "left_anti").withColumn("nth", nth).groupBy("seed", "nth").agg(F.collect_list("pid").alias("pids"))
    lists = cut(lists.join(often, "seed").withColumn("at", F.struct("seed", "nth")))
    widest = lists.groupBy("seed").agg(F.max("nth").alias("last")).where("last > 0")
    first = of_documents.withColumn("nth", F.lit(0).cast("bigint"))
    more = of_documents.join(widest, "seed").select(*of_documents.columns, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("last"))).alias("nth"))
    asked = first.unionByName(more).withColumn("at", F.struct("seed", "nth"))
    candidates = join_heavy(asked, lists.select("at", "pids", "often"), "at", F.col("often") >= heavy_from(of_documents.count()), ["row_no", "nth"])
    candidates = candidates.select(F.struct("doc_id", "k1", "k2").alias("d"), F.explode("pids").alias("pid"))
    if not crowded.isEmpty():
        candidates = candidates.unionByName(_crowded(docs, passages, crowded, used))
    candidates = cut(candidates.distinct())
    of_pid = candidates.groupBy("pid").agg(F.count("*").alias("often"))
    texts = cut(passages.select("pid", F.col("text").alias("passage")).join(of_pid, "pid"))
    # Rows of a passage that many documents may overlap with are spread by copies of it, one for each SPREAD documents.
    copies = F.ceil(F.col("often") / SPREAD)
    spread = join_heavy(candidates, texts.select("pid", "often"), "pid", F.col("often") >= heavy_from(candidates.count()), ["d"])
    spread = spread.withColumn("copy", F.pmod(F.xxhash64("d"), copies))
    copied = texts.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1))).select("pid", "copy", "passage")
    pairs = spread.join(copied, ["pid", "copy"]).select("d", "pid", "passage", F.lit(None).cast("string").alias("text"))
    whole = docs.select(F.struct("doc_id", "k1", "k2").alias("d"), "text").join(candidates.select(F.col("d").alias("e")).distinct(), F.col("d") == F.col("e"))
    whole = whole.groupBy("d").agg(F.first("text").alias("text")).select("d", F.lit(None).cast("long").alias("pid"), F.lit(None).cast("string").alias("passage"), "text")
    rows = whole.unionByName(pairs).repartition("d").sortWithinPartitions("d", F.col("pid").asc_nulls_first()).select("d.doc_id", "d.k1", "d.k2", "pid", "passage", "text")

    def verify(batches):
        now, words, held, size = None, None, [], 0

        def settle():
            block = Block(held)
            return [(*now, block.ids[i], len(block.words[i]), n, same) for _, i, n, same in overlaps(words, np.array([0, len(words)]), block)]

        for batch in batches:
            out = []
            for d, k1, k2, pid, passage, text in zip(*(c.to_pylist() for c in batch.columns)):
                if pid is None:
                    out += settle() if held else []
                    now, words, held, size = (d, k1, k2), words_of(text), [], 0
                else:
                    held.append((pid, passage))
                    size += len(passage)
                    if size > 6 * block_words:
                        out += settle()
                        held, size = [], 0
            yield _batch(out, [*IDS, ("pid", pa.int64()), *FOUND[1:]])
        yield _batch(settle() if held else [], [*IDS, ("pid", pa.int64()), *FOUND[1:]])

    found = rows.mapInArrow(verify, DOCUMENT + ", pid long, item_words long, n_overlap long, n_same long")
    ids = F.when(F.col("none"), F.concat("ids", F.array(F.lit(None).cast("long")))).otherwise(F.col("ids"))
    names = passages.select(F.col("pid").alias("p"), ids.alias("ids"))
    return found.join(names, F.col("pid") == F.col("p")).select("doc_id", "k1", "k2", F.explode("ids").alias("item_id"), "item_words", "n_overlap", "n_same")


def overlapping(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document (doc_id, k1, k2: its id and the hashes of its text) and passage that overlap: item_words, n_overlap, n_same."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[v.alias(k) for k, v in text_key(F.col("text")).items()], "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = items.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))  # others overlap with nothing
    total, size = items.agg(F.coalesce(F.sum(F.size(word_list(F.col("text")))), F.lit(0)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    small = total <= block_words and size <= BYTES_A_WORD * block_words
    found = _look_up(docs, [(r[0], r[1]) for r in items.collect()]) if small else _join(docs, items, block_words)
    best = found.groupBy("doc_id", "k1", "k2", "item_id").agg(F.max(F.struct("n_overlap", "n_same", "item_words")).alias("x"))
    return best.select("doc_id", "k1", "k2", "item_id", "x.item_words", "x.n_overlap", "x.n_same")


def contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document id and passage that overlap: item_words, n_overlap (longest run), n_same, similarity."""
    found = overlapping(docs, benchmark, block_words)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_overlap", "n_same", "item_words")).alias("x"))
    return best.select("doc_id", "item_id", "x.item_words", "x.n_overlap", "x.n_same", (F.col("x.n_same") / F.col("x.n_overlap")).alias("similarity"))


def op5_spaced_seed_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
