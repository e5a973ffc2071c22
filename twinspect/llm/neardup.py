"""Near duplicates by bottom-k sketches of one hash function over 5-word shingles.

A document's sketch is the K smallest hashes of its shingle set. Rows of equal sets are one class, numbered once and for
all, and only classes are compared. Inverted lists hold, for a retained value, the classes that keep it:

* Two sets with a Jaccard similarity of link (LINK in op7) or more share at least needed() retained values, but for a
  chance of EPS (a binomial tail; sets below K shingles are kept whole and the bound is exact). In the order (how many
  classes keep it, value) their first K - needed() + 1 values must therefore meet, so only these are listed: values that
  no other class keeps come first in it, and most documents list nothing.
* Round 1 compares each class of a list with the smallest one in it and with the most typical one (whose values most others
  keep, as the original of many copies): a linear number of pairs. The sketch of the union estimates their similarity and
  drops what cannot reach link; the others are confirmed on the full sets. A leader's set is sent once to each CHUNK of its
  partners. Components of these links follow.
* Round 2 looks at the classes of lists that still hold more than one component. They are listed anew by their full sets, in
  which the same bound is exact and close: a common passage lists nobody whose own text makes up more than what two
  linked sets may differ in. Classes that share such lists are gathered, dealt by size (linked sets differ in size by link
  at most, so only equal and neighbouring size classes meet) and then into blocks of BLOCK_ROWS; a task holds the sets
  of two blocks, finds all intersection sizes in one matrix product, and gives only links that join components. No
  cap, so no link between components is lost, and links inside one change nothing.

Joins by class, value or leader go through join_heavy, so keys of many rows are spread; rows that repeat an id and a text are
one row before the join that brings texts back. What stays quadratic is round 2 inside one gathering and size class: its blocks
meet in pairs, so a family of n texts that share most of their shingles with some other, but aren't linked, costs n * n / BLOCK_ROWS sets.

Defined cases: null and empty texts and texts without words have an empty set and are linked with nothing; rows without an
id are compared like others, and have the smallest id of their component, null if it has none; repeated rows give
repeated rows; an id on rows of different texts stands for each of them; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspect.llm.common import heavy_from, join_heavy, text_key
from twinspect.llm.shingles import shingle_set
from twinspect.operators.graph import components
from twinspect.session import cut, load

K = 32
LINK = 85  # in hundredths
EPS = 1e-9
CHUNK = 512
BLOCK_ROWS = 512
KEY = "key struct<no_id: boolean, doc_id: bigint, k1: bigint, k2: bigint>"


def needed(k: int = K, link: int = LINK, eps: float = EPS) -> int:
    """The most shared values that a pair at the link threshold reaches but for a chance of eps."""
    p, tail, t = link / 100, 0.0, 0
    while tail + (step := comb(k, t) * p**t * (1 - p) ** (k - t)) <= eps:
        tail, t = tail + step, t + 1
    return t


def keyed(docs: DataFrame) -> DataFrame:
    """(key, text): the key is the id, those of none last, and two hashes of the text. Rows of one key have one text."""
    parts = {"no_id": F.col("doc_id").isNull(), "doc_id": F.col("doc_id").cast("long"), **text_key(F.col("text"))}
    return docs.select(F.struct(*[v.alias(k) for k, v in parts.items()]).alias("key"), "text")


def sketches(rows: DataFrame, k: int = K) -> DataFrame:
    """key, n_shingles, digest of the whole set, the k smallest hashes. rows: key, text."""

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            n, digest, kept, offsets = [], [], [], [0]
            for text in texts:
                s = shingle_set(text.as_py())
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                kept.append(s[:k].view(np.int64))
                offsets.append(offsets[-1] + len(kept[-1]))
            values = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))],
                names=["key", "n_shingles", "digest", "sketch"],
            )

    return rows.select("key", "text").mapInArrow(run, f"{KEY}, n_shingles long, digest binary, sketch array<long>")


def full_sets(rows: DataFrame) -> DataFrame:
    """rep, n, sketch (the whole sorted set) of rows (rep, text)."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py()).view(np.int64) for t in batch.column(1)]
            n = np.array([len(x) for x in sets], np.int64)
            at = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.ListArray.from_arrays(pa.array(at), pa.array(values))], names=["rep", "n", "sketch"])

    return rows.select("rep", "text").mapInArrow(run, "rep long, n long, sketch array<long>")


def least_shared(n: Column, link: int) -> Column:
    """How many shingles a set of n shares with any it is linked with, at least."""
    return F.ceil(n * link / 100)


def listed(classes: DataFrame, k: int | None = K, link: int = LINK) -> DataFrame:
    """(value, rep, weight): the values by which a class must meet any other it is linked with. classes: rep, n, sketch.

    k: how many values of a set are there; None: all.
    """
    values = classes.select("rep", "n", F.explode("sketch").alias("value"))
    often = cut(values.groupBy("value").agg(F.count("*").alias("often")).where("often > 1"), thin=True)
    total = often.agg(F.coalesce(F.sum("often"), F.lit(0))).first()[0]
    shared = join_heavy(values, often, "value", F.col("often") >= heavy_from(total), ["rep"])
    shared = shared.groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("often", "value"))).alias("shared"), F.sum("often").alias("weight"))  # of one class
    size = F.least("n", F.lit(k)) if k else F.col("n")
    prefix = F.col("n") - least_shared(F.col("n"), link) + 1
    if k:
        prefix = F.when(F.col("n") < k, prefix).otherwise(F.lit(k - needed(k, link) + 1))
    first = F.greatest(F.lit(0), prefix - (size - F.size("shared"))).cast("int")
    return shared.select("rep", "weight", F.explode(F.slice("shared", F.lit(1), first)).alias("x")).select(F.col("x.value").alias("value"), "rep", "weight")


def may_link(sa: Column, sb: Column, na: Column, nb: Column, k: int = K, link: int = LINK) -> Column:
    """Whether two sketches leave a link possible, by the sketch of the union."""
    both = F.array_intersect(sa, sb)
    exact = 100 * F.size(both) >= link * (na + nb - F.size(both))
    union = F.slice(F.array_sort(F.array_union(sa, sb)), 1, k)
    return sizes_allow(na, nb, link) & F.when((na < k) & (nb < k), exact).otherwise(F.size(F.array_intersect(both, union)) >= needed(k, link))


def sizes_allow(na: Column, nb: Column, link: int = LINK) -> Column:
    return 100 * F.least(na, nb) >= link * F.greatest(na, nb)


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def confirmed(pairs: DataFrame, sets: DataFrame, link: int = LINK, chunk: int = CHUNK) -> DataFrame:
    """The pairs (a, b) whose full sets are linked. pairs: rep, lead, of_lead (pairs of the lead); sets: rep, n, sketch (the whole set)."""
    part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("of_lead") / chunk))
    own = pairs.withColumn("part", part).join(sets.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r")).select("lead", "part", F.lit(True).alias("member"), "rep", "sketch")
    leads = pairs.groupBy("lead").agg(F.max(F.ceil(F.col("of_lead") / chunk)).alias("parts")).join(sets.withColumnRenamed("rep", "r"), F.col("lead") == F.col("r"))
    leads = leads.select("lead", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"), F.col("lead").alias("rep"), "sketch")
    rows = leads.unionByName(own).repartition("lead", "part").sortWithinPartitions("lead", "part", "member")

    def run(batches):
        whose, lead = None, None
        for batch in batches:
            out = []
            ids, parts, members, reps = (np.asarray(batch.column(k).to_pandas()) for k in (0, 1, 2, 3))
            flat, at = np.asarray(batch.column(4).values), np.asarray(batch.column(4).offsets)
            for i in range(len(ids)):
                s = flat[at[i] : at[i + 1]].view(np.uint64)
                if not members[i]:
                    whose, lead = (ids[i], parts[i]), s.copy()
                elif (ids[i], parts[i]) == whose:
                    both = len(np.intersect1d(lead, s, assume_unique=True))
                    if both and 100 * both >= link * (len(lead) + len(s) - both):
                        out.append((int(ids[i]), int(reps[i])))
            yield _pairs(out)

    return rows.mapInArrow(run, "a long, b long")


def block_links(ids: list[int], parts: list[int], sets: list[np.ndarray], first: int, parent: dict[int, int], link: int = LINK) -> list[tuple[int, int]]:
    """Links between components among rows of one block (first = all) or of two (the first `first` rows against the others).

    parts: components so far; parent: their union-find, which grows. All intersection sizes come from a matrix product over
    the shingles that occur in two rows or more, in slices of bounded width.
    """

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    n = len(ids)
    if n < 2 or len(set(parts)) < 2:
        return []
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    number = np.cumsum(count > 1) - 1
    owner, column, width = owner[shared], number[column[shared]], int((count > 1).sum())
    same = first == n
    rows, cols = (n, n) if same else (first, n - first)
    both = np.zeros((rows, cols), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, width, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        m = np.zeros((n, min(4096, width - at)), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        both += m @ m.T if same else m[:first] @ m[first:].T
    a, b = (sizes, sizes) if same else (sizes[:first], sizes[first:])
    found = 100 * both.astype(np.int64) >= link * (a[:, None] + b[None, :] - both.astype(np.int64))
    links = []
    for i, j in np.argwhere(found & (both > 0)).tolist():
        j += 0 if same else first
        x, y = top(parts[i]), top(parts[j])
        if x != y:
            parent[x] = y
            links.append((ids[i], ids[j]))
    return links


def across(mixed: DataFrame, sets: DataFrame, block_rows: int = BLOCK_ROWS, link: int = LINK) -> DataFrame | None:
    """Links (a, b) between components, None if none can be. mixed: rep, component; sets: rep, n, sketch (the whole set)."""
    mine = cut(sets.join(mixed.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r")).select("rep", "n", "component", "sketch"))
    lists = cut(listed(mine, None, link).select("value", "rep"), thin=True)
    lists = lists.join(mine.select(F.col("rep").alias("r"), "component"), F.col("rep") == F.col("r")).select("value", "rep", "component")
    ends = lists.groupBy("value").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("rep").alias("low"), F.count("*").alias("many")).where("x != y")
    ends = cut(ends.select("value", "low", "many"), thin=True)
    total = ends.agg(F.sum("many")).first()[0]
    if not total:
        return None
    edges = join_heavy(lists, ends, "value", F.col("many") >= heavy_from(total), ["rep"]).select(F.col("low").alias("a"), F.col("rep").alias("b"))
    gathered = components(edges).select(F.col("id").alias("r"), F.col("component").alias("gathering"))
    rows = mine.join(gathered, F.col("rep") == F.col("r")).drop("r")
    rows = rows.withColumn("level", F.floor(F.log("n") / (log(100 / link) + 1e-9)))  # linked sets are at most one level apart
    rows = cut(rows.select("gathering", "level", "rep", "component", "sketch"))
    levels = rows.groupBy("gathering", "level").agg(F.ceil(F.count("*") / block_rows).alias("blocks"), F.count("*").alias("many"))
    near = lambda d: levels.select("gathering", (F.col("level") + d).alias("level"), F.col("blocks").alias("below" if d > 0 else "above"))
    levels = levels.join(near(1), ["gathering", "level"], "left").join(near(-1), ["gathering", "level"], "left")
    levels = cut(levels.select(F.struct("gathering", "level").alias("at"), "blocks", "many", F.coalesce("below", F.lit(0)).alias("below"), F.coalesce("above", F.lit(0)).alias("above")), thin=True)
    total = levels.agg(F.sum("many")).first()[0]
    rows = join_heavy(rows.withColumn("at", F.struct("gathering", "level")), levels, "at", F.col("many") >= heavy_from(total), ["rep"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)).otherwise(F.array().cast("array<bigint>"))
    task = lambda level, lo, hi, second: F.struct(level.alias("level"), lo.alias("lo"), hi.alias("hi"), second.alias("second"))
    me, level, flag = F.col("block"), F.col("level"), F.lit(0).cast("bigint")
    # level: of the first block, twice, and one more if the second block is of the next level.
    same = F.transform(upto("blocks"), lambda o: task(2 * level, F.least(me, o), F.greatest(me, o), me > o))
    above = F.transform(upto("above"), lambda o: task(2 * level + 1, me, o, F.lit(False)))
    below = F.transform(upto("below"), lambda o: task(2 * level - 1, o, me, F.lit(True)))
    rows = rows.select("gathering", "rep", "component", "sketch", F.explode(F.concat(same, above, below)).alias("task"))
    dealt = rows.select("gathering", *[F.col(f"task.{c}").alias(c) for c in ("level", "lo", "hi", "second")], "rep", "component", "sketch")
    dealt = dealt.repartition("gathering", "level", "lo", "hi").sortWithinPartitions("gathering", "level", "lo", "hi", "second", "rep")

    def run(batches):
        key, ids, parts, sets, first = None, [], [], [], 0
        for batch in batches:
            out = []
            cols = [batch.column(k).to_pylist() for k in range(7)]
            flat, at = np.asarray(batch.column(7).values), np.asarray(batch.column(7).offsets)
            for i, (g, level, lo, hi, second, rep, part) in enumerate(zip(*cols)):
                if (g, level, lo, hi) != key:
                    out += block_links(ids, parts, sets, first, {}, link)
                    key, ids, parts, sets, first = (g, level, lo, hi), [], [], [], 0
                ids.append(rep)
                parts.append(part)
                sets.append(flat[at[i] : at[i + 1]].view(np.uint64).copy())
                first += not second
            yield _pairs(out)
        yield _pairs(block_links(ids, parts, sets, first, {}, link))

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, link: int = LINK) -> DataFrame:
    """One row for each row of docs (doc_id, text): n_shingles, component_id, kept, k1, k2, chosen.

    link: least similarity, in hundredths. kept: doc_id is the component's smallest. chosen: the row's key (doc_id and the
    hashes of its text, k1 and k2) is its component's smallest, so of rows of different texts one is chosen in any case.
    """
    rows = keyed(docs)
    table = cut(sketches(rows))
    full = table.where("n_shingles > 0")
    classes = full.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()))

    lists = cut(listed(classes.select("rep", "n", "sketch"), link=link), thin=True)
    typical = F.max_by("rep", F.struct(F.col("weight"), -F.col("rep")))
    ends = cut(lists.groupBy("value").agg(F.count("*").alias("members"), F.min("rep").alias("low"), typical.alias("mid")).where("members > 1"), thin=True)
    total = ends.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    lists = cut(join_heavy(lists, ends, "value", F.col("members") >= heavy_from(total), ["rep"]).select("value", "rep", "low", "mid", "members"), thin=True)

    wanted = lists.select(F.col("rep").alias("r")).distinct()
    wanted = cut(classes.join(wanted, F.col("rep") == F.col("r")).select("rep", "n", "sketch", "first"))
    # Copies of a key are one row before they are shuffled, so a key of many rows is no hot one, and its set is made once.
    # The classes' keys are rows among them, so that texts are shuffled once.
    asked = wanted.select(F.col("first").alias("key"), F.lit(None).cast("string").alias("text"), "rep")
    one = rows.withColumn("rep", F.lit(None).cast("long")).unionByName(asked).groupBy("key").agg(F.first("text", ignorenulls=True).alias("text"), F.max("rep").alias("rep"))
    sets = cut(full_sets(one.where("rep IS NOT NULL").select("rep", "text")))

    leaders = F.explode(F.array_distinct(F.array("low", "mid"))).alias("lead")
    pairs = lists.select("rep", leaders).where("rep != lead").distinct()
    pairs = cut(pairs.join(wanted.select(F.col("rep").alias("r"), F.col("n").alias("na"), F.col("sketch").alias("sa")), F.col("rep") == F.col("r")).drop("r"))
    leads = pairs.groupBy("lead").agg(F.count("*").alias("of_lead")).join(wanted.select(F.col("rep").alias("r"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), F.col("lead") == F.col("r")).drop("r")
    passed = join_heavy(pairs, cut(leads, thin=True), "lead", F.col("of_lead") >= heavy_from(pairs.count()), ["rep"])
    passed = cut(passed.where(may_link(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb"), link=link)).select("rep", "lead", "of_lead"), thin=True)
    links = cut(confirmed(passed, sets, link), thin=True)
    found = components(links)

    mixed = lists.where("members > 2").select("value", "rep", "members").join(found.withColumnRenamed("id", "v"), F.col("rep") == F.col("v"), "left")
    mixed = mixed.select("value", "rep", "members", F.coalesce("component", "rep").alias("component"))
    split = cut(mixed.groupBy("value").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.first("members").alias("members")).where("x != y").select("value", "members", F.lit(1).alias("one")), thin=True)
    total = split.agg(F.sum("members")).first()[0]
    if total:
        mixed = join_heavy(mixed.drop("members"), split, "value", F.col("members") >= heavy_from(total), ["rep"]).select("rep", "component").distinct()
        more = across(mixed, sets, link=link)
        if more is not None and not (more := cut(more, thin=True)).isEmpty():
            found = components(links.unionByName(more))

    labelled = classes.select("rep", "digest", "first", "copies").join(found.withColumnRenamed("id", "v"), F.col("rep") == F.col("v"), "left").withColumn("component", F.coalesce("component", "rep"))
    low = labelled.groupBy("component").agg(F.min("first").alias("low"), F.count("*").alias("many"))
    labelled = join_heavy(labelled, cut(low, thin=True), "component", F.col("many") >= heavy_from(classes.count()), ["rep"])
    labelled = cut(labelled.select("digest", "copies", "low"), thin=True)
    numbered = table.select("key", "n_shingles", "digest", F.monotonically_increasing_id().alias("row_no"))  # copies may have one key
    own = join_heavy(numbered, labelled, "digest", F.col("copies") >= heavy_from(table.count()), ["row_no"], inner=False)
    low = F.coalesce("low", "key")
    kept = F.when(F.col("key.no_id"), F.col("key") == low).otherwise(F.col("key.doc_id") == low["doc_id"])
    return own.select(F.col("key.doc_id").alias("doc_id"), "n_shingles", low["doc_id"].alias("component_id"), kept.alias("kept"), "key.k1", "key.k2", (F.col("key") == low).alias("chosen"))


def op7_bottom_k_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents")).drop("k1", "k2", "chosen")
