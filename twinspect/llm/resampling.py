"""Importance resampling towards a target distribution, over hashed word n-grams found by suffix arrays.

A task numbers the words of a chunk of its documents and sorts the chunk's suffixes by their first n words (prefix doubling
on word ids). Neighbours in that order that share k words or more form a run, and a run is one repeated k-gram: it is
joined and hashed once, and its bucket id is scattered back to the positions where it starts. So a document leaves the task as
its number of words and the buckets of its features, which are written down once; counts and scores read only those.

Buckets are counted in the task and summed over tasks (n_buckets rows a task at most). A bucket's gain is the logarithm of
its smoothed shares in the target (benchmark) and in the documents; a document's weight is the sum of its features' gains,
and its score adds Gumbel noise drawn from its id, so that the highest scores are a sample without replacement. Ranks come
from range partitions of (score, id) and prefix sums of their row counts; nothing is collected but the n_buckets gains.

Defined cases: null, empty and wordless texts have no features and weight 0; they take part in nothing if fewer than min_words
are asked for is not met. A row without an id draws with the empty string in the id's place and comes last among equal
scores; repeated rows are scored and drawn separately, in any order among themselves; a feature whose words fill more than
one document of a chunk does not exist; an empty table gives an empty result, an empty benchmark a target without
features; other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinspect.llm.terms import Numbers, chunks
from twinspect.session import cut, load

MAX_N = 1
N_BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
CHUNK_DOCS, CHUNK_WORDS = 4096, 1 << 20


def suffix_order(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): positions sorted by their first `depth` ids, and how many of these each shares with the one before it.

    Ids are 0 or more, 0 being an end; beyond the array all ids are 0.
    """
    rank, h = ids.astype(np.int64), 1
    while h < depth:  # ranks by the first h ids become ranks by the first 2 h
        later = np.zeros_like(rank)
        later[: max(0, len(rank) - h)] = rank[h:]
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + later, return_inverse=True)[1].reshape(-1)
        h *= 2
    order = np.argsort(rank, kind="stable")
    lcp, same = np.zeros(len(ids), np.int64), np.ones(max(0, len(ids) - 1), bool)
    padded = np.concatenate((ids, np.zeros(depth, ids.dtype)))
    for k in range(depth):
        same &= padded[order[:-1] + k] == padded[order[1:] + k]
        lcp[1:] += same
    return order, lcp


def bucket_ids(texts: list[list[bytes]], max_n: int, n_buckets: int) -> list[np.ndarray]:
    """For each text the buckets of its features, the runs of 1 to max_n words: all runs of one word, then of two, and so on."""
    number = Numbers({b"": 0})
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))  # an end after each text
    ids = np.zeros(starts[-1], np.int64)
    for text, at in zip(texts, starts):
        ids[at : at + len(text)] = list(map(number.__getitem__, text))
    words = list(number)
    order, lcp = suffix_order(ids, max_n)
    room = np.repeat(starts[1:] - 1, sizes + 1) - np.arange(len(ids))  # words from a position to its text's end
    out = [[] for _ in texts]
    for k in range(1, max_n + 1):
        whole = room[order] >= k
        first = np.flatnonzero(lcp < k)  # where runs start; a run is whole or not
        first_whole = whole[first]
        length = np.diff(np.append(first, len(order)))
        lead = order[first[first_whole]]
        hashed = np.array([zlib.crc32(b" ".join(words[i] for i in ids[p : p + k])) % n_buckets for p in lead.tolist()], np.int64)
        at = np.full(len(ids), -1, np.int64)
        at[order[whole]] = np.repeat(hashed, length[first_whole])
        for held, start, size in zip(out, starts, sizes):
            if size >= k:
                held.append(at[start : start + size - k + 1])
    return [np.concatenate(held) if held else np.zeros(0, np.int64) for held in out]


def _width(n_buckets: int) -> np.dtype:
    return np.dtype("<u2" if n_buckets <= 1 << 16 else "<u4")


def features(rows: DataFrame, max_n: int = MAX_N, n_buckets: int = N_BUCKETS) -> DataFrame:
    """(id, n_words, n_features, buckets) of rows (id: long, text); buckets are packed integers of _width bytes."""
    width = _width(n_buckets)

    def run(batches):
        for ids, texts in chunks(batches, CHUNK_DOCS, CHUNK_WORDS):
            found = bucket_ids(texts, max_n, n_buckets)
            cols = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(f) for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([f.astype(width).tobytes() for f in found], pa.binary())], names=["id", "n_words", "n_features", "buckets"])

    return rows.select("id", F.col("text").cast("binary")).mapInArrow(run, "id long, n_words long, n_features long, buckets binary")


def bucket_counts(found: DataFrame, n_buckets: int = N_BUCKETS) -> DataFrame:
    """(bucket, n) over all features; a task passes on one row a bucket."""
    width = _width(n_buckets)

    def run(batches):
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                total += np.bincount(np.frombuffer(packed.as_py(), width), minlength=n_buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def count_vector(counts: DataFrame, n_buckets: int = N_BUCKETS) -> list[int]:
    """The counts (bucket, n) by bucket: n_buckets integers on the driver."""
    out = [0] * n_buckets
    for bucket, n in counts.collect():
        out[bucket] = n
    return out


def gains(of_documents: list[int], of_target: list[int]) -> np.ndarray:
    """The gain of every bucket: thousandths of the log of its smoothed share in the target over that in the documents."""
    m, all_documents, all_target = len(of_documents), sum(of_documents), sum(of_target)
    shares = [float(t + 1) * float(all_documents + m) / (float(s + 1) * float(all_target + m)) for s, t in zip(of_documents, of_target)]
    return np.array([math.floor(1000 * math.log(x)) for x in shares], np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """found with its weight, the sum of the gains of its buckets, in the place of the buckets."""
    width, shared = _width(len(gain)), found.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        table = shared.value
        for batch in batches:
            sums = [int(table[np.frombuffer(p.as_py(), width)].sum()) for p in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], names=["id", "n_words", "n_features", "weight"])

    return found.select("id", "n_words", "n_features", "buckets").mapInArrow(run, "id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, max_n: int = MAX_N, n_buckets: int = N_BUCKETS, seed: int = SEED) -> DataFrame:
    """One row for each row of docs (doc_id, text): n_features, weight, score, rank. Of the rows with min_words words or more the
    given percentage with the highest scores is drawn and ranked; target has texts."""
    found = cut(features(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), max_n, n_buckets))
    wanted = cut(features(target.select(F.lit(0).cast("long").alias("id"), "text"), max_n, n_buckets))
    gain = gains(*(count_vector(bucket_counts(x, n_buckets), n_buckets) for x in (found, wanted)))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    rows = weighed(found, gain).withColumn("score", F.col("weight") + F.floor(F.log(-F.log(u)) * -1000.0))
    rows = cut(rows.withColumns({"fit": F.col("n_words") >= min_words, "row_no": F.monotonically_increasing_id()}))
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row_no").asc()]
    # The range bounds come from a sample, so the layout is written down before it is looked at twice.
    laid = cut(rows.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()))
    totals = laid.groupBy("pid").agg(F.count("*").alias("many"), F.count_if("fit").alias("fits"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    drawn = F.expr(f"({percent} * sum(fits) OVER ()) div 100")
    starts = totals.select("pid", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("before"), drawn.alias("drawn"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("pid").orderBy(*order))
    placed = laid.join(F.broadcast(starts), "pid").withColumn("place", place)
    rank = F.when(F.col("place") <= F.col("drawn"), F.col("place"))
    return placed.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", rank.cast("long").alias("rank"))


def op13_suffix_array_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
dw AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) GROUP BY ALL),
vocab AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM dw UNION SELECT w FROM bw)),
bytes AS (SELECT w, list_transform(range(len(x) // 2), lambda i: concat('0x', substr(x, 2 * i + 1, 2))::BIGINT) AS b FROM vocab),
crc AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, tab),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM dw JOIN crc USING (w) GROUP BY 1), t AS (SELECT bucket, sum(n)::BIGINT AS t FROM bw JOIN crc USING (w) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + 10000))))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)),
wt AS (SELECT r, sum(n * gain)::BIGINT AS weight FROM dw JOIN crc USING (w) JOIN g USING (bucket) GROUP BY r),
sc AS (SELECT d.r, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((concat('0x', substr(sha256(concat('{SEED}:', doc_id)), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN wt ON wt.r = d.r),
rk AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= ({PERCENT} * (SELECT count(*) FROM rk)) // 100 THEN rank END AS rank FROM sc LEFT JOIN rk ON rk.r = sc.r
"""
