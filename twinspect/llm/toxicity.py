"""Toxicity by a factorization machine over hashed terms.

Terms are words (A-Z and other letters lower-cased, punctuation at the ends dropped) and the first 4 and 5 letters of
longer words, hashed to 31 bits; a document has a term or not. The machine scores

    bias + sum of w[t] + sum over pairs of <v[s], v[t]>

over the terms present, so a pair such as an insult beside the name of a group can weigh more than both alone. It is
trained here, by logistic loss with Adam, on a bounded sample of labelled documents: at most MAX_POSITIVE of label 1 and
MAX_NEGATIVE of label 0, the first in the order of a hash of the id, reweighted to the shares of all training labels.
Terms of MIN_DF sample documents or more take part in two cases. Those that differ between the labels by a chi-square of
MIN_CHI or more (the N_TERMS strongest), and both terms of a pair of which each matters by PAIR_CHI or more where the
other is present, though alone they may tell nothing; pairs are looked for among the terms of a share of PAIR_SHARE of the
sample or more, whose number is bounded by the lengths of its texts. Scoring reads whole texts and knows neither labels,
language, source nor id.

Defined cases: null and empty texts get the bias alone; without labels of both kinds every score is the share of label 1
among the training labels (0 without any); labels of one id that differ count as the highest; null labels and ids are
not learned from; repeated rows are scored each; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from twinspect.session import cut, load

MAX_POSITIVE = 2000
MAX_NEGATIVE = 3000
N_TERMS = 2048
MIN_CHI = 15.0
MIN_DF = 3
PAIR_SHARE, PAIR_CHI = 0.02, 25.0
RANK = 6
STEPS, BATCH = 1200, 256
CUTOFF = 0.7
EDGES = ".,;:!?\"'()[]{}|*#%&$<>-«»"


def terms_of(word: str) -> tuple[int, ...]:
    w = word.lower().strip(EDGES)
    if not w:
        return ()
    out = ["w" + w]
    for n in (4, 5):
        if len(w) > n:
            out.append(f"{n}{w[:n]}")
    return tuple(xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) & 0x7FFFFFFF for x in out)


class Memo(dict):
    def __init__(self, make, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        out = self[word] = self.make(word)
        return out


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3


def training_terms(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE, n_terms: int = N_TERMS):
    """([(label, terms that take part)], labels of 1, labels of 0): the bounded sample, and how many labels there are.

    Terms are counted and chosen where the documents are; the driver gets the chosen ones alone.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("toxic")).where(fold(F.col("id")) != 1)
    counts = {r[0]: r[1] for r in known.groupBy((F.col("toxic") > 0).cast("int")).count().collect()}
    picked = []
    for kind, most in ((1, max_positive), (0, max_negative)):
        picked.append(known.where((F.col("toxic") > 0).cast("int") == kind).orderBy(F.xxhash64("id"), "id").limit(most).select("id", F.lit(kind).alias("toxic")))
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most max_positive + max_negative rows

    def run(batches):
        memo = Memo(terms_of)
        for batch in batches:
            ids, y, texts = (c.to_pylist() for c in batch.columns)
            sets = [sorted({t for w in set((x or "").split()) for t in memo[w]}) for x in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(y, pa.int32()), pa.array(sets, pa.list_(pa.int32()))], names=["id", "toxic", "terms"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(sample, "id").select("id", "toxic", "text").mapInArrow(run, "id long, toxic int, terms array<int>")
    rows = cut(rows.groupBy("id", "toxic").agg(F.min("terms").alias("terms")))
    size = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    n, p = float(sum(size.values())), float(size.get(1, 0))
    if not 0 < p < n:
        return [(y, np.zeros(0, np.int64)) for y, k in size.items() for _ in range(k)], counts.get(1, 0), counts.get(0, 0)
    seen = rows.select("toxic", F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").cast("double").alias("df"), F.sum("toxic").cast("double").alias("a")).where(F.col("df") >= MIN_DF)
    chi = n * F.pow(F.col("a") * (n - p) - (F.col("df") - F.col("a")) * p, F.lit(2.0)) / F.greatest(F.col("df") * (n - F.col("df")) * (p * (n - p)), F.lit(1e-9))
    seen = cut(seen.withColumn("chi", chi))
    chosen = {r[0] for r in seen.where(F.col("chi") >= MIN_CHI).orderBy(F.desc("chi"), "t").limit(n_terms).collect()}
    common = sorted(r[0] for r in seen.where(F.col("df") >= PAIR_SHARE * n).collect())
    wanted = sorted(chosen | set(common))
    part = F.array_intersect("terms", F.lit(wanted).cast("array<int>") if wanted else F.array().cast("array<int>"))
    table = rows.select("id", "toxic", part.alias("terms")).toPandas().sort_values("id")
    y, sets = table["toxic"].to_numpy(np.float32), [np.asarray(t, np.int64) for t in table["terms"]]
    chosen |= paired_terms(y, sets, np.array(common, np.int64))
    keep = np.array(sorted(chosen), np.int64)
    return [(int(k), t[np.isin(t, keep)]) for k, t in zip(y, sets)], counts.get(1, 0), counts.get(0, 0)


def chi_square(n, p, df, k):
    """Of a mark in df of n rows, k of them among the p rows of label 1."""
    return n * (k * (n - p) - (df - k) * p) ** 2 / np.maximum(df * (n - df) * p * (n - p), 1e-9)


def paired_terms(y: np.ndarray, sets: list[np.ndarray], common: np.ndarray, block: int = 512) -> set[int]:
    """Terms of pairs of which each tells the labels apart where the other is present.

    Only two blocks of terms are dense at a time, since this runs on the driver; the rest is as long as the sets.
    """
    found: set[int] = set()
    places = [np.searchsorted(common, t[np.isin(t, common)]).astype(np.int32) for t in sets]
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(t) for t in places])
    place = np.concatenate([np.zeros(0, np.int32), *places])
    del places
    order = np.argsort(place // block, kind="stable")
    owner, place = owner[order], place[order]
    starts = range(0, len(common), block)
    ends = np.searchsorted(place // block, np.arange(len(starts) + 1))
    n = np.bincount(place, minlength=len(common)).astype(np.float64)
    p = np.bincount(place, weights=y[owner], minlength=len(common))

    def dense(lo):
        x, own = np.zeros((len(y), min(block, len(common) - lo)), np.float32), slice(ends[lo // block], ends[lo // block + 1])
        x[owner[own], place[own] - lo] = 1
        return x

    for lo in starts:
        a = dense(lo)
        ay = a * y[:, None]
        na, pa_ = n[lo : lo + block, None], p[lo : lo + block, None]
        for hi in starts[lo // block :]:  # a pair counts the same either way round
            b = dense(hi)
            nb, pb = n[None, hi : hi + block], p[None, hi : hi + block]
            both, toxic = (a.T @ b).astype(np.float64), (ay.T @ b).astype(np.float64)
            strong = np.minimum(chi_square(na, pa_, both, toxic), chi_square(nb, pb, both, toxic)) >= PAIR_CHI
            strong &= (both < na) & (both < nb)
            i, j = np.nonzero(strong)
            found |= set(common[lo + i].tolist()) | set(common[hi + j].tolist())
    return found


class Machine:
    """terms: sorted; w: their weights; v: their factors."""

    def __init__(self, bias: float, terms: np.ndarray, w: np.ndarray, v: np.ndarray):
        self.bias, self.terms, self.w, self.v = bias, terms, w, v
        self.place = {int(t): i for i, t in enumerate(terms)}

    def places(self, word: str) -> tuple[int, ...]:
        place = self.place
        return tuple(place[t] for t in terms_of(word) if t in place)

    def score(self, text: str | None, memo: Memo) -> float:
        at = {p for w in (text or "").split() for p in memo[w]}
        z = self.bias
        if at:
            at = np.fromiter(sorted(at), np.intp, len(at))
            v = self.v[at]
            z += float(self.w[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum()))
        return 1.0 / (1.0 + float(np.exp(-np.clip(z, -40.0, 40.0))))


def train(sample, n_pos: int, n_neg: int, rank: int = RANK, steps: int = STEPS, seed: int = 5) -> Machine:
    y = np.array([s[0] for s in sample], np.float32)
    none = np.zeros(0, np.int64)
    if not len(y) or y.min() == y.max():
        share = n_pos / max(1, n_pos + n_neg)
        return Machine(float(np.log(max(share, 1e-18) / max(1 - share, 1e-18))), none, np.zeros(0), np.zeros((0, rank)))
    weight = np.where(y > 0, n_pos / y.sum(), n_neg / (1 - y).sum())
    weight = (weight / weight.mean()).astype(np.float32)
    ids, inverse = np.unique(np.concatenate([s[1] for s in sample]), return_inverse=True)
    owner = np.repeat(np.arange(len(sample)), [len(s[1]) for s in sample])
    n = len(y)
    x = np.zeros((n, len(ids)), np.bool_)  # a byte a term; batches alone are floats
    x[owner, inverse] = True
    rng = np.random.default_rng(seed)
    start = np.log(max(float((weight * y).sum()), 1e-6) / max(float((weight * (1 - y)).sum()), 1e-6))
    par = [np.full(1, start, np.float32), np.zeros(len(ids), np.float32), (0.02 * rng.standard_normal((len(ids), rank))).astype(np.float32)]
    m1, m2, step = [np.zeros_like(q) for q in par], [np.zeros_like(q) for q in par], 0
    while step < steps:
        order = rng.permutation(n)
        for k in range(0, n, BATCH):
            rows = order[k : k + BATCH]
            xb = x[rows].astype(np.float32)
            s = np.einsum("ij,jk->ik", xb, par[2])  # one thread; a few hundred columns
            z = par[0][0] + np.einsum("ij,j->i", xb, par[1] - 0.5 * (par[2] ** 2).sum(1)) + 0.5 * (s**2).sum(1)
            g = weight[rows] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[rows]) / len(rows)
            xg = xb * g[:, None]
            grads = [np.array([g.sum()]), xg.sum(0) + 1e-5 * par[1], np.einsum("ij,ik->jk", xg, s) - xg.sum(0)[:, None] * par[2] + 1e-4 * par[2]]
            step += 1
            for q, gr, u, r in zip(par, grads, m1, m2):
                u += 0.1 * (gr - u)
                r += 0.001 * (gr**2 - r)
                q -= 0.02 * (u / (1 - 0.9**step)) / (np.sqrt(r / (1 - 0.999**step)) + 1e-8)
    return Machine(float(par[0][0]), ids, par[1].astype(float), par[2].astype(float))


def score_texts(docs: DataFrame, machine: Machine, cutoff: float = CUTOFF) -> DataFrame:
    """(row, score, predicted) for each row of docs, which is kept whole as row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # some thousand terms

    def run(batches):
        machine = shared.value
        memo = Memo(machine.places)
        for batch in batches:
            row = batch.column(0)
            scores = np.array([machine.score(t.as_py(), memo) for t in row.field("text")], float)
            yield pa.RecordBatch.from_arrays([row, pa.array(scores), pa.array((scores >= cutoff).astype(np.int32))], names=["row", "score", "predicted"])

    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return rows.mapInArrow(run, StructType([rows.schema[0], StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def toxicity(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None, rows: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; learn_from: the documents whose labels are learned, if others.

    With rows also the document's own columns, as row.
    """
    machine = train(*training_terms(docs if learn_from is None else learn_from, labels))
    scored = score_texts(docs if rows else docs.select("doc_id", "text"), machine)
    doc_id = F.col("row.doc_id").cast("long")
    return scored.select(doc_id.alias("doc_id"), F.coalesce(fold(doc_id) == 1, F.lit(False)).alias("held_out"), "score", "predicted", *(["row"] if rows else []))


def op2_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
