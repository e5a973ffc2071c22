"""Removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every byte covered by a string of LENGTH bytes that also starts elsewhere goes. Equal texts are one text with a number of
copies. A distributed suffix array of everything is not needed, since equal strings can be brought together exactly:

* Anchors. The smallest hash of the GRAM-byte strings inside a window of LENGTH bytes depends on the window alone. A text
  is dealt into runs of neighbouring windows of equal smallest hash; equal windows are in runs of equal hash. Only hashes
  with two runs or more (or a run with two places of the hash, as in periodic text) can hold a repeat.
* Blocks. The bytes of these runs are gathered by hash, groups are packed into blocks, and equal pieces of a group are
  one piece with a number of copies (a group of one piece and its copies is settled by that). A block's suffixes are ordered to a depth beyond LENGTH, and a breadth-first search
  extends intervals of the transform backwards, one byte a level: the interval boundaries that a level finds are the
  common prefixes of that length, in increasing order. It stops at LENGTH; boundaries not found by then lie inside
  classes of strings that share LENGTH bytes. Windows in such a class, or in a piece with copies, are repeats.
* Groups of more than HOT bytes (a passage in very many texts, or one long periodic text), which one task should not hold,
  are settled window by window through counts of 128-bit hashes of the windows, which are summed before they are shuffled.

Joins by text, anchor or window go through join_heavy, so that mass copies, empty texts and common passages are spread.

Defined cases: null and empty texts have 0 bytes; texts shorter than LENGTH keep all; repeated rows are copies of each
other, and so lose all bytes if they have LENGTH or more; a row without an id is reported with a null id; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspect.llm.common import heavy_from, join_heavy
from twinspect.llm.shingles import mixed
from twinspect.session import cut, load

LENGTH = 200
GRAM = 40
HOT = 6_000_000
BLOCK = 128 * 1024
TABLE_CELLS = 20_000_000

_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                p = np.full(2 * n, base, np.uint64)
                p[0] = 1
                _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS


def gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    n = len(x)
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        return mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    m = len(x)
    k = -(-m // w)
    padded = np.full(k * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:m] = x
    rows = padded.reshape(k, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: m - w + 1], ahead[w - 1 : m])


def runs_of(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, first window, last window, whether the hash has several places) of each run of windows."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
    h = gram_hashes(np.frombuffer(data, np.uint8), gram)
    low = sliding_min((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # the leftmost of equal ones
    first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
    v = h[place[first]]
    new = np.concatenate(([True], v[1:] != v[:-1]))
    starts = first[new]
    ends = np.concatenate((starts[1:], [len(place)])) - 1
    return v[new].view(np.int64), starts, ends, np.diff(np.concatenate((np.flatnonzero(new), [len(v)]))) > 1


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, exact to at least depth symbols. codes: uint8, 0 the smallest."""
    n = len(codes)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = codes
    key = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]).view(">u8").ravel().astype(np.uint64)
    h = 8
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        fresh = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
        if h >= depth or fresh.all():
            return order
        rank = np.empty(n + h, np.uint64)
        rank[order] = np.cumsum(fresh).astype(np.uint64)
        rank[n:] = 0
        key = (rank[:n] << np.uint64(32)) | rank[h:]
        h *= 2


def long_prefixes(codes: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place i of the order whether suffix i shares depth symbols or more with the one before (place n: no)."""
    n, sigma = len(codes), int(codes.max()) + 1
    bwt = codes[order - 1]
    first = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=sigma))))
    if n * sigma <= TABLE_CELLS:
        table = np.zeros((n + 1, sigma), np.int32)
        table[np.arange(1, n + 1), bwt] = 1
        np.cumsum(table, axis=0, out=table)
        table += first[:-1].astype(np.int32)
        rows = lambda at: table[at]
    else:
        where = [np.flatnonzero(bwt == c) for c in range(sigma)]
        rows = lambda at: np.stack([first[c] + np.searchsorted(where[c], at) for c in range(sigma)], 1)
    open_ = np.ones(n + 1, bool)
    open_[[0, n]] = False
    lo, hi = np.array([0]), np.array([n])
    for _ in range(depth):
        a, b = rows(lo), rows(hi)
        there = b > a
        a, b = a[there], b[there]
        new = open_[b]
        lo, hi = a[new], b[new]
        if not len(lo):
            break
        open_[hi] = False
    return open_


def repeated_windows(pieces: list[bytes], copies: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each of a block's distinct pieces which of its windows of `length` bytes start elsewhere too."""
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes + 1) - 1
    used = np.unique(raw)
    to = np.zeros(256, np.uint8)
    to[used] = np.arange(1, len(used) + 1)
    codes = np.zeros(len(raw) + len(pieces), np.uint8)  # each piece ends with a 0
    body = np.ones(len(codes), bool)
    body[ends] = False
    codes[body] = to[raw]
    order = suffix_order(codes, length + 1)
    joined = long_prefixes(codes, order, length)
    twice = np.zeros(len(codes), bool)
    twice[order] = joined[:-1] | joined[1:]
    out = []
    for k, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist())):
        n = size - length + 1
        out.append(np.ones(n, bool) if copies[k] > 1 else twice[end - size : end - size + n])
    return out


def ranges(starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal ranges covered by windows that start at `starts` (sorted)."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    lo = starts[np.concatenate(([0], gap + 1))]
    hi = starts[np.concatenate((gap, [len(starts) - 1]))] + length
    return list(zip(lo.tolist(), hi.tolist()))


KEYS = "k1 long, k2 long"


def _batch(rows: list[tuple], schema: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.values())], names=list(schema))


def repeated_ranges(texts: DataFrame, length: int, gram: int, hot: int, block: int) -> DataFrame:
    """(k1, k2, lo, hi): covered ranges of texts (k1, k2, text), those of one run each; they may touch or overlap."""

    def find_runs(batches):
        for b in batches:
            k1, k2, cols = np.asarray(b.column(0)), np.asarray(b.column(1)), []
            for i, text in enumerate(b.column(2)):
                v, lo, hi, many = runs_of(text.as_py().encode("utf-8", "surrogatepass"), length, gram)
                cols.append((v, np.full(len(v), k1[i]), np.full(len(v), k2[i]), lo, hi, many))
            if cols:
                v, a, c, lo, hi, many = (np.concatenate(x) for x in zip(*cols))
                for s in range(0, len(v), 50_000):
                    e = slice(s, s + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (v[e], a[e], c[e], lo[e].astype(np.int32), hi[e].astype(np.int32), many[e])], names=["v", "k1", "k2", "lo", "hi", "many"])

    # All three readers of texts take the same columns, so that they share one exchange.
    runs = texts.select("k1", "k2", "text", "copies").mapInArrow(find_runs, f"v long, {KEYS}, lo int, hi int, many boolean")
    seen = runs.groupBy("v").agg(F.count("*").alias("n"), F.max("many").alias("any"), F.sum(F.col("hi") - F.col("lo") + length).alias("size")).where("n > 1 OR any").select("v", (F.col("size") > hot).alias("hot"), "n")
    seen = cut(seen, thin=True)
    total, any_hot = seen.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.bool_or("hot"), F.lit(False))).first()
    found = join_heavy(runs.drop("many"), seen, "v", F.col("n") >= heavy_from(total), ["k1", "lo"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("v", "lo", "hi", "hot")).alias("runs"))  # of one text
    cuts = {"v": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "lo": pa.int32(), "piece": pa.binary(), "h1": pa.int64(), "h2": pa.int64()}

    def cut_pieces(batches):
        for b in batches:
            rows, size = [], 0
            for k1, k2, text, _, found in zip(*(c.to_pylist() for c in b.columns)):
                data = text.encode("utf-8", "surrogatepass")
                for r in found:
                    if r["hot"]:
                        for at in range(r["lo"], r["hi"] + 1):
                            d = hashlib.blake2b(data[at : at + length], digest_size=16).digest()
                            rows.append((None, k1, k2, at, None, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
                            if len(rows) > 50_000:
                                yield _batch(rows, cuts)
                                rows, size = [], 0
                    else:
                        rows.append((r["v"], k1, k2, r["lo"], data[r["lo"] : r["hi"] + length], None, None))
                        size += r["hi"] + length - r["lo"]
                    if size > 8_000_000 or len(rows) > 50_000:
                        yield _batch(rows, cuts)
                        rows, size = [], 0
            yield _batch(rows, cuts)

    pieces = texts.join(found, ["k1", "k2"]).select("k1", "k2", "text", "copies", "runs").mapInArrow(cut_pieces, f"v long, {KEYS}, lo int, piece binary, h1 long, h2 long")
    spans = {"k1": pa.int64(), "k2": pa.int64(), "lo": pa.int64(), "hi": pa.int64()}

    def settle(distinct: list[bytes], users: list[list[tuple]]) -> list[tuple]:
        out = []
        for flags, rows in zip(repeated_windows(distinct, [len(u) for u in users], length), users):
            for lo, hi in ranges(np.flatnonzero(flags), length):
                out += [(r[1], r[2], r[3] + lo, r[3] + hi) for r in rows]
        return out

    def expand(batches):
        distinct, users, size, out = [], [], 0, []
        group, last = {}, None

        def close() -> None:
            nonlocal size
            if len(group) == 1 and len(rows := next(iter(group.values()))) > 1:  # only copies of one piece: all its windows repeat
                out.extend((r[1], r[2], r[3], r[3] + len(r[4])) for r in rows)
            else:
                for piece, rows in group.items():
                    distinct.append(piece)
                    users.append(rows)
                    size += len(piece)
            group.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != last:
                    close()
                    last = row[0]
                    if size > block:
                        out += settle(distinct, users)
                        distinct, users, size = [], [], 0
                    if len(out) > 20_000:
                        yield _batch(out, spans)
                        out.clear()
                group.setdefault(row[4], []).append(row)
        close()
        if distinct:
            out += settle(distinct, users)
        yield _batch(out, spans)

    gathered = pieces.where("v IS NOT NULL").select("v", "k1", "k2", "lo", "piece").repartition("v").sortWithinPartitions("v")
    by_block = gathered.mapInArrow(expand, f"{KEYS}, lo long, hi long")
    if not any_hot:
        return by_block
    single = cut(pieces.where("h1 IS NOT NULL").select(F.struct("h1", "h2").alias("h"), "k1", "k2", "lo"))
    often = cut(single.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), thin=True)
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    by_window = join_heavy(single, often, "h", F.col("n") >= heavy_from(total), ["k1", "lo"]).select("k1", "k2", F.col("lo").cast("long").alias("lo"), (F.col("lo") + length).cast("long").alias("hi"))
    return by_block.unionByName(by_window)


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(found):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256, spans (array of lo, hi)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(length), text).alias("k2"), text.alias("text"))
    texts = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    spans = repeated_ranges(texts, length, gram, hot, block).groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))  # of one text
    kept = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    schema = {"k1": pa.int64(), "k2": pa.int64(), "copies": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "spans": kept}

    def apply(batches):
        for b in batches:
            rows = []
            for k1, k2, text, copies, found in zip(*(c.to_pylist() for c in b.columns)):
                data = text.encode("utf-8", "surrogatepass")
                cut = [(0, len(data))] if copies > 1 and len(data) >= length else merged([(x["lo"], x["hi"]) for x in found or []])
                sha, at = hashlib.sha256(), 0
                for lo, hi in cut:
                    sha.update(data[at:lo])
                    at = hi
                sha.update(data[at:])
                rows.append((k1, k2, copies, len(data), sum(hi - lo for lo, hi in cut), len(cut), sha.hexdigest(), [{"lo": lo, "hi": hi} for lo, hi in cut]))
            yield _batch(rows, schema)

    done = texts.join(spans, ["k1", "k2"], "left").select("k1", "k2", "text", "copies", "found")
    done = done.mapInArrow(apply, f"{KEYS}, copies long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo: long, hi: long>>")
    done = cut(done.withColumn("key", F.struct("k1", "k2")).drop("k1", "k2"), thin=True)
    total = done.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    rows = cut(keyed.select("doc_id", F.struct("k1", "k2").alias("key")), thin=True).withColumn("row_no", F.monotonically_increasing_id())
    return join_heavy(rows, done, "key", F.col("copies") >= heavy_from(total), ["row_no"]).drop("key", "copies", "row_no")


def op3_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents")).drop("spans")
