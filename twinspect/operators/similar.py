"""Pairs of similar vectors: an exact join, a join by signatures of random projections with exact rerank, and votes of bands.

Rows have unit_id, vec, and optionally path, start_line, end_line: with these, pairs of one file of which one span encloses
the other are not pairs. Scores are inner products in double; vectors of different lengths are no pair, null vectors are left out.

All of them deal rows into blocks by a hash of the id, exact pairs of a large table into blocks of like rows. A block is one row of bytes;
a pair of blocks is multiplied or compared as matrices, a slice at a time. A task holds two blocks and one slice, whatever the number of
rows, and only what is asked for leaves it. All pairs of one table are a cartesian product of the paths of its blocks, which are files
in the checkpoint folder, so rows are shuffled once, however many blocks there are. Work is quadratic in rows; by signatures it is an exclusive or and a bit count a pair, and inner products only
where pairs are left.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, cached_property
from math import acos, comb, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinspect.functions.vectors import dot
from twinspect.operators.graph import first_reached
from twinspect.session import checkpoint_dir, cut, read_batch, write_batch

BLOCK_ROWS = 2048
TOGETHER = 4  # blocks that a task of a large table meets one with
LARGER, FEW_BLOCKS = 8, 24  # all pairs of a table: so many blocks of BLOCK_ROWS, then blocks of up to LARGER times that
SLICE = 512
TILE_ROWS, TILE_COLUMNS = 128, 1024  # what a product of this size needs stays in a core's cache
PLANES, BANDS, ROWS, DRAWS = 128, 16, 8, 32
CAP = 1024
MOST_DIM = 1024  # longer vectors are dealt by id and multiplied whole: their directions would take too long
MOST_LEAVES = 1024  # of a tree that deals rows into blocks
MOST_PAIRS = 1_000_000  # what a task lists before it reduces pairs to links
BATCH_PAIRS = 65_536  # pairs that leave a task together
LEVELS = ((16, 16), (64, 64))  # of a sieve: leading directions, and groups of numbers of what they leave
LEAST_PAIRS, SAMPLE = 1 << 18, 2048  # products of fewer rows aren't sieved; rows that directions are taken from
MISS = 0.02  # of the pairs at the threshold, by the binomial law of signatures


# ---- blocks


def splitmix64(seed: int, n: int) -> np.ndarray:
    """The first n outputs of the published generator (Steele, Lea and Flood, 2014)."""
    with np.errstate(over="ignore"):
        return _mix(np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _block_of(ids: np.ndarray, n_blocks: int | np.ndarray) -> np.ndarray:
    return (_mix(ids.view(np.uint64)) % np.asarray(n_blocks, np.uint64)).astype(np.int64)


def _n_blocks(rows: int, block_rows: int) -> int:
    return max(1, -(-rows // block_rows))


def _n_larger(rows: int, block_rows: int) -> int:
    return max(_n_blocks(rows, LARGER * block_rows), min(FEW_BLOCKS, _n_blocks(rows, block_rows)))


PIECE = [
    ("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("vecs", pa.binary()), ("paths", pa.list_(pa.string())),
    ("starts", pa.binary()), ("ends", pa.binary()),
]
_PIECE = "block long, dim int, ids binary, vecs binary, paths array<string>, starts binary, ends binary"


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(schema)], names=[n for n, _ in schema])


def _spans(units: DataFrame) -> DataFrame:
    have = set(units.columns)
    cols = [F.col("unit_id").cast("long").alias("unit_id"), F.col("vec").cast("array<double>").alias("vec")]
    cols.append(F.col("path").cast("string").alias("path") if "path" in have else F.lit(None).cast("string").alias("path"))
    cols += [F.col(c).cast("long").alias(c) if c in have else F.lit(0).cast("long").alias(c) for c in ("start_line", "end_line")]
    return units.select(*cols).where("unit_id IS NOT NULL AND vec IS NOT NULL").na.fill(0, ["start_line", "end_line"])


def _pieces(units: DataFrame, n_blocks: int, tree: Tree | None = None) -> DataFrame:
    """Rows of PIECE: what a task has of one block, in one row for each length of vectors."""
    plain = not ({"path", "start_line", "end_line"} & set(units.columns))

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            flat, at = np.asarray(batch.column(1).values), np.asarray(batch.column(1).offsets).astype(np.int64)
            paths, lines = batch.column(2), [batch.column(k).to_numpy() for k in (3, 4)]
            blocks, dims = _block_of(ids, n_blocks), np.diff(at)
            if tree is not None:
                mine = np.flatnonzero(dims == len(tree.directions))
                blocks[mine] = tree.blocks(ids[mine], flat[(at[mine][:, None] + np.arange(len(tree.directions))).ravel()].reshape(len(mine), len(tree.directions)))
            order = np.lexsort((blocks, dims))
            new = np.flatnonzero(np.concatenate(([True], (np.diff(blocks[order]) != 0) | (np.diff(dims[order]) != 0)))) if len(order) else []
            out = []
            for rows in np.split(order, new[1:]) if len(order) else []:
                d = int(dims[rows[0]])
                vecs = flat[(at[rows][:, None] + np.arange(d)).ravel()]
                own = None if plain else paths.take(pa.array(rows)).to_pylist()
                out.append((int(blocks[rows[0]]), d, ids[rows].tobytes(), vecs.tobytes(), own, *(x[rows].tobytes() for x in lines)))
            yield _batch(out, PIECE)

    return _spans(units).mapInArrow(run, _PIECE)


def _upto(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))


@dataclass
class Side:
    """One block of a pair: rows of one length of vectors."""

    ids: np.ndarray
    vecs: np.ndarray
    paths: np.ndarray | None
    starts: np.ndarray
    ends: np.ndarray
    shadows: list[np.ndarray] | None = None  # by level, where blocks were written with them

    @classmethod
    def of(cls, pieces: list[tuple], dim: int) -> Side:
        """pieces: rows of PIECE without the block; behind one from a file there may be its shadows."""
        mine = [p for p in pieces if p[0] == dim]
        whole = lambda k, kind: np.concatenate([np.frombuffer(p[k], kind) for p in mine]) if len(mine) > 1 else np.frombuffer(mine[0][k], kind)
        ids, starts, ends = (whole(k, np.int64) for k in (1, 4, 5))
        vecs = whole(2, np.float64).reshape(len(ids), dim)
        paths = None if any(p[3] is None for p in mine) else np.array([x for p in mine for x in p[3]], object)
        shadows = [np.frombuffer(s, np.float32).reshape(len(ids), -1) for s in mine[0][6:]] if len(mine) == 1 and len(ids) else []
        return cls(ids, vecs, paths, starts, ends, shadows or None)

    def rows(self, which) -> Side:
        return Side(self.ids[which], self.vecs[which], None if self.paths is None else self.paths[which], self.starts[which], self.ends[which])

    @cached_property
    def single(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return self.vecs.astype(np.float32)

    @cached_property
    def longest(self) -> float:
        return float(np.sqrt(np.einsum("ij,ij->i", self.vecs, self.vecs).max(initial=0.0)))

    @cached_property
    def bands(self) -> np.ndarray:
        return band_values(self.vecs)

    @cached_property
    def signs(self) -> np.ndarray:
        return np.ascontiguousarray(self.bands).view(np.uint64)


def enclosed(a: Side, b: Side, p, q) -> np.ndarray:
    """Whether rows p of a and q of b (broadcast against each other) are of one file, and one span encloses the other."""
    s1, e1, s2, e2 = a.starts[p], a.ends[p], b.starts[q], b.ends[q]
    u, v = a.paths[p], b.paths[q]
    return np.not_equal(u, None).astype(bool) & (u == v).astype(bool) & (((s1 <= s2) & (e1 >= e2)) | ((s2 <= s1) & (e2 >= e1)))


def _where(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns; np.nonzero of a matrix is several times slower where few are true."""
    return np.divmod(np.flatnonzero(near), near.shape[1])


def _room(a: Side, b: Side, threshold: float) -> float:
    """What rounding to single precision can amount to in a product; not below 1e30 where numbers may be too large for it, or are none."""
    return (a.vecs.shape[1] + 4) * 2.0**-23 * a.longest * b.longest + abs(threshold) * 2.0**-22 + 1e-30


def reaching(a: Side, b: Side, threshold: float, among: np.ndarray | None = None, scores: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(rows of a, rows of b, inner products) that are at least the threshold, among the pairs of a boolean matrix if given.

    A product in single precision, less what its rounding can amount to, leaves few pairs, which are multiplied in double; if scores
    aren't asked for, only those that are closer to the threshold than rounding.
    """
    many = len(a.ids) * len(b.ids) // 16
    if among is None or np.count_nonzero(among) > many // 4:
        room = _room(a, b, threshold)
        if room < 1e30:
            rough = a.single @ b.single.T
            near = rough >= np.float32(threshold - room)
            near = near if among is None else near & among
            if not scores:
                p, q = _where(near)
                doubt = np.flatnonzero(rough[p, q] < np.float32(threshold + room))
                s = [np.einsum("ij,ij->i", a.vecs[p[k]], b.vecs[q[k]]) for k in (doubt[at : at + SLICE] for at in range(0, len(doubt), SLICE))]
                keep = np.ones(len(p), bool)
                keep[doubt] = np.concatenate(s or [np.zeros(0)]) >= threshold
                return p[keep], q[keep], None
        if not room < 1e30 or np.count_nonzero(near) > many:
            s = a.vecs @ b.vecs.T
            near = s >= threshold if among is None else (s >= threshold) & among
            p, q = _where(near)
            return p, q, s[p, q]
    else:
        near = among
    p, q = _where(near)
    s = np.concatenate([np.einsum("ij,ij->i", a.vecs[p[k : k + SLICE]], b.vecs[q[k : k + SLICE]]) for k in range(0, len(p), SLICE)] or [np.zeros(0)])
    keep = s >= threshold
    return p[keep], q[keep], s[keep]


def _leading(*parts: np.ndarray) -> np.ndarray:
    """Orthonormal directions of some rows of matrices, as columns, that in which rows are longest first."""
    some = np.concatenate([m[:: -(-len(m) // SAMPLE)] for m in parts])
    return np.linalg.eigh(some.T @ some)[1][:, ::-1]


def _shadow(vecs: np.ndarray, directions: np.ndarray, k: int, groups: int) -> np.ndarray:
    """Of each row its parts along k directions, then the lengths of the rest's numbers by group. The product of two shadows is at least
    that of the rows (Cauchy-Schwarz in each group), and their distance at most that of the rows."""
    out, lead = np.empty((len(vecs), k + groups), np.float32), directions[:, :k]
    starts = np.linspace(0, vecs.shape[1], groups, endpoint=False).astype(int)
    for at in range(0, len(vecs), SLICE):
        rows = vecs[at : at + SLICE]
        own = rows @ lead
        rest = rows - own @ lead.T
        out[at : at + SLICE] = np.hstack((own, np.sqrt(np.add.reduceat(rest * rest, starts, axis=1))))
    return out


def _by_likeness(vecs: np.ndarray) -> np.ndarray:
    """An order of rows in which each TILE_ROWS are alike: halves by the leading direction that spreads them most, again and again."""
    if len(vecs) <= TILE_ROWS or not 0 < vecs.shape[1] <= MOST_DIM or not np.abs(vecs).max() < 1e15:
        return np.arange(len(vecs))
    own = vecs @ _leading(vecs)[:, : LEVELS[0][0]]
    parts = [np.arange(len(vecs))]
    while len(parts[0]) > TILE_ROWS:
        ordered = [r[np.argsort(own[r, own[r].var(0).argmax()], kind="stable")] for r in parts]
        parts = [half for r in ordered for half in np.array_split(r, 2)]
    return np.concatenate(parts)


@dataclass
class Tree:
    """Deals rows into blocks of like rows: halves of a sample by leading directions, of which each leaf has its own blocks, or shares one."""

    directions: np.ndarray  # those of the shadows, too
    axis: np.ndarray  # of the inner nodes, by level
    cuts: np.ndarray
    first: np.ndarray  # block of each leaf
    many: np.ndarray  # blocks of each leaf, dealt by id: copies of one vector may be many

    @classmethod
    def of(cls, some: np.ndarray, leaves: int) -> Tree:
        directions = _leading(some)
        own, parts, axis, cuts = some @ directions[:, : LEVELS[0][0]], [np.arange(len(some))], [], []
        while len(parts) < leaves:
            halves = []
            for r in parts:
                k = int(own[r].var(0).argmax()) if len(r) else 0
                middle = float(np.median(own[r, k])) if len(r) else 0.0
                axis.append(k)
                cuts.append(middle)
                halves += [r[own[r, k] <= middle], r[own[r, k] > middle]]
            parts = halves
        return cls(directions, np.array(axis), np.array(cuts), np.zeros(len(parts), np.int64), np.ones(len(parts), np.int64))

    def leaf(self, vecs: np.ndarray) -> np.ndarray:
        own, node = vecs @ self.directions[:, : LEVELS[0][0]], np.zeros(len(vecs), np.int64)
        for _ in range(len(self.first).bit_length() - 1):
            node = 2 * node + 1 + (own[np.arange(len(own)), self.axis[node]] > self.cuts[node])
        return node - len(self.axis)

    def deal(self, sizes: np.ndarray, rows: int) -> int:
        """Sets the blocks of leaves of these sizes, of about `rows` rows each; returns how many there are."""
        block, size = 0, 0
        for k, n in enumerate(sizes.tolist()):
            if size and size + n > rows:
                block, size = block + 1, 0
            self.first[k], self.many[k] = block, max(1, -(-n // rows))
            size += n
            if self.many[k] > 1:
                block, size = block + int(self.many[k]), 0
        return block + 1

    def blocks(self, ids: np.ndarray, vecs: np.ndarray) -> np.ndarray:
        leaf = self.leaf(vecs)
        return self.first[leaf] + _block_of(ids, self.many[leaf])


def _tree(units: DataFrame, n: int, n_blocks: int) -> tuple[Tree | None, int]:
    """A tree for (checkpointed) rows of the most frequent length, from a sample of bounded size, and the number of its blocks."""
    rows = _spans(units).select("unit_id", "vec")
    sample = rows.sample(min(1.0, 2 * SAMPLE / n), 1).limit(4 * SAMPLE).toArrow() if n else None
    sizes = {dim: len(which) for dim, which, _ in _vectors(sample.combine_chunks().to_batches()[0])} if sample and sample.num_rows else {}
    dim = max(sizes, key=lambda d: (sizes[d], d), default=0)
    if not 2 * sum(LEVELS[0]) <= dim <= MOST_DIM:
        return None, n_blocks
    some = next(m for d, _, m in _vectors(sample.combine_chunks().to_batches()[0]) if d == dim)
    if not np.abs(some).max() < 1e15:
        return None, n_blocks
    tree = Tree.of(some, min(MOST_LEAVES, 1 << (4 * n_blocks - 1).bit_length()))

    def run(batches):
        counts = np.zeros(len(tree.first), np.int64)
        for batch in batches:
            for d, _, m in _vectors(batch):
                if d == dim:
                    counts += np.bincount(tree.leaf(m), minlength=len(counts))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], names=["leaf", "n"])

    counted = rows.mapInArrow(run, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()  # at most MOST_LEAVES
    sizes = np.zeros(len(tree.first), np.int64)
    for r in counted:
        sizes[r["leaf"]] = r["n"]
    return tree, max(n_blocks, tree.deal(sizes, -(-n // n_blocks)))


class Sieve:
    """Which rows of b can reach the threshold with one of some rows of a: by boxes around TILE_ROWS rows, then by products of shadows, the
    short ones first. No pair is lost, so what is kept is only a matter of time; a level that leaves most of its rows is given up."""

    def __init__(self, a: Side, b: Side, threshold: float):
        room, self.levels, self.first = _room(a, b, threshold), [], None
        sizes = [(k, m) for k, m in LEVELS if 2 * (k + m) <= a.vecs.shape[1] <= MOST_DIM]
        if not room < 1e15 or len(a.ids) * len(b.ids) < LEAST_PAIRS or not sizes:
            return
        self.least = np.float32(threshold - room)
        if a.shadows and b.shadows:
            self.levels = [((lambda pair=pair: pair), [0, 0]) for pair in zip(a.shadows, b.shadows)]
        else:
            directions = _leading(a.vecs, b.vecs)
            shadows = lambda k, m: cache(lambda: tuple(_shadow(s.vecs, directions, k, m) for s in (a, b)))
            self.levels = [(shadows(k, m), [0, 0]) for k, m in sizes]
        # Rows whose product reaches the threshold are no farther apart.
        self.far = max(0.0, a.longest**2 + b.longest**2 - 2 * threshold) + 1e-4 * (a.longest + b.longest) ** 2
        (self.first, shadow), starts = self.levels[0][0](), np.arange(0, len(b.ids), TILE_ROWS)
        shadow = shadow.astype(float)
        self.low, self.high = np.minimum.reduceat(shadow, starts), np.maximum.reduceat(shadow, starts)

    def columns(self, rows: slice, columns: np.ndarray) -> np.ndarray:
        if self.first is not None:
            own = self.first[rows]
            gap = np.maximum(0, np.maximum(self.low - own.max(0), own.min(0) - self.high))
            columns = columns[((gap * gap).sum(1) <= self.far)[columns // TILE_ROWS]]
        for shadows, seen in list(self.levels):
            if not len(columns):
                break
            x, y = shadows()
            before, own = len(columns), x[rows]
            some = [columns[at : at + TILE_COLUMNS] for at in range(0, before, TILE_COLUMNS)]
            columns = np.concatenate([c[(own @ y[c].T >= self.least).any(0)] for c in some])
            seen[0], seen[1] = seen[0] + before, seen[1] + len(columns)
            if seen[0] > 16 * TILE_COLUMNS and seen[1] > 0.7 * seen[0]:
                self.levels = [level for level in self.levels if level[1] is not seen]
        return columns


FIRST, SECOND, PAIRS = 1, 2, 4  # roles of a piece in a pair of blocks


def _by_block_pair(dealt: DataFrame, settle: Callable, schema: str) -> DataFrame:
    """dealt: x, y, role and PIECE without its block. settle(firsts, seconds, pairs) gives batches for each (x, y)."""
    cols = ["x", "y", "role", *[n for n, _ in PIECE[1:]]]
    rows = dealt.select(*cols).repartition("x", "y").sortWithinPartitions("x", "y")

    def run(batches):
        key, held = None, {}
        for batch in batches:
            # Bytes stay in the batch's buffers until a pair of blocks is settled.
            xs, ys, roles, dims = (batch.column(k).to_pylist() for k in range(4))
            for i, (x, y, role, dim) in enumerate(zip(xs, ys, roles, dims)):
                if (x, y) != key:
                    if held:
                        yield from settle(*(held.get(r, []) for r in (FIRST, SECOND, PAIRS)))
                    key, held = (x, y), {}
                piece = (dim, *(batch.column(k)[i].as_py() for k in range(4, 9)))
                for r in (FIRST, SECOND, PAIRS):
                    if role & r:
                        held.setdefault(r, []).append(piece)
        if held:
            yield from settle(*(held.get(r, []) for r in (FIRST, SECOND, PAIRS)))

    return rows.mapInArrow(run, schema)


def _dims(first: list[tuple], second: list[tuple]) -> list[int]:
    return sorted({p[0] for p in first} & {p[0] for p in second})


def _blocks(units: DataFrame, n_blocks: int, tree: Tree | None = None) -> DataFrame:
    """(block, dim, path): a file in the checkpoint folder for each block and length of vectors, of one row of PIECE, like rows together."""
    folder = f"{checkpoint_dir(units.sparkSession).rstrip('/')}/blocks-{uuid.uuid4().hex}"

    def run(batches):
        held = {}
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7))):
                held.setdefault(row[:2], []).append(row[2:])
        for block, dim in sorted(held):
            ids, vecs, paths, starts, ends = zip(*held.pop((block, dim)))
            own = None if any(p is None for p in paths) else [x for p in paths for x in p]
            numbers = [np.frombuffer(b"".join(x), np.int64) for x in (ids, starts, ends)]
            matrix = np.frombuffer(b"".join(vecs), np.float64).reshape(len(numbers[0]), dim)
            del vecs
            order = _by_likeness(matrix)
            ids, starts, ends = (x[order].tobytes() for x in numbers)
            path = f"{folder}/{block}-{dim}.arrow"
            matrix = matrix[order]
            levels = [(k, m) for k, m in LEVELS if 2 * (k + m) <= dim] if tree is not None and dim == len(tree.directions) else []
            shadows = [_shadow(matrix, tree.directions, k, m).tobytes() for k, m in levels]
            schema = [*PIECE, *[(f"shadow{k}", pa.binary()) for k in range(len(shadows))]]
            write_batch(path, _batch([(block, dim, ids, matrix.tobytes(), own and [own[k] for k in order], starts, ends, *shadows)], schema))
            yield _batch([(block, dim, path)], [("block", pa.int64()), ("dim", pa.int32()), ("path", pa.string())])

    return cut(_pieces(units, n_blocks, tree).repartitionById(n_blocks, F.col("block").cast("int")).mapInArrow(run, "block long, dim int, path string"))


def _every_pair(units: DataFrame, block_rows: int, n: int | None, settle: Callable, schema: str, alike: bool = False) -> DataFrame:
    """settle(first, second, None) for all pairs of blocks, each once, as _by_block_pair; tasks read blocks where they lie, so no row of
    Spark is larger than a path. With alike, the blocks of a large table are of like rows."""
    n, tree = units.count() if n is None else n, None
    n_blocks = _n_larger(n, block_rows)
    if alike and n_blocks >= FEW_BLOCKS:
        units = cut(units.select(*[c for c in ("unit_id", "vec", "path", "start_line", "end_line") if c in units.columns]))
        tree, n_blocks = _tree(units, n, n_blocks)
    blocks = _blocks(units, n_blocks, tree)
    one, two = (blocks.select(*[F.col(k).alias(f"{side}_{k}") for k in blocks.columns]) for side in "ab")
    both = one.hint("shuffle_replicate_nl").join(two.coalesce(-(-n_blocks // TOGETHER)), (F.col("a_block") <= F.col("b_block")) & (F.col("a_dim") == F.col("b_dim")))

    def run(batches):
        def piece(path):
            batch = read_batch(path)
            ids, vecs, starts, ends, *shadows = (batch.column(k)[0].as_buffer() for k in (2, 3, *range(5, batch.num_columns)))
            return batch.column(1)[0].as_py(), ids, vecs, batch.column(4)[0].as_py(), starts, ends, *shadows

        for batch in batches:
            for a, b in zip(batch.column(2).to_pylist(), batch.column(5).to_pylist()):
                yield from settle([piece(a)], [piece(b)], None)

    return both.mapInArrow(run, schema)


def _same(a: Side, b: Side) -> bool:
    return a.ids.tobytes() == b.ids.tobytes()


def _pairs_of(found: Callable, name: str | None, threshold: float | None = None) -> Callable:
    """The pairs of two blocks that found(a, b) gives as (rows of a, rows of b, values), each once, a slice of a and of b at a time,
    without those of which one span encloses the other; without values if they have no name. With a threshold of inner products,
    found gets only rows of b that a sieve leaves."""

    def settle(first, second, _):
        held, size = [], 0

        def batch():
            columns = [np.concatenate(x) for x in zip(*held)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["i", "j", name][: len(columns)])

        for dim in _dims(first, second):
            a, b = Side.of(first, dim), Side.of(second, dim)
            same, sieve = _same(a, b), None if threshold is None else Sieve(a, b, threshold)
            for at in range(0, len(a.ids), TILE_ROWS):
                rows = slice(at, at + TILE_ROWS)
                part, columns = a.rows(rows), np.arange(at if same else 0, len(b.ids))
                columns = columns if sieve is None else sieve.columns(rows, columns)
                for lo in range(0, len(columns), TILE_COLUMNS):
                    mine = columns[lo : lo + TILE_COLUMNS]
                    tile = b.rows(mine)
                    p, q, value = found(part, tile)
                    keep = part.ids[p] != tile.ids[q]
                    if same:
                        keep &= at + p < mine[q]
                    if a.paths is not None and b.paths is not None and len(p):
                        keep &= ~enclosed(part, tile, p, q)
                    i, j = part.ids[p[keep]], tile.ids[q[keep]]
                    held.append((np.minimum(i, j), np.maximum(i, j), *(() if name is None else (value[keep],))))
                    size += len(i)
                    if size >= BATCH_PAIRS:
                        yield batch()
                        held, size = [], 0
        if size:
            yield batch()

    return settle


def _links_of(settle: Callable) -> Callable:
    """What the pairs (i, j, value) of two blocks link, without the pairs: each row that has a pair with its root, the smallest id that it
    reaches there; a root's row has the number of pairs and the best value of its tree, other rows 0 and -inf."""

    def reduced(held):
        a, b, n, top = (np.concatenate(x) for x in zip(*held))
        ids, roots = first_reached(a, b)
        at = ids.searchsorted(roots[ids.searchsorted(a)])
        best = np.full(len(ids), -np.inf)
        np.maximum.at(best, at, top)
        return ids, roots, np.bincount(at, n, len(ids)).astype(np.int64), best

    def links(first, second, out):
        held, size = [], 0
        for batch in settle(first, second, out):
            if batch.num_rows:
                i, j, value = (batch.column(k).to_numpy() for k in range(3))
                held.append((i, j, np.ones(len(i), np.int64), value))
                size += len(i)
            if size >= MOST_PAIRS:
                held, size = [reduced(held)], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in reduced(held)], names=["id", "root", "n", "top"])

    return links


def _answer(settle: Callable, links: bool, scores: bool = True) -> tuple[Callable, str]:
    return (_links_of(settle), "id long, root long, n long, top double") if links else (settle, "i long, j long, cosine double" if scores else "i long, j long")


# ---- exact pairs


def exact_pairs(units: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS, n: int | None = None, links: bool = False, scores: bool = True) -> DataFrame:
    """(i, j, cosine), i < j, cosine >= threshold, over all rows; or links between all of them (see _links_of), of which two blocks have
    no more than rows, however many pairs. Without scores (i, j), and few products are taken in double. n: about how many rows there are."""
    scores = scores or links
    settle = _pairs_of(lambda a, b: reaching(a, b, threshold, scores=scores), "cosine" if scores else None, threshold)
    return _every_pair(units, block_rows, n, *_answer(settle, links, scores), alike=True)


# ---- exact pairs of sparse vectors


def _vectors(batch: pa.RecordBatch):
    """(dim, rows, matrix) for each length of vectors in column vec."""
    at = np.asarray(batch.column(1).offsets).astype(np.int64)
    flat, dims = np.asarray(batch.column(1).values), np.diff(at)
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        yield dim, rows, flat[(at[rows][:, None] + np.arange(dim)).ravel()].reshape(len(rows), dim)


@dataclass
class Prefixes:
    """What a pair must share: dimensions from the rarest on, until the rest of a vector is too short to reach the threshold."""

    order: dict[int, np.ndarray]  # by length of vectors: dimensions, the rarest first
    least: float  # squared length of what is left that still matters

    def of(self, matrix: np.ndarray) -> np.ndarray:
        """(rows, dimensions) whether a dimension is in a row's prefix."""
        order = self.order[matrix.shape[1]]
        squares = matrix[:, order] ** 2
        left = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]  # from a dimension on
        out = np.zeros(matrix.shape, bool)
        out[:, order] = (squares > 0) & (left >= self.least)
        return out


def prefixes(units: DataFrame, threshold: float) -> Prefixes:
    """A task passes on counts by dimension, so the driver sees no more numbers than a vector has."""

    def run(batches):
        counts, longest = {}, 0.0
        for batch in batches:
            for dim, _, m in _vectors(batch):
                counts[dim] = counts.get(dim, 0) + (m != 0).sum(0)
                longest = max(longest, float((m**2).sum(1).max(initial=0.0)))
        yield _batch([(d, k, int(n), longest) for d, ns in counts.items() for k, n in enumerate(ns)], [("dim", pa.int32()), ("at", pa.int32()), ("n", pa.int64()), ("longest", pa.float64())])

    rows = _spans(units).select("unit_id", "vec").mapInArrow(run, "dim int, at int, n long, longest double").groupBy("dim", "at").agg(F.sum("n").alias("n"), F.max("longest").alias("longest")).collect()
    longest, order = max((r["longest"] for r in rows), default=0.0), {}
    for r in sorted(rows, key=lambda r: (r["n"], r["at"])):
        order.setdefault(r["dim"], []).append(r["at"])
    # Inner products of what is left are at most its length times the longest vector's; a little less, for rounding.
    return Prefixes({d: np.array(x) for d, x in order.items()}, threshold**2 / longest * (1 - 1e-9) if longest else np.inf)


def prefix_sizes(units: DataFrame, shared: Prefixes) -> DataFrame:
    """(dim, at, n): in how many prefixes a dimension is. The sum of n * n bounds the pairs that are scored."""
    held = units.sparkSession.sparkContext.broadcast(shared)

    def run(batches):
        counts = {}
        for batch in batches:
            for dim, _, m in _vectors(batch):
                counts[dim] = counts.get(dim, 0) + held.value.of(m).sum(0)
        yield _batch([(d, k, int(n)) for d, ns in counts.items() for k, n in enumerate(ns) if n], [("dim", pa.int32()), ("at", pa.int32()), ("n", pa.int64())])

    return _spans(units).select("unit_id", "vec").mapInArrow(run, "dim int, at int, n long").groupBy("dim", "at").agg(F.sum("n").alias("n"))


def prefix_pairs(units: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(i, j, cosine) as exact_pairs, by an inverted index over prefixes of the vectors; threshold is above 0.

    Two vectors whose prefixes share no dimension can't reach the threshold, so rows meet in the dimensions of their prefixes
    only, in blocks. The higher the threshold and the sparser the vectors, the shorter the prefixes.
    """
    if threshold <= 0:
        raise ValueError("prefixes need a threshold above 0")
    plain = not ({"path", "start_line", "end_line"} & set(units.columns))
    units = cut(_spans(units))  # read three times
    shared = prefixes(units, threshold)
    blocks = {(r["dim"], r["at"]): _n_blocks(r["n"], block_rows) for r in prefix_sizes(units, shared).collect()}  # as many as a vector has numbers
    held = units.sparkSession.sparkContext.broadcast((shared, blocks))
    schema = [("of", pa.int64()), *PIECE]

    def run(batches):
        shared, blocks = held.value
        for batch in batches:
            ids, paths, lines = batch.column(0).to_numpy(), batch.column(2), [batch.column(k).to_numpy() for k in (3, 4)]
            for dim, rows, m in _vectors(batch):
                inside = shared.of(m)
                for at in np.flatnonzero(inside.any(0)).tolist():
                    out, mine = [], np.flatnonzero(inside[:, at])
                    block = _block_of(ids[rows[mine]], blocks[dim, at])
                    for b in np.unique(block).tolist():
                        some = mine[block == b]
                        which = rows[some]
                        own = None if plain else paths.take(pa.array(which)).to_pylist()
                        out.append((at, b, dim, ids[which].tobytes(), m[some].tobytes(), own, *(x[which].tobytes() for x in lines)))
                    yield _batch(out, schema)

    pieces = units.mapInArrow(run, "of long, " + _PIECE)
    sizes = units.sparkSession.createDataFrame([(*k, n) for k, n in blocks.items()], "d int, a long, n long")
    dealt = pieces.join(F.broadcast(sizes), (F.col("dim") == F.col("d")) & (F.col("of") == F.col("a"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    role = F.when(F.col("block") == F.col("o"), FIRST | SECOND).when(F.col("block") < F.col("o"), FIRST).otherwise(SECOND)
    base = (F.col("of") * (1 << 31)).cast("long")
    dealt = dealt.withColumns({"x": base + F.least("block", "o"), "y": base + F.greatest("block", "o"), "role": role})

    # A pair that meets in several dimensions is found in each; which of its sums stays makes no difference but in the last bit.
    return _by_block_pair(dealt, _pairs_of(lambda a, b: reaching(a, b, threshold), "cosine"), "i long, j long, cosine double").groupBy("i", "j").agg(F.max("cosine").alias("cosine"))


# ---- signatures


@cache
def planes(dim: int) -> np.ndarray:
    """PLANES x dim coefficients: each adds DRAWS signs at coordinates, from the two halves of one stream."""
    out = np.zeros((PLANES, max(dim, 1)))
    where, sign = splitmix64(1, 2 * PLANES * DRAWS).reshape(2, PLANES, DRAWS)
    np.add.at(out, (np.arange(PLANES)[:, None], (where % np.uint64(max(dim, 1))).astype(int)), np.where(sign & np.uint64(1), 1.0, -1.0))
    return out


def band_values(matrix: np.ndarray) -> np.ndarray:
    """(rows, BANDS) bytes; bit r of band b is the side of plane 8 b + r. Without dimensions all are 0."""
    if matrix.shape[1] == 0:
        return np.zeros((len(matrix), BANDS), np.uint8)
    return np.packbits(matrix @ planes(matrix.shape[1]).T >= 0, axis=1, bitorder="little")


def bands(units: DataFrame) -> DataFrame:
    """(unit_id, band, value) for every row and band."""

    def run(batches):
        for batch in batches:
            at = np.asarray(batch.column(1).offsets)
            flat, ids = np.asarray(batch.column(1).values), batch.column(0).to_numpy()
            dims = np.diff(at)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                v = band_values(flat[(at[rows][:, None] + np.arange(dim)).ravel()].reshape(len(rows), dim))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[rows], BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(rows))), pa.array(v.ravel().astype(np.int32))], names=["unit_id", "band", "value"])

    return _spans(units).select("unit_id", "vec").mapInArrow(run, "unit_id long, band int, value int")


def bucket_sizes(band_rows: DataFrame) -> DataFrame:
    return band_rows.groupBy("band", "value").agg(F.count("*").alias("n"))


def candidates(units: DataFrame, cap: int | None = CAP, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(i, j, votes): pairs that share a band value, i < j; per i the `cap` with most votes (then smallest j) stay."""

    if cap is None:

        def found(a: Side, b: Side):
            votes = _votes(a, b)
            p, q = _where(votes)
            return p, q, votes[p, q].astype(np.int64)

        return _every_pair(units, block_rows, None, _pairs_of(found, "votes"), "i long, j long, votes long")
    every = _every_pair(units, block_rows, None, _most_votes(cap), "i long, j long, votes long")
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("votes"), "j"))
    return every.withColumn("rank", rank).where(F.col("rank") <= cap).drop("rank")


def _votes(a: Side, b: Side) -> np.ndarray:
    votes = np.zeros((len(a.ids), len(b.ids)), np.uint8)
    for band in range(BANDS):
        votes += a.bands[:, band, None] == b.bands[None, :, band]
    return votes


def _most_votes(cap: int) -> Callable:
    """Of two blocks' pairs, for each i the `cap` with most votes and then of the smallest j."""

    def settle(first, second, _):
        for dim in _dims(first, second):
            a, b = (s.rows(np.argsort(s.ids, kind="stable")) for s in (Side.of(first, dim), Side.of(second, dim)))
            for x, y in [(a, b)] if _same(a, b) else [(a, b), (b, a)]:
                for at in range(0, len(x.ids), TILE_ROWS):
                    part = x.rows(slice(at, at + TILE_ROWS))
                    votes = _votes(part, y)
                    votes *= np.arange(len(y.ids))[None, :] >= y.ids.searchsorted(part.ids, "right")[:, None]  # j is above i
                    if x.paths is not None and y.paths is not None:
                        votes[enclosed(part, y, np.s_[:, None], np.s_[None, :])] = 0
                    least = np.ones(len(part.ids), np.uint8)
                    for v in range(2, BANDS + 1):
                        enough = np.count_nonzero(votes >= v, axis=1) >= cap
                        if not enough.any():
                            break
                        least[enough] = v
                    p, q = _where(votes >= least[:, None])
                    value = votes[p, q].astype(np.int64)
                    order = np.lexsort((q, -value, p))
                    p, q, value = p[order], q[order], value[order]
                    start = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1]))) if len(p) else np.zeros(0, int)
                    keep = np.arange(len(p)) - np.repeat(start, np.diff(np.append(start, len(p)))) < cap
                    yield pa.RecordBatch.from_arrays([pa.array(part.ids[p[keep]]), pa.array(y.ids[q[keep]]), pa.array(value[keep])], names=["i", "j", "votes"])

    return settle


def most_differing(threshold: float, miss: float = MISS) -> int:
    """So many bits of two signatures may differ that a pair at the threshold has more with a chance of `miss` at most."""
    p = acos(max(-1.0, min(1.0, threshold))) / pi
    upto = 0.0
    for k in range(PLANES + 1):
        upto += comb(PLANES, k) * p**k * (1 - p) ** (PLANES - k)
        if upto >= 1 - miss:
            return k
    return PLANES


def sparse_pairs(units: DataFrame, threshold: float, miss: float = MISS, block_rows: int = BLOCK_ROWS, n: int | None = None, links: bool = False) -> DataFrame:
    """(i, j, cosine) of unit vectors, cosine >= threshold, among the pairs whose signatures differ in few enough bits; or their links.

    Of the pairs at the threshold about `miss` are lost, of more similar ones fewer; no pair is lost to a cap.
    """
    most = most_differing(threshold, miss)

    def found(a: Side, b: Side):
        x, y = a.signs, b.signs
        far = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
        far += np.bitwise_count(x[:, None, 1] ^ y[None, :, 1])
        return reaching(a, b, threshold, far <= most)

    return _every_pair(units, block_rows, n, *_answer(_pairs_of(found, "cosine"), links))


INDEXES = ("auto", "exact", "sparse")


def choose_index(index: str) -> str:
    """auto is exact at every size: only who asks for it gets an index that may lose pairs."""
    if index not in INDEXES:
        raise ValueError(f"unknown index {index!r}: {', '.join(INDEXES)}")
    return "exact" if index == "auto" else index


def similar_pairs(units: DataFrame, threshold: float, index: str = "auto", miss: float = MISS, links: bool = False) -> DataFrame:
    return exact_pairs(units, threshold, links=links) if choose_index(index) == "exact" else sparse_pairs(units, threshold, miss, links=links)


# ---- queries against a corpus


def _pair_pieces(pairs: DataFrame, bq: int, bc: int) -> DataFrame:
    """Pairs (q, u) as pieces of the block pairs that they lie in, q in ids and u in starts."""

    def run(batches):
        for batch in batches:
            q, u = (batch.column(k).to_numpy() for k in (0, 1))
            x, y = _block_of(q, bq), _block_of(u, bc)
            order = np.lexsort((y, x))
            new = np.flatnonzero((np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)) + 1
            out = [(int(x[r[0]]), int(y[r[0]]), q[r].tobytes(), u[r].tobytes()) for r in np.split(order, new) if len(r)]
            yield _batch(out, [("x", pa.int64()), ("y", pa.int64()), ("ids", pa.binary()), ("starts", pa.binary())])

    rows = pairs.select(F.col("q").cast("long").alias("q"), F.col("u").cast("long").alias("u")).dropna().mapInArrow(run, "x long, y long, ids binary, starts binary")
    empty = {"dim": F.lit(0), "vecs": F.lit(None).cast("binary"), "paths": F.lit(None).cast("array<string>"), "ends": F.lit(None).cast("binary"), "role": F.lit(PAIRS)}
    return rows.withColumns(empty)


def _against(queries: DataFrame, corpus: DataFrame, pairs: DataFrame | None, block_rows: int, settle: Callable, schema: str) -> DataFrame:
    """settle(queries, corpus, left out) for each pair of blocks and length of vectors; left out is a boolean matrix or None."""
    bq, bc = (_n_blocks(x.count(), block_rows) for x in (queries, corpus))
    cols = ["x", "y", "role", *[n for n, _ in PIECE[1:]]]
    one = _pieces(queries, bq).withColumns({"x": F.col("block"), "y": _upto(bc), "role": F.lit(FIRST)}).select(*cols)
    two = _pieces(corpus, bc).withColumns({"y": F.col("block"), "role": F.lit(SECOND)}).withColumn("x", _upto(bq)).select(*cols)
    dealt = one.unionByName(two)
    if pairs is not None:
        dealt = dealt.unionByName(_pair_pieces(pairs, bq, bc).select(*cols))

    def each(first, second, out):
        for dim in _dims(first, second):
            q, c, left = Side.of(first, dim), Side.of(second, dim), None
            if out:
                oq, ou = (np.concatenate([np.frombuffer(p[k], np.int64) for p in out]) for k in (1, 4))
                left = np.zeros((len(q.ids), len(c.ids)), bool)
                by_q, by_c = np.argsort(q.ids, kind="stable"), np.argsort(c.ids, kind="stable")
                qi, ci = (s.ids[o].searchsorted(v) for s, o, v in ((q, by_q, oq), (c, by_c, ou)))
                there = (qi < len(q.ids)) & (ci < len(c.ids))
                qi, ci, oq, ou = qi[there], ci[there], oq[there], ou[there]
                hit = (q.ids[by_q[qi]] == oq) & (c.ids[by_c[ci]] == ou)
                left[by_q[qi[hit]], by_c[ci[hit]]] = True
            yield from settle(q, c, left)

    return _by_block_pair(dealt, each, schema)


def scored(queries: DataFrame, corpus: DataFrame, block_rows: int = BLOCK_ROWS, top: int | None = None, pairs_out: DataFrame | None = None, least: float | None = None) -> DataFrame:
    """(q, u, cosine) of query rows (unit_id, vec) against corpus rows (unit_id, vec); with `top`, each query's best.

    A task multiplies one block of each and, with `top`, passes on no more than that many rows a query, with `least`, none of
    a lower score; the last choice is a window over what is left. pairs_out (q, u) are pairs to leave out, each sent to
    the one pair of blocks that it lies in. Ids are unique in both tables.
    """

    def settle(q: Side, c: Side, left: np.ndarray | None):
        out = []
        for lo in range(0, len(q.ids), SLICE):
            s = q.vecs[lo : lo + SLICE] @ c.vecs.T
            open_ = np.ones(s.shape, bool) if left is None else ~left[lo : lo + SLICE]
            if least is not None:
                open_ &= s >= least
            if top is not None and s.shape[1] > top:
                masked = np.where(open_, s, -np.inf)
                open_ &= masked >= np.partition(masked, s.shape[1] - top, axis=1)[:, s.shape[1] - top, None]
            p, u = np.nonzero(open_)
            out.append((q.ids[lo + p], c.ids[u], s[p, u]))
        a, b, v = (np.concatenate(x) for x in zip(*out))
        if top is not None:
            order = np.lexsort((b, -v, a))
            a, b, v = a[order], b[order], v[order]
            start = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, int)
            keep = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a)))) < top
            a, b, v = a[keep], b[keep], v[keep]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(v)], names=["q", "u", "cosine"])

    found = _against(queries.select("unit_id", "vec"), corpus.select("unit_id", "vec"), pairs_out, block_rows, settle, "q long, u long, cosine double")
    if top is None:
        return found
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "u"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


def rank_originals(queries: DataFrame, corpus: DataFrame, truth: DataFrame, digits: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(q, rank, cos_orig, margin, top_hit) of queries (unit_id, vec) whose true rows (q, u) are in the corpus (unit_id, vec).

    rank: of the best true row among all rows by score, then id; margin: over the best other row (over 0 without one). Scores are
    rounded to `digits` if given. First the true pairs are scored; then each block counts the rows that go before a query's best
    true one, and keeps its best other row. The product of queries and corpus stays inside the tasks.
    """
    rounded = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    size = lambda v: F.col(v).cast("array<double>")
    true = truth.select(F.col("q").cast("long").alias("q"), F.col("u").cast("long").alias("u")).distinct()
    # The corpus streams past the ids of true rows before any vector is sorted.
    known = corpus.select(F.col("unit_id").cast("long").alias("u"), size("vec").alias("vu")).join(true.select("u").distinct().hint("shuffle_hash"), "u", "left_semi")
    both = true.join(queries.select(F.col("unit_id").cast("long").alias("q"), size("vec").alias("vq")), "q").join(known, "u")
    own = both.where(F.size("vq") == F.size("vu")).groupBy("q").agg(F.min(F.struct((-rounded(dot(F.col("vq"), F.col("vu")))).alias("cos"), "u")).alias("best"))
    own = own.select("q", (-F.col("best.cos")).alias("cos_orig"), F.col("best.u").alias("orig"))
    # A query takes its best true row along: the score behind its vector, the id as its start line.
    behind = lambda more: F.concat(size("vec"), F.array(more)).alias("vec")
    asked = queries.select(F.col("unit_id").cast("long").alias("q"), "vec").join(own, "q").select(F.col("q").alias("unit_id"), behind(F.col("cos_orig")), F.col("orig").alias("start_line"))

    def settle(q: Side, c: Side, left: np.ndarray | None):
        out, best, orig = [], q.vecs[:, -1], q.starts
        for lo in range(0, len(q.ids), SLICE):
            s = q.vecs[lo : lo + SLICE, :-1] @ c.vecs[:, :-1].T
            if digits is not None:
                s = np.round(s, digits)
            other = np.where(False if left is None else left[lo : lo + SLICE], -np.inf, s)
            mine, its = best[lo : lo + SLICE, None], orig[lo : lo + SLICE, None]
            before = ((other > mine) | ((other == mine) & (c.ids[None, :] < its))).sum(1)
            top = other.max(1)
            first = np.where(other == top[:, None], c.ids[None, :], np.iinfo(np.int64).max).min(1)
            for k in range(len(before)):
                out.append((int(q.ids[lo + k]), int(before[k]), None if top[k] == -np.inf else float(top[k]), int(first[k])))
        yield _batch(out, [("q", pa.int64()), ("before", pa.int64()), ("top", pa.float64()), ("first", pa.int64())])

    parts = _against(asked, corpus.select("unit_id", behind(F.lit(0.0))), true, block_rows, settle, "q long, before long, top double, first long")
    best = F.min(F.when(F.col("top").isNotNull(), F.struct((-F.col("top")).alias("cos"), "first")))
    summed = parts.groupBy("q").agg(F.sum("before").alias("before"), best.alias("other")).join(own, "q")
    other = -F.col("other.cos")
    top_hit = F.when(F.col("before") == 0, F.col("orig")).otherwise(F.col("other.first"))
    return summed.select("q", (F.col("before") + 1).cast("int").alias("rank"), "cos_orig", (F.col("cos_orig") - F.coalesce(other, F.lit(0.0))).alias("margin"), top_hit.alias("top_hit"))
