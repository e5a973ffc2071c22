"""Connected components of an edge table, by spanning forests inside partitions and contraction between them.

A task replaces its edges by a spanning forest of them: each vertex with the root of its tree, roots with themselves. A
vertex that several tasks saw has several roots; it takes the first of them in a random order, the others become edges to that
one, and the vertex leaves the graph. So only roots go on to the next round, in which tasks hold about CHUNK edges again. When a
round has one task, its forest is final, and labels are handed down to the vertices that left. No vertex has more rows than there
are tasks, however many edges it has; labels go down by join_heavy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinspect.operators.joins import heavy_from, join_heavy
from twinspect.session import cut

CHUNK = 100_000  # edges of a task


def _random_order(ids: np.ndarray, seed: int) -> np.ndarray:
    """A place for each id: one to one, by the finalizer of a published generator (Steele, Lea and Flood, 2014)."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))).view(np.int64)


def first_reached(a: np.ndarray, b: np.ndarray, seed: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of edges (a, b), and the first vertex that each reaches: the smallest, or with a seed that of a random order."""
    ids, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    if seed is not None:
        order = np.argsort(_random_order(ids, seed), kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        ids, ends = ids[order], place[ends]
    x, y, root = ends[: len(a)], ends[len(a) :], np.arange(len(ids))
    while True:  # every root with an edge to another one merges with it, so at most half of these are left each time
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (low == high).all():
            return ids, ids[root]
        np.minimum.at(root, high, low)
        while (root != (up := root[root])).any():
            root = up


def forests(edges: DataFrame, seed: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(a, b, place): a spanning forest of each partition's edges (a, b), as stars; a task holds at most some chunks of edges."""

    def run(batches):
        held, size = [], 0

        def reduced():
            return first_reached(*(np.concatenate(x) for x in zip(*held)), seed)

        def batch(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(b if seed is None else _random_order(b, seed), pa.int64())], names=["a", "b", "place"])

        for edge in batches:
            held.append((edge.column(0).to_numpy(), edge.column(1).to_numpy()))
            size += edge.num_rows
            if size >= 4 * chunk:
                forest = reduced()
                held, size = [forest], len(forest[0])
                if size >= 2 * chunk:  # hardly smaller: pass it on
                    yield batch(*forest)
                    held, size = [], 0
        if size:
            yield batch(*reduced())

    return edges.select("a", "b").mapInArrow(run, "a long, b long, place long")


def components(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(id, component) for every vertex of edges (a, b: long); the component is its smallest vertex.

    Every round is written to the checkpoint folder. Self-loops, repeated edges and edges with a null end are ignored; a
    vertex without an edge to another one has no row. A round takes away a third of a long chain's vertices, and all but the
    centre of a star.
    """
    now = cut(forests(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b"), 0, chunk), thin=True)
    levels, seed = [], 0
    while (tasks := max(1, -(-now.count() // chunk))) > 1:
        seed += 1
        trees = forests(now.coalesce(tasks), seed, chunk)
        first = F.min(F.struct("place", "b")).over(Window.partitionBy("a"))["b"]
        seen = cut(trees.withColumn("first", first).select("a", "b", "first").distinct(), thin=True)
        levels.append(seen.where("b = first").select("a", "first"))
        now = cut(seen.where("b != first").select(F.col("b").alias("a"), F.col("first").alias("b")).distinct(), thin=True)
    labels = cut(forests(now.coalesce(1), None, chunk)).select(F.col("a").alias("id"), F.col("b").alias("label"))
    if not levels:
        return labels.withColumnRenamed("label", "component")
    for level in reversed(levels):
        many = level.groupBy("first").agg(F.count("*").alias("many"))
        known = cut(labels.withColumnRenamed("id", "first").join(many, "first"), thin=True)
        down = join_heavy(level, known, "first", F.col("many") >= heavy_from(level.count()), ["a"], inner=False)
        labels = cut(down.select(F.col("a").alias("id"), F.coalesce("label", "first").alias("label")), thin=True)
    low = cut(labels.groupBy("label").agg(F.min("id").alias("component"), F.count("*").alias("many")), thin=True)
    return join_heavy(labels, low, "label", F.col("many") >= heavy_from(labels.count()), ["id"]).select("id", "component")
