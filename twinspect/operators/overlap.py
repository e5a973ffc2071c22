"""Spans of lines inside one file: containment, overlap, and what larger overlapping units lose.

Both prunes decide from the rows as given, once: in A around B around C, A and B both go, though B is gone itself.

Overlaps are found by sweeps, not by joining a file's spans with each other. A span that overlaps a shorter one has an end of that one
between its own ends (a shorter span can't reach beyond both), so it is enough to know the least width among the ends between
two lines: a range minimum over the sorted ends, taken level by level, so that memory stays linear in the spans of a file.
Whether a changed range meets a unit is a running maximum over the sorted lines of both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SWEEP_ROWS = 200_000


def span(start: Column, end: Column) -> Column:
    return end - start + 1


def contains(a: str, b: str) -> Column:
    """One span encloses the other, ends included. a, b: aliases of rows with start_line and end_line."""
    s1, e1, s2, e2 = (F.col(f"{x}.{y}") for x in (a, b) for y in ("start_line", "end_line"))
    return ((s1 <= s2) & (e1 >= e2)) | ((s2 <= s1) & (e2 >= e1))


def overlaps(a: str, b: str) -> Column:
    return (F.col(f"{a}.start_line") <= F.col(f"{b}.end_line")) & (F.col(f"{b}.start_line") <= F.col(f"{a}.end_line"))


def larger(a: str, b: str) -> Column:
    """a is a longer unit of the same file that overlaps b; equal lengths never prune each other."""
    wide = lambda x: F.col(f"{x}.end_line") - F.col(f"{x}.start_line")
    return (F.col(f"{a}.path") == F.col(f"{b}.path")) & (wide(a) > wide(b)) & overlaps(a, b)


def meets_shorter(lo: np.ndarray, hi: np.ndarray, ends: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """For each span from lo to hi whether an end between them (ends, sorted) belongs to a span of a smaller width."""
    first, last = np.searchsorted(ends, lo, "left"), np.searchsorted(ends, hi, "right")
    many = last - first
    level = np.where(many > 0, np.frexp(np.maximum(many, 1).astype(float))[1] - 1, -1)
    least, out = widths.copy(), np.zeros(len(lo), bool)
    for k in range(int(level.max(initial=-1)) + 1):  # least[i]: of the 2 ** k ends from i on
        here = np.flatnonzero(level == k)
        out[here] = np.minimum(least[first[here]], least[last[here] - (1 << k)]) < (hi - lo)[here]
        step = 1 << k
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
    return out


def overlapping_shorter(long: DataFrame, short: DataFrame, by: list[str]) -> DataFrame:
    """(*by, start_line, end_line): the distinct spans of `long` that overlap a shorter one of `short` with equal `by` columns.

    Spans of one group go through one task, several groups at a time. Null keys equal nothing. Both tables may be the same.
    """
    names = [*by, "start_line", "end_line"]
    thin = lambda df, kind: df.select(*by, *[F.col(c).cast("long").alias(c) for c in names[-2:]], F.lit(kind).alias("kind"))
    both = thin(long, 3) if long is short else thin(long, 1).unionByName(thin(short, 2))
    both = both.where(" AND ".join(f"`{c}` IS NOT NULL" for c in names)).groupBy(*names).agg(F.bit_or("kind").alias("kind"))
    rows = both.repartition(*by).sortWithinPartitions(*by)

    def settled(table: pa.Table, group: np.ndarray) -> pa.Table:
        start, end, kind = (table.column(c).to_numpy() for c in ("start_line", "end_line", "kind"))
        if not len(start):
            return table
        width = int(end.max()) - int(start.min()) + 1
        at = group * width - int(start.min())  # groups one after the other on one line
        lo, hi, mine = at + start, at + end, kind & 2 > 0
        ends = np.concatenate((lo[mine], hi[mine]))
        order = np.argsort(ends, kind="stable")
        longer = np.flatnonzero(kind & 1)
        found = meets_shorter(lo[longer], hi[longer], ends[order], np.tile(hi[mine] - lo[mine], 2)[order])
        return table.take(pa.array(longer[found]))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < SWEEP_ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            group = groups(table)
            cut = int(np.searchsorted(group, group[-1], "left"))  # the last group may go on
            yield from settled(table.slice(0, cut), group[:cut]).select(names).to_batches()
            held, size = table.slice(cut).to_batches(), table.num_rows - cut
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from settled(table, groups(table)).select(names).to_batches()

    def groups(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for c in by:
            code = table.column(c).combine_chunks().dictionary_encode()
            code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        return np.cumsum(new)

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, kinds)


def _without(rows: DataFrame, gone: DataFrame, by: list[str], only: Column | None = None) -> DataFrame:
    a, b = rows.alias("a"), gone.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*by, "start_line", "end_line"]]
    return a.join(b, [*same, *([] if only is None else [only])], "left_anti")


def drop_overlapping_blocks(units: DataFrame) -> DataFrame:
    """Units without the blocks that overlap a shorter block of their file. Functions neither go nor remove."""
    blocks = units.where("unit_kind = 'block'")
    return _without(units, overlapping_shorter(blocks, blocks, ["path"]), ["path"], F.col("a.unit_kind") == "block")


def drop_larger_members(members: DataFrame) -> DataFrame:
    """Members (cluster_id, path, start_line, end_line, ...) without those longer than an overlapping one of their cluster."""
    by = ["cluster_id", "path"]
    return _without(members, overlapping_shorter(members, members, by), by)


def touched(units: DataFrame, ranges: DataFrame) -> DataFrame:
    """Units that a changed range (path, lo, hi) of their file meets, once each.

    Of the ranges that begin at or before a unit's end the one that reaches farthest meets it, or none does: a running maximum.
    """
    changed = ranges.select(F.col("path").alias("_path"), F.col("lo").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.col("hi").cast("long").alias("_hi"), F.lit(None).cast(units.schema).alias("_unit"))
    own = units.select(F.col("path").alias("_path"), F.col("end_line").cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_hi"), F.struct(*units.columns).alias("_unit"))
    upto = Window.partitionBy("_path").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    reach = own.unionByName(changed.where("_at IS NOT NULL AND _hi IS NOT NULL")).withColumn("_reach", F.max("_hi").over(upto))
    return reach.where((F.col("_kind") == 1) & F.col("_path").isNotNull() & (F.col("_reach") >= F.col("_unit.start_line"))).select("_unit.*")
