"""Joins that no hot key can slow down, and joins by suffixes of strings as joins by equal keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspect.session import THIN_FILES, cut

HEAVY_KEYS = 2000
SMALL_TABLE = 50_000
SALTS = 997
CHUNK_IDS = 1024


def heavy_from(n_rows: int, most: int = HEAVY_KEYS) -> int:
    """The number of rows from which a key counts as heavy; at most `most` keys of n_rows rows can reach it."""
    return n_rows // most + 1


def join_heavy(rows: DataFrame, table: DataFrame, on: str, heavy: Column, salt: list[str], inner: bool = True, size: int | None = None) -> DataFrame:
    """rows with the columns of table, which has one row for each value of `on`, joined however often a value occurs in rows.

    heavy marks the table's rows for keys of many rows (see heavy_from: a bounded number of them): these rows are
    broadcast. All others meet in a shuffle, in which rows of heavy keys are spread by a hash of the columns `salt`. If
    size, the table's counted number of rows, is at most SMALL_TABLE, all of it is broadcast.
    """
    if size is not None and size <= SMALL_TABLE:
        key = table.withColumnRenamed(on, "_k")
        return rows.join(F.broadcast(key), F.col(on) == F.col("_k"), "inner" if inner else "left").drop("_k")
    names = [c for c in table.columns if c != on]
    pack = F.struct(*names)
    hot = table.where(heavy).select(F.col(on).alias("_hk"), pack.alias("_hot"))
    # Always 0, but no constant: of a constant the optimizer would make a filter, and rows of heavy keys would meet in one task.
    none = F.pmod(F.xxhash64(on), F.lit(1)).cast("int")
    cold = table.where(~heavy).select(F.col(on).alias("_ck"), pack.alias("_cold"), none.alias("_cs"))
    out = rows.join(F.broadcast(hot), F.col(on) == F.col("_hk"), "left")
    found = F.col("_hot").isNotNull()
    out = out.withColumns({"_k": F.when(~found, F.col(on)), "_s": F.when(found, F.pmod(F.xxhash64(*salt), F.lit(SALTS)).cast("int") + 1).otherwise(0)})
    out = out.join(cold, (F.col("_k") == F.col("_ck")) & (F.col("_s") == F.col("_cs")), "left").withColumn("_t", F.coalesce("_hot", "_cold"))
    if inner:
        out = out.where("_t IS NOT NULL")
    return out.select(*rows.columns, *[F.col("_t")[n].alias(n) for n in names])


def by_suffix(rows: DataFrame, column: str, ends: DataFrame, end: str, also: dict[str, str] | None = None) -> DataFrame:
    """Rows of `rows` and `ends` joined where `column` ends with `end` (and the columns of `also` are equal: of rows, of ends).

    The distinct lengths of the ends, of which there are no more than the longest string has characters, are broadcast; a
    row has one suffix for each of them that it can have, and suffixes meet ends as equal keys.
    """
    also = also or {}
    lengths = ends.where(F.col(end).isNotNull()).agg(F.sort_array(F.collect_set(F.length(end))).alias("_lengths")).first()[0]  # at most one for each length of a string
    long_enough = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(column))
    keyed = rows.withColumn("_n", F.explode(long_enough)).withColumn("_suffix", F.expr(f"CASE WHEN _n = 0 THEN '' ELSE right(`{column}`, _n) END"))
    same = [F.col("_suffix") == F.col(end), *[F.col(a) == F.col(b) for a, b in also.items()]]
    return keyed.join(ends, same).drop("_n", "_suffix")


def chunked(rows: DataFrame, keys: list[str], id_: str, most: int = CHUNK_IDS) -> DataFrame:
    """(keys, id_): ids of rows with the same keys in lists of about `most`, by a hash of the id; null keys stay.

    A key that few rows have may have shorter lists than it could, so there are at most as many lists as rows.
    """
    largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    lists = F.pmod(F.xxhash64(id_), F.lit(-(-largest // most) or 1))
    return cut(rows.withColumn("_list", lists).groupBy(*keys, "_list").agg(F.collect_list(id_).alias(id_)).drop("_list"), thin=True)


def unchunked(met: DataFrame, one: str, two: str) -> DataFrame:
    """All pairs of two columns of lists. Lists are spread over tasks before they are written out, however few keys they come from."""
    tasks = THIN_FILES * max(1, met.sparkSession.sparkContext.defaultParallelism)
    dealt = met.select(one, two).repartition(tasks)
    return dealt.select(F.explode(one).alias(one), two).select(one, F.explode(two).alias(two))
