"""Contiguous shards of near-equal bytes, from global prefix sums of per-partition totals (DataFrame functions only).

Rows are laid in one global order (doc_id, then checksum, size and row; nulls first) by range partitions. Each partition's
bytes and rows are totalled, the totals of the partitions (one row a partition) are prefix-summed, and a row's global
offset is its partition's offset plus the running sum inside the partition. A row belongs to the shard in whose equal
share of all bytes its midpoint lies, so shards are contiguous, and their sizes differ by about one row.

Defined cases: a null text counts as empty (size 8, checksum 0); null ids come first; repeated rows each get a slot of
their own; an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinspect.session import cut, load

OVERHEAD = 8
N_SHARDS = 24


def assign_shards(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """One row for each row of docs (doc_id, text): size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    rows = cut(rows.withColumn("own_no", F.monotonically_increasing_id()))  # texts are read once; rows that repeat part too
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc(), F.col("own_no").asc()]
    # The range bounds come from a sample, so the layout is written down before two passes look at it.
    laid = cut(rows.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()))

    totals = laid.groupBy("pid").agg(F.sum("size").alias("p_bytes"), F.count("*").alias("p_rows"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    everything = Window.partitionBy()
    offsets = totals.select(
        "pid",
        F.coalesce(F.sum("p_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("p_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("p_bytes").over(everything).alias("all_bytes"),
    )
    inside = Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        laid.withColumns({"upto": F.sum("size").over(inside), "nth": F.row_number().over(Window.partitionBy("pid").orderBy(*order))})
        .join(F.broadcast(offsets), "pid")
        .withColumns({"row_no": F.col("rows_before") + F.col("nth") - 1, "twice_mid": 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")})
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"(twice_mid * {n_shards}) div (2 * all_bytes)")).cast("int"))
    )
    firsts = placed.groupBy("shard").agg(F.min("row_no").alias("first_row"))  # n_shards rows
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row_no") - F.col("first_row")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_byte_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(load(spark, sf_dir, "documents"))


SQL = f"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
h AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
k AS (SELECT doc_id, octet_length(b)::BIGINT + {OVERHEAD} AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(b), '..'), lambda x: concat('0x', x)::BIGINT)), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM h, tab),
o AS (SELECT *, row_number() OVER w AS n, sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto, sum(size) OVER ()::BIGINT AS total FROM k WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size)),
s AS (SELECT *, least({N_SHARDS - 1}, ((2 * upto - size) * {N_SHARDS}) // (2 * total))::INTEGER AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (n - min(n) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM s
"""
