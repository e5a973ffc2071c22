"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

Sources in code point order (null last) weigh 5, 2, 1, 5, ... and share as many words as there are in all; a target
never passes three times its source's size, and what lies above is shared again by weight (water filling on the table of
sources, which has one row a source). A source whose target holds it e whole times takes every document e times; the
rest of the target is filled in the order of exponential keys -ln(u) / weight, u from a hash of the id (of the text where
there is no id), the weight from the document's quality, by a prefix sum of sizes in key order: a document is taken once
more if its midpoint lies inside.

Rows are laid in range partitions of (source, key, id, size, row), whose bounds follow the data, so that a source of any
share and any distribution of keys is dealt evenly, and even copies of one row part. Prefix sums are taken in two steps, over
the totals of (partition, source), of which there are about as many as partitions, and inside a partition.

Defined cases: a null text has size 0; a null source is a source of its own; rows without an id draw by their text;
repeated rows are drawn separately, in any order among themselves; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinspect.llm.common import n_chars_of, word_list
from twinspect.session import cut, load

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 11
JUNK = "#*$%&|<>!"


def quality_weight(text: Column, n_words: Column) -> Column:
    """From 0.05 (a junk mark at every fifth word or more, or no words) to 1 (none)."""
    share = n_chars_of(F.coalesce(text, F.lit("")), JUNK) / n_words
    return F.when(n_words > 0, F.greatest(F.lit(0.05), 1.0 - 5.0 * share)).otherwise(F.lit(0.05))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows of (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    fill = per.withColumn("w", weight).withColumn("cap", F.lit(float(MAX_REPEAT)) * F.col("source_size")).withColumn("level", F.col("cap") / F.col("w"))
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    fill = fill.withColumn(
        "lam",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(by_level), F.lit(0.0)))
        / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(by_level), F.lit(0.0))),
    )
    fill = fill.withColumn("water", F.min(F.when(F.col("lam") <= F.col("level"), F.struct("level", "lam"))).over(whole)["lam"])
    return fill.select("source", "source_size", F.coalesce(F.least("cap", F.col("water") * F.col("w")), F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, seed: int = SEED, rows: bool = False) -> DataFrame:
    """One row for each row of docs (doc_id, text, source): size, source_size, target, taken; with rows also its own columns, as row."""
    n_words = F.size(word_list(F.col("text"))).cast("long")
    drawn = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit(""))))), F.lit(f":{seed}")))
    u = (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    own = [F.struct(*docs.columns).alias("row")] if rows else []
    thin = docs.select(*own, "doc_id", "source", n_words.alias("size"), "text").withColumn("key", -F.log(u) / quality_weight(F.col("text"), F.col("size")))
    thin = thin.select(*(["row"] if rows else []), "doc_id", "source", "size", "key", F.monotonically_increasing_id().alias("row_no"))
    order = [F.col("source").asc_nulls_last(), F.col("key").asc(), F.col("doc_id").asc_nulls_first(), F.col("size").asc(), F.col("row_no").asc()]
    # The range bounds come from a sample, so the layout is written down before it is looked at twice.
    laid = cut((thin if rows else cut(thin)).repartitionByRange(*order).withColumn("pid", F.spark_partition_id()))

    totals = laid.groupBy("pid", "source").agg(F.sum("size").alias("size"))
    targets = source_targets(totals)
    before = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    starts = totals.select(F.col("pid").alias("p"), F.col("source").alias("s"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    starts = starts.join(targets, starts["s"].eqNullSafe(targets["source"])).select("p", "s", "before", "source_size", "target")
    inside = Window.partitionBy("pid", "source").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0)
    placed = laid.withColumn("upto", F.sum("size").over(inside))
    placed = placed.join(starts, (placed["pid"] == starts["p"]) & placed["source"].eqNullSafe(starts["s"]))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.col("target") - epochs * F.col("source_size")
    more = (F.col("before") + F.col("upto") - F.col("size") / 2.0) < left
    taken = (epochs * F.col("size") + F.when(more, F.col("size")).otherwise(F.lit(0))).cast("long")
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *(["row"] if rows else []))


def op9_efraimidis_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"))


_N = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))"
SQL = f"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text, {_N}::BIGINT AS size FROM documents),
q AS (SELECT *, length(text) - length(translate(text, '{JUNK}', '')) AS junk FROM t),
k AS (SELECT doc_id, source, size,
  -ln((concat('0x', substr(md5(coalesce(doc_id::VARCHAR, 'text:' || md5(text)) || ':{SEED}'), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0)
  / (CASE WHEN size > 0 THEN greatest(0.05, 1.0 - 5.0 * (junk::DOUBLE / size)) ELSE 0.05 END) AS key FROM q),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w FROM s),
l AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / w AS level FROM w),
f AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER o, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0.0)) AS lam
  FROM l WINDOW o AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT lam AS water FROM f WHERE lam <= level ORDER BY level, lam LIMIT 1),
g AS (SELECT source, source_size, coalesce(least(cap, (SELECT water FROM v) * w), 0.0) AS target FROM f),
p AS (SELECT k.doc_id, k.size, g.source_size, g.target,
  sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id NULLS FIRST, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto,
  CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + CASE WHEN upto - size / 2.0::DOUBLE < target - epochs * source_size THEN size ELSE 0 END)::BIGINT AS taken FROM p
"""
