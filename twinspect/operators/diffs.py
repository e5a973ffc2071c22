"""Changes against a corpus: diff text to line ranges, touched units, nearest neighbours, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinspect.functions.text import hunk_range, lines_of
from twinspect.functions.vectors import dot
from twinspect.operators.joins import chunked, unchunked
from twinspect.operators.similar import scored

REVIEW_BAND = 0.05
TOP = 3
POLICIES = ("touched", "new-pairs", "added")


def changed_ranges(diffs: DataFrame) -> DataFrame:
    """(path, lo, hi) on the new side, from rows (diff_id, text) of unified diffs without context.

    A line "+++ b/PATH" opens a file; every "@@" line after it adds a range; files without ranges give no row.
    """
    rows = diffs.select("diff_id", F.posexplode(lines_of(F.col("text"))).alias("no", "line"))
    opened = F.when(F.col("line").startswith("+++ "), F.when(F.col("line").startswith("+++ b/"), F.substring("line", 7, 1_000_000)).otherwise(F.lit("")))
    upto = Window.partitionBy("diff_id").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("path", F.last(opened, ignorenulls=True).over(upto)).where(F.col("line").startswith("@@") & (F.col("path") != ""))
    found = hunk_range(F.regexp_extract("line", r"^@@ [^+]*(\+\S*)", 1))
    return rows.select("path", found["lo"].alias("lo"), found["hi"].alias("hi")).where("lo IS NOT NULL")


def rankable(ignored: Column, is_test: Column, skip_tests: bool) -> Column:
    return ~(ignored | is_test) if skip_tests else ~ignored


def stale_selves(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(q, u): corpus rows that are the query itself before the change: the same name in the same file.

    Paths are the same if they are equal or one ends with the other from a slash on (paths_equal). Each side's suffixes from a
    slash on meet the whole paths of the other side, with the name, as equal keys: the corpus' suffixes without the whole paths,
    which the queries' have met. Lists of ids meet, and become pairs last; ids are unique in both tables.
    """
    plain = F.regexp_replace("path", r"^(\./)+", "")
    parts = F.split("whole", "/")
    from_slash = lambda first: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/")) if first else F.slice(from_slash(True), 2, F.size(parts))
    side = lambda df, c: chunked(df.where("path IS NOT NULL AND name IS NOT NULL").select(F.col("unit_id").alias(c), "name", plain.alias("whole")), ["name", "whole"], c)
    each = lambda df, first: df.select("*", F.explode(from_slash(first)).alias("suffix")).drop("whole")
    a, b = side(queries, "q"), side(corpus, "u")
    long_q = each(a, True).join(b.withColumnRenamed("whole", "suffix"), ["name", "suffix"]).select("q", "u")
    long_u = each(b, False).join(a.withColumnRenamed("whole", "suffix"), ["name", "suffix"]).select("q", "u")
    return unchunked(long_q.unionByName(long_u), "q", "u")


def neighbours(queries: DataFrame, corpus: DataFrame, stale: DataFrame | None = None, top: int | None = TOP) -> DataFrame:
    """(q, u, cosine, rank): each query's nearest corpus rows; its own former versions are left out."""
    return scored(queries, corpus, top=top, pairs_out=stale)


def margins(ranked: DataFrame) -> DataFrame:
    """(q, cos1, margin): the best score and how far it leads (to 0 if it is alone)."""
    two = ranked.where("rank <= 2").groupBy("q").agg(F.max(F.when(F.col("rank") == 1, F.col("cosine"))).alias("cos1"), F.max(F.when(F.col("rank") == 2, F.col("cosine"))).alias("cos2"))
    return two.select("q", "cos1", (F.col("cos1") - F.coalesce("cos2", F.lit(0.0))).alias("margin"))


def verdicts(queries: DataFrame, corpus: DataFrame, stale: DataFrame, threshold: float | None, policy: str = "touched") -> DataFrame:
    """(q, verdict, cos1, margin) for queries with a neighbour. queries and corpus: unit_id, vec; stale: (q, u).

    touched: the best score reaches the threshold. added: and the query has no former version. new-pairs: some neighbour
    reaches it whose score with the (first) former version did not. Otherwise REVIEW within the band below, or ok.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}: {', '.join(POLICIES)}")
    stale = stale.select("q", "u")
    best = margins(neighbours(queries, corpus, stale, top=2))
    if threshold is None:
        return best.select("q", F.lit("ok").alias("verdict"), "cos1", "margin")
    first = stale.groupBy("q").agg(F.min("u").alias("base"))
    hit = F.col("cos1") >= threshold
    if policy == "touched":
        best = best.withColumn("dup", hit)
    elif policy == "added":
        best = best.join(first, "q", "left").withColumn("dup", hit & F.col("base").isNull())
    else:
        close = scored(queries, corpus, pairs_out=stale, least=threshold)
        vecs = corpus.select(F.col("unit_id").alias("u"), "vec")
        close = close.join(vecs, "u").join(first, "q", "left")
        close = close.join(vecs.select(F.col("u").alias("base"), F.col("vec").alias("base_vec")), "base", "left")
        new = F.col("base_vec").isNull() | (dot(F.col("base_vec"), F.col("vec")) < threshold)
        best = best.join(close.groupBy("q").agg(F.bool_or(new).alias("dup")), "q", "left").withColumn("dup", F.coalesce("dup", F.lit(False)))
    verdict = F.when(F.col("dup"), "DUP").when(F.col("cos1") >= threshold - REVIEW_BAND, "REVIEW").otherwise("ok")
    return best.select("q", verdict.alias("verdict"), "cos1", "margin")
