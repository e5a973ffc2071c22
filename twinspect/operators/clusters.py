"""Clusters of similar units: components of the pair graph, pruned of longer overlapping members, split again, ordered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinspect.operators.graph import components
from twinspect.operators.overlap import drop_larger_members, overlapping_shorter
from twinspect.session import cut


def labelled(pairs: DataFrame) -> DataFrame:
    """(unit_id, cluster_id) for every unit with a pair; the id is the smallest member's."""
    return components(pairs.select(F.col("i").alias("a"), F.col("j").alias("b"))).select(F.col("id").alias("unit_id"), F.col("component").alias("cluster_id"))


def with_units(labels: DataFrame, units: DataFrame) -> DataFrame:
    return labels.join(units.select("unit_id", "path", "start_line", "end_line"), "unit_id")


def pruned(pairs: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, pairs, all members before) after longer overlapping members and their pairs left and clusters split.

    members: unit_id, cluster_id (after the split), parent_id (before), path, start_line, end_line. Only clusters that lost a
    member are labelled anew; the others keep their label and their pairs.
    """
    pairs = cut(pairs)
    before = cut(with_units(labelled(pairs), units))
    kept = cut(drop_larger_members(before).select("unit_id", F.col("cluster_id").alias("parent_id"), "path", "start_line", "end_line"))
    smaller = before.join(kept.select("unit_id"), "unit_id", "left_anti").select(F.col("cluster_id").alias("parent_id")).distinct().withColumn("lost", F.lit(True))
    ids = cut(kept.join(smaller, "parent_id", "left").select("unit_id", "parent_id", F.coalesce("lost", F.lit(False)).alias("lost")))
    left = pairs.join(ids.select(F.col("unit_id").alias("i"), "lost"), "i").join(ids.select(F.col("unit_id").alias("j")), "j", "left_semi").select("i", "j", "cosine", "lost")
    left = cut(left)
    whole = ids.where("NOT lost").select("unit_id", F.col("parent_id").alias("cluster_id"))
    members = whole.unionByName(labelled(left.where("lost"))).join(kept, "unit_id")
    return members, left.drop("lost"), before


def linked(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels (unit_id, cluster_id) and totals (cluster_id, n_pairs, top_score) of links (id, root, n, top)."""
    links = cut(links, thin=True)
    labels = cut(labelled(links.select(F.col("id").alias("i"), F.col("root").alias("j"))), thin=True)
    trees = links.where("n > 0").join(labels.withColumnRenamed("unit_id", "root"), "root")
    return labels, trees.groupBy("cluster_id").agg(F.sum("n").alias("n_pairs"), F.max("top").alias("top_score"))


def pruned_links(units: DataFrame, find: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, totals, all members before), as pruned(), where find(units) gives links in place of pairs.

    Pairs, of which a cluster may have as many as the square of its members, are never listed. What is left of a cluster that lost a
    member is compared again: its pairs are all in one old cluster.
    """
    labels, totals = linked(find(units))
    before = cut(with_units(labels, units))
    kept = cut(drop_larger_members(before).select("unit_id", F.col("cluster_id").alias("parent_id"), "path", "start_line", "end_line"))
    smaller = cut(before.join(kept.select("unit_id"), "unit_id", "left_anti").select(F.col("cluster_id").alias("parent_id")).distinct(), thin=True)
    members = kept.join(smaller, "parent_id", "left_anti").withColumn("cluster_id", F.col("parent_id"))
    if not smaller.isEmpty():
        left = kept.join(smaller, "parent_id", "left_semi")
        labels, again = linked(find(cut(units.join(left.select("unit_id"), "unit_id", "left_semi"))))
        members = members.unionByName(left.join(labels, "unit_id"))
        totals = totals.join(smaller.withColumnRenamed("parent_id", "cluster_id"), "cluster_id", "left_anti").unionByName(again)
    return members, totals, before


def hidden_overlaps(members: DataFrame, before: DataFrame) -> DataFrame:
    """(cluster_id, hidden_overlaps): removed units that are longer than and overlap a member that stayed."""
    gone = before.join(members.select("unit_id"), "unit_id", "left_anti").withColumnRenamed("cluster_id", "parent_id")
    # A removed unit is looked at once for each cluster that its own was split into and that has a member in its file.
    kept = members.select("parent_id", "path", "cluster_id", "start_line", "end_line")
    near = gone.join(kept.select("parent_id", "path", "cluster_id").distinct(), ["parent_id", "path"])
    by = ["parent_id", "path", "cluster_id"]
    counted = near.join(overlapping_shorter(near, kept, by), [*by, "start_line", "end_line"], "left_semi").groupBy("cluster_id").agg(F.count("*").alias("hidden_overlaps"))
    return members.select("cluster_id").distinct().join(counted, "cluster_id", "left").select("cluster_id", F.coalesce("hidden_overlaps", F.lit(0)).cast("long").alias("hidden_overlaps"))


def summary(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cluster_id, n_members, n_pairs, max_span, top_score) of members (unit_id, cluster_id, start_line, end_line)."""
    scores = pairs.join(members.select(F.col("unit_id").alias("i"), "cluster_id"), "i").groupBy("cluster_id").agg(F.count("*").alias("n_pairs"), F.max("cosine").alias("top_score"))
    return with_totals(members, scores)


def with_totals(members: DataFrame, totals: DataFrame) -> DataFrame:
    """As summary(), of totals (cluster_id, n_pairs, top_score)."""
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n_members"), F.max(F.col("end_line") - F.col("start_line") + 1).cast("long").alias("max_span"))
    return sizes.join(totals, "cluster_id").select("cluster_id", "n_members", "n_pairs", "max_span", "top_score")


def ordered(summaries: DataFrame, top: int | None = None, min_members: int = 2) -> DataFrame:
    """Clusters of min_members or more by (longest span, best score, smallest member), numbered; the first `top`."""
    rows = summaries.where(F.col("n_members") >= min_members)
    by = [F.desc("max_span"), F.desc("top_score"), F.asc("cluster_id")]
    if top is not None:
        rows = rows.orderBy(*by).limit(top)  # a heap of `top` rows a task
        return rows.withColumn("place", F.row_number().over(Window.orderBy(*by)))
    return rows.orderBy(*by)
