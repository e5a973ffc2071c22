"""Retrieval quality on planted rewrites: pick plants, rank their originals, aggregate by level."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspect.functions.text import selector
from twinspect.operators.joins import by_suffix, chunked, unchunked
from twinspect.operators.similar import rank_originals
from twinspect.session import cut

BATCH_CHARS = 4_000_000


def plants(manifest: DataFrame, injected: DataFrame) -> DataFrame:
    """(file, original, level, unit_id): the longest injected unit of each manifest file; of equal ones the last."""
    units = injected.select("unit_id", F.col("path").alias("u_path"), (F.col("end_line") - F.col("start_line")).alias("span"))
    hit = by_suffix(units, "u_path", manifest.select("file", "original", "level"), "file")
    best = hit.groupBy("file", "original", "level").agg(F.max(F.struct("span", "unit_id")).alias("best"))
    return best.select("file", "original", "level", F.col("best.unit_id").alias("unit_id"))


def originals(picked: DataFrame, main: DataFrame) -> DataFrame:
    """(q, u): main units that a plant's selector names: the name, a path suffix, and lines if the selector has them.

    Lists of ids with the same names, paths and lines meet, and become pairs last.
    """
    parts = selector(F.col("original"))
    p = picked.select(F.col("unit_id").alias("q"), *[v.alias(f"s_{k}") for k, v in parts.items()])
    units = main.select(F.col("unit_id").alias("u"), F.col("path").alias("u_path"), F.col("name").alias("u_name"), "start_line", "end_line")
    p = chunked(p.where("s_name IS NOT NULL AND s_path IS NOT NULL"), [f"s_{k}" for k in parts], "q")
    units = chunked(units.where("u_name IS NOT NULL AND u_path IS NOT NULL"), ["u_path", "u_name", "start_line", "end_line"], "u")
    spans = F.col("s_lo").isNull() | ((F.col("start_line") == F.col("s_lo")) & (F.col("end_line") == F.col("s_hi")))
    return unchunked(by_suffix(units, "u_path", p, "s_path", {"u_name": "s_name"}).where(spans), "q", "u")


def contained(texts: DataFrame, passages: DataFrame, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """(q, u) for every passage (q, text) that a text (u, text) contains, character by character; null and empty ones take no part.

    Distinct passages are compiled into automata of about batch_chars characters, by which every text is read once for each.
    """
    spark = texts.sparkSession
    asked = cut(passages.where("text IS NOT NULL AND text <> ''").groupBy("text").agg(F.collect_set("q").alias("qs")))
    n = max(1, -(-(asked.agg(F.sum(F.length("text"))).first()[0] or 0) // batch_chars))
    dealt = asked.withColumn("batch", F.pmod(F.xxhash64("text"), F.lit(n)))

    def found(batch: int) -> DataFrame:
        held = spark.sparkContext.broadcast([r["text"] for r in dealt.where(F.col("batch") == batch).select("text").collect()])  # about batch_chars

        def run(batches):
            automaton = ahocorasick.Automaton()
            for text in held.value:
                automaton.add_word(text, text)
            automaton.make_automaton() if held.value else None
            for rows in batches:
                us, hits = [], []
                for u, text in zip(rows.column(0).to_pylist(), rows.column(1)):  # one text at a time leaves the batch
                    some = sorted({x for _, x in automaton.iter(text.as_py())}) if held.value else []
                    us += [u] * len(some)
                    hits += some
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(hits, pa.string())], names=["u", "passage"])

        return texts.select(F.col("u").cast("long").alias("u"), "text").where("text IS NOT NULL").mapInArrow(run, "u long, passage string")

    every = found(0)
    for batch in range(1, n):
        every = every.unionByName(found(batch))
    return every.join(asked, F.col("passage") == F.col("text")).select(F.explode("qs").alias("q"), "u").distinct()


def levels(ranked: DataFrame) -> DataFrame:
    """By level: n, recall at 1 and 5, mean cosine, mean margin."""
    hit = lambda k: F.avg((F.col("rank") <= k).cast("double"))
    return ranked.groupBy("level").agg(F.count("*").alias("n"), hit(1).alias("recall1"), hit(5).alias("recall5"), F.avg("cos_orig").alias("mean_cos"), F.avg("margin").alias("mean_margin"))


def overall(by_level: DataFrame) -> DataFrame:
    """Macro F1 at 1 (one prediction, one original: the mean recall over levels) and the worst recall at 5."""
    return by_level.agg(F.sum("n").alias("n"), F.avg("recall1").alias("macro_f1"), F.min("recall5").alias("worst_recall5"))


def gate(by_level: DataFrame, min_recall5: float) -> None:
    worst = overall(by_level).first()["worst_recall5"]
    if worst is not None and worst < min_recall5:
        raise ValueError(f"recall at 5 of {worst:.2f} at the worst level is below {min_recall5:.2f}")


def evaluate(manifest: DataFrame, injected: DataFrame, main: DataFrame) -> DataFrame:
    """Ranks with file and level for every plant; injected and main have unit_id, path, name, lines, vec."""
    picked = cut(plants(manifest, injected))
    queries = injected.join(picked.select("unit_id").distinct(), "unit_id", "left_semi")
    ranked = rank_originals(queries, main, cut(originals(picked, main)))
    return ranked.join(picked.select(F.col("unit_id").alias("q"), "file", "level"), "q")
