"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, documents that hold benchmark
passages go, sources are mixed to their target weights, and the rest is laid into shards.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet below the session's checkpoint folder and reads again as the next one's docs; a stage's folder is removed when the
next one is written. All but the last return the columns of documents, whatever these are called.

Stages decide by row, not by id. Ids may be null or repeat, and texts may be null, empty or repeat; each stage's docstring
says what becomes of these. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspect.llm import decontam, mixing, neardup, sharding, toxicity
from twinspect.llm.common import text_key
from twinspect.session import checkpoint_dir, load, remove_folder

NEAR = 80  # least similarity of near duplicates, in hundredths


def _row_and_key(docs: DataFrame) -> DataFrame:
    """(row, key): the document's own columns, and its id with two hashes of its text."""
    key = {"no_id": F.col("doc_id").isNull(), "doc_id": F.col("doc_id").cast("long"), **text_key(F.col("text"))}
    return docs.select(F.struct(*docs.columns).alias("row"), F.struct(*[v.alias(k) for k, v in key.items()]).alias("key"))


def _blank() -> Column:
    return ~F.coalesce(F.col("row.text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")


def _order(docs: DataFrame) -> Column:
    """All columns but id and text, by name, those that have no order of their own (maps and the like) as JSON."""
    plain = lambda f: not any(t in f.dataType.simpleString() for t in ("map<", "variant", "interval"))
    fields = [f for f in sorted(docs.schema, key=lambda f: f.name) if f.name not in ("doc_id", "text")]
    return F.struct(F.lit(0), *[F.col(f"row.`{f.name}`") if plain(f) else F.to_json(F.struct(F.col(f"row.`{f.name}`"))) for f in fields])


def _keys(verdicts: DataFrame) -> DataFrame:
    """The distinct keys of rows (doc_id, k1, k2)."""
    return verdicts.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2").alias("of")).distinct()


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is predicted to be toxic go, with or without an id, each copy alike; null and empty texts have the
    score of a text without terms, which is low. Without labels nothing goes."""
    scored = toxicity.toxicity(docs, load(spark, sf_dir, "labels"), rows=True)
    return scored.where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: of the smallest id (rows without one come last), and of rows that repeat id and text the
    first by all their other columns, taken by name. Rows without words are linked with nothing, and all stay."""
    found = neardup.near_duplicates(docs, NEAR)
    chosen = _keys(found.where("chosen AND n_shingles > 0"))
    rows, blank = _row_and_key(docs), _blank()
    one = rows.where(~blank).groupBy("key").agg(F.min_by("row", _order(docs)).alias("row"))
    one = one.join(chosen, F.col("key") == F.col("of"), "left_semi")
    return one.select("row.*").unionByName(rows.where(blank).select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text overlaps with a benchmark passage go, with or without an id, each copy alike; null and empty texts and
    passages overlap with nothing, and such rows take no part in the join."""
    found = _keys(decontam.overlapping(docs, load(spark, sf_dir, "benchmark")))
    rows, blank = _row_and_key(docs), _blank()
    left = rows.where(~blank).join(found, F.col("key") == F.col("of"), "left_anti")
    return left.select("row.*").unionByName(rows.where(blank).select("row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row that the mix takes n times is n rows; each of several equal rows is taken as often as its own draw says. Rows
    without words (null and empty texts) add nothing to a mix of words and aren't taken."""
    drawn = mixing.mix(docs, rows=True).where("size > 0")
    return drawn.select("row", F.explode(F.array_repeat(F.lit(0), (F.col("taken") / F.col("size")).cast("int")))).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row is laid into a shard, repeated ones and those without id or text included."""
    return sharding.assign_shards(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]
#: Learned scores and sketches aren't SQL; tests hold every stage against plain Python on planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the table documents."""
    docs = load(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    done = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if done:
            remove_folder(spark, f"{folder}/{done}")
        docs, done = spark.read.parquet(f"{folder}/{name}"), name
    return docs
