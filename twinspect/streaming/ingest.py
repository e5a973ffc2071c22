"""Texts from a stream into the store: each micro-batch adds what no earlier one had, and embeds it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspect.functions.text import content_hash, embed_text
from twinspect.operators.embedding import hashed_tokens
from twinspect.sources.store import UnitStore


def ingest(stream: DataFrame, store: UnitStore, model: str, checkpoint: str, embed=None):
    """Start a query over a stream of rows (text). A batch that is repeated after a failure adds nothing twice.

    embed maps rows (hash, text) to rows (hash, vec); by default tokens are hashed.
    """
    embed = embed or (lambda texts: hashed_tokens(texts, "hash", unique=True))

    def add(batch: DataFrame, _: int) -> None:
        rows = batch.where("text IS NOT NULL").select(content_hash(F.col("text")).alias("hash"), "text").groupBy("hash").agg(F.min("text").alias("text"))
        rows = rows.persist()
        try:
            store.add_texts(rows)
            done = store.embeddings_of(model).select("hash")
            todo = rows.join(done, "hash", "left_anti").select("hash", embed_text(F.col("text")).alias("text"))
            store.add_embeddings(model, embed(todo))
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
