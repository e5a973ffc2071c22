"""Session helpers shared by operators: where checkpoints go, and how tables are read."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

THIN_FILES = 4


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's reliable checkpoint folder, which spark.checkpoint.dir names.

    Without that setting a session in one process (tests) gets a temporary folder; on a cluster it is an error, since a
    folder of one machine is lost with it.
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    wanted = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        wanted = tempfile.mkdtemp(prefix="twinspect-ck-")
    # What no plan refers to any more is removed from the folder.
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    sc.setCheckpointDir(wanted)
    return sc.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True, thin: bool = False) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so that a lost executor costs no recomputation of what lies before.

    A checkpoint has a file for each partition. Of thin tables, which aren't read by the key that they were shuffled by, there
    are at most THIN_FILES files for each core, so that many partitions don't become as many small files.
    """
    checkpoint_dir(df.sparkSession)
    if thin:
        df = df.coalesce(THIN_FILES * max(1, df.sparkSession.sparkContext.defaultParallelism))
    return df.checkpoint(eager)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any store that Spark writes to."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _where(path: str):
    """A file system and a name in it; Spark names local files file:/... or without a scheme."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def write_batch(path: str, batch: pa.RecordBatch) -> None:
    """One batch as a file of any store that Arrow opens, there whole or not at all."""
    system, name = _where(path)
    folder, last = name.rsplit("/", 1)
    new = f"{folder}/.{last}-{uuid.uuid4().hex}"
    system.create_dir(folder)
    with system.open_output_stream(new) as out, pa.ipc.new_file(out, batch.schema) as writer:
        writer.write_batch(batch)
    system.move(new, name)


def read_batch(path: str) -> pa.RecordBatch:
    """What write_batch wrote; of a local file, pages are mapped."""
    system, name = _where(path)
    source = pa.memory_map(name) if system.type_name == "local" else system.open_input_file(name)
    return pa.ipc.open_file(source).get_batch(0)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
