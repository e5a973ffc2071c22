"""The store: units by corpus, texts, and vectors by model, joined by content hash, as snapshots.

Tables are folders of parquet files that are never changed once they are written. A manifest lists the folders that make up the
store: units of each corpus, texts, vectors of each model. A change writes new folders, then a new manifest under the next number,
which takes effect at once and whole: readers see the store before or after it, and a writer that dies midway leaves it as it was.
There is one writer at a time. Folders that none of the last KEEP manifests lists are removed.

Texts and vectors are a cache: they are only ever added, and each hash is embedded once for a model. The manifest carries the
schema's version; older stores (version 1: partitioned tables without a manifest) become a snapshot of this version when they are first
opened, with the kind function and all lines as effective where these are missing, and with vectors at length 1.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from twinspect.functions.text import embed_text, label
from twinspect.functions.vectors import normalized
from twinspect.session import cut, remove_folder

SCHEMA = 2
KEEP = 8
MOST_FOLDERS = 32
COLUMNS = "unit_id long, path string, name string, lang string, unit_kind string, start_line int, end_line int, effective_lines int, hash string, ignored boolean, is_test boolean"
UNITS = COLUMNS + ", corpus string"
TEXTS = "hash string, text string"
EMBEDDINGS = "hash string, dim int, vec array<float>, model string"
MAIN, INJECTED = "main", "injected"


class UnitStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # -- snapshots

    def _fs(self, path: str):
        there = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), there

    def _exists(self, path: str) -> bool:
        fs, there = self._fs(path)
        return fs.exists(there)

    def _names(self, path: str) -> list[str]:
        fs, there = self._fs(path)
        return sorted(f.getPath().getName() for f in fs.listStatus(there)) if fs.exists(there) else []

    def versions(self) -> list[int]:
        """The numbers of the manifests that are there, the last one being the store's state."""
        return [int(n[:-5]) for n in self._names("_manifests") if n.endswith(".json") and n[:-5].isdigit()]

    def _read(self, version: int) -> dict:
        fs, there = self._fs(f"_manifests/{version:012d}.json")
        stream = fs.open(there)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def state(self) -> dict:
        versions = self.versions()
        if not versions:
            empty = {"schema": SCHEMA, "units": {}, "texts": [], "embeddings": {}}
            return self._migrated() if any(self._exists(t) for t in ("units", "texts", "embeddings")) else empty
        found = self._read(versions[-1])
        if found["schema"] > SCHEMA:
            raise ValueError(f"{self.folder} has schema {found['schema']}, this program knows schemas up to {SCHEMA}")
        return found

    def _commit(self, state: dict) -> None:
        """The state takes effect by the renaming of one file."""
        versions = self.versions()
        n = versions[-1] + 1 if versions else 1
        fs, new = self._fs(f"_manifests/.{uuid.uuid4().hex}")
        out = fs.create(new, False)
        try:
            out.write(bytearray(json.dumps(state, indent=1, sort_keys=True).encode()))
        finally:
            out.close()
        if not fs.rename(new, self._fs(f"_manifests/{n:012d}.json")[1]):
            raise RuntimeError(f"version {n} of {self.folder} could not be committed")
        self._prune([*versions, n])

    def _prune(self, versions: list[int]) -> None:
        kept = [self._read(v) for v in versions[-KEEP:]]
        for v in versions[:-KEEP]:
            gone = self._read(v)
            for path in _folders(gone):
                if not any(path in _folders(k) for k in kept):
                    remove_folder(self.spark, f"{self.folder}/{path}")
            remove_folder(self.spark, f"{self.folder}/_manifests/{v:012d}.json")

    def _write(self, table: str, rows: DataFrame) -> str:
        path = f"_data/{table}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{path}")
        return path

    def _table(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def _added(self, table: str, paths: list[str], rows: DataFrame, schema: str) -> list[str]:
        """The folders of a table with rows added; many folders become one."""
        if len(paths) < MOST_FOLDERS:
            return [*paths, self._write(table, rows)]
        return [self._write(table, self._table(paths, schema).unionByName(rows))]

    def _migrated(self) -> dict:
        """Tables of version 1 as a snapshot of this version."""
        state = {"schema": SCHEMA, "units": {}, "texts": [], "embeddings": {}}
        old = lambda t, schema: self.spark.read.schema(schema).option("mergeSchema", True).parquet(f"{self.folder}/{t}")
        if self._exists("units"):
            lines = F.coalesce("effective_lines", F.col("end_line") - F.col("start_line") + 1)
            rows = old("units", UNITS).withColumns({"unit_kind": F.coalesce("unit_kind", F.lit("function")), "effective_lines": lines})
            for corpus in [r[0] for r in rows.select("corpus").distinct().collect()]:  # a few corpora
                state["units"][corpus] = [self._write("units", rows.where(F.col("corpus") == corpus))]
        if self._exists("texts"):
            state["texts"] = [self._write("texts", old("texts", TEXTS))]
        if self._exists("embeddings"):
            rows = old("embeddings", EMBEDDINGS).withColumn("vec", normalized(F.col("vec")).cast("array<float>")).withColumn("dim", F.size("vec"))
            for model in [r[0] for r in rows.select("model").distinct().collect()]:  # a few models
                state["embeddings"][model] = [self._write("embeddings", rows.where(F.col("model") == model))]
        self._commit(state)
        return state

    # -- tables

    def units_of(self, *corpora: str) -> DataFrame:
        """Units of some corpora; only their folders are read."""
        units = self.state()["units"]
        return self._table([p for c in corpora for p in units.get(c, [])], UNITS)

    @property
    def units(self) -> DataFrame:
        return self.units_of(*self.state()["units"])

    @property
    def texts(self) -> DataFrame:
        return self._table(self.state()["texts"], TEXTS)

    def embeddings_of(self, *models: str) -> DataFrame:
        vectors = self.state()["embeddings"]
        return self._table([p for m in models for p in vectors.get(m, [])], EMBEDDINGS)

    @property
    def embeddings(self) -> DataFrame:
        return self.embeddings_of(*self.state()["embeddings"])

    # -- changes

    def replace_corpus(self, corpus: str, extracted: DataFrame) -> None:
        """The corpus now holds these units, or is gone if there are none; texts of new hashes are added, the first text of a hash stays."""
        rows = cut(extracted)
        bad = rows.where(~F.col("unit_kind").isin("function", "block")).limit(1).collect()
        if bad:
            raise ValueError(f"unknown unit kind {bad[0]['unit_kind']!r}")
        state = self.state()
        # An id from the unit's own columns and its place among equal ones: the same at every run.
        same = Window.partitionBy("path", "start_line", "end_line", "name", "unit_kind").orderBy("hash")
        keyed = rows.withColumn("copy", F.row_number().over(same))
        ids = F.xxhash64(F.lit(corpus), "path", "start_line", "end_line", "name", "unit_kind", "copy").bitwiseAND(F.lit((1 << 62) - 1))
        units = keyed.withColumn("unit_id", ids).withColumn("corpus", F.lit(corpus))
        if rows.isEmpty():
            state["units"].pop(corpus, None)
        else:
            state["units"][corpus] = [self._write("units", units.select(*[c.split()[0] for c in UNITS.split(", ")]))]
        self._add_texts(state, _firsts(rows.select("hash", "text", "path", "start_line"), ["path", "start_line"]))
        self._commit(state)

    def _add_texts(self, state: dict, texts: DataFrame) -> None:
        new = _by_keys(texts.select("hash", "text"), self._table(state["texts"], TEXTS), "hash", "left_anti")
        state["texts"] = self._added("texts", state["texts"], new, TEXTS)

    def add_texts(self, texts: DataFrame) -> None:
        """Texts (hash, text), one for each hash; those of known hashes stay as they are."""
        state = self.state()
        self._add_texts(state, texts)
        self._commit(state)

    def drop_corpus(self, corpus: str) -> None:
        state = self.state()
        if state["units"].pop(corpus, None) is not None:
            self._commit(state)

    def pending(self, model: str) -> DataFrame:
        """(hash, text) that a unit of any corpus uses and the model has no vector for; texts as they are embedded."""
        used = _by_keys(self.texts, self.units, "hash", "left_semi")
        todo = _by_keys(used, self.embeddings_of(model), "hash", "left_anti")
        return todo.select("hash", embed_text(F.col("text")).alias("text"))

    def add_embeddings(self, model: str, vectors: DataFrame, replace: bool = False) -> None:
        """Vectors (hash, vec) at length 1; known hashes are left as they are, or replaced."""
        new = vectors.select("hash", normalized(F.col("vec")).cast("array<float>").alias("vec"))
        new = _firsts(cut(new), []).select("hash", F.size("vec").alias("dim"), "vec", F.lit(model).alias("model"))
        state = self.state()
        paths = state["embeddings"].get(model, [])
        old = self._table(paths, EMBEDDINGS)
        if replace:
            state["embeddings"][model] = [self._write("embeddings", _by_keys(old, new, "hash", "left_anti").unionByName(new))]
        else:
            state["embeddings"][model] = self._added("embeddings", paths, _by_keys(new, old, "hash", "left_anti"), EMBEDDINGS)
        self._commit(state)

    # -- what commands read

    def load(self, corpus: str, model: str) -> DataFrame:
        """Units of a corpus with the model's vectors; units without one are left out."""
        return self.units_of(corpus).join(self.embeddings_of(model).select("hash", "vec"), "hash")

    def scannable(self, corpus: str, model: str, min_lines: int, skip_tests: bool, kind: str | None = None, seen: Observation | None = None) -> DataFrame:
        """What a scan compares: not ignored, of min_lines effective lines, without tests if wanted, of one kind if wanted.

        seen gets the counts of the pass that yields the rows: units (with a vector, of the kind), ignored and kept ones.
        """
        rows = self.load(corpus, model)
        if kind is not None:
            rows = rows.where(F.col("unit_kind") == kind)
        keep = ~F.col("ignored") & (F.col("effective_lines") >= min_lines)
        if skip_tests:
            keep = keep & ~F.col("is_test")
        if seen is not None:
            rows = rows.observe(seen, F.count(F.lit(1)).alias("units"), F.count_if("ignored").alias("ignored"), F.count_if(keep).alias("kept"))
        return rows.where(keep)

    def ignored(self, corpus: str, model: str, kind: str | None = None) -> DataFrame:
        """Ignored units with a vector; neither size nor tests matter here."""
        rows = self.load(corpus, model).where("ignored")
        return rows if kind is None else rows.where(F.col("unit_kind") == kind)

    def n_ignored(self, corpus: str, model: str, kind: str | None = None) -> int:
        return self.ignored(corpus, model, kind).count()

    def status(self) -> tuple[DataFrame, DataFrame]:
        """Units by corpus, language and kind; vectors by model."""
        return self.units.groupBy("corpus", "lang", "unit_kind").count(), self.embeddings.groupBy("model").count()


def _by_keys(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """rows with or without those whose key is in `keys`. Only keys are held and none is sorted; rows, which have texts or vectors, pass by."""
    return rows.join(keys.select(key).distinct().hint("shuffle_hash"), key, how).select(*rows.columns)


def _firsts(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (checkpointed) with only the first row of each hash in the order of the columns `by`.

    Rows are told apart by their places, so however many a hash has, they are spread. Only hashes and places are grouped; no task sorts
    texts or vectors.
    """
    placed = rows.withColumn("_place", F.monotonically_increasing_id())
    first = cut(placed.groupBy("hash").agg(F.min(F.struct(*by, "_place"))["_place"].alias("_place"), F.count("*").alias("n")), thin=True)
    if first.where("n > 1").isEmpty():
        return rows
    return _by_keys(placed, first, "_place", "left_semi").select(*rows.columns)


def _folders(state: dict) -> set[str]:
    return {p for paths in (*state["units"].values(), state["texts"], *state["embeddings"].values()) for p in paths}


def labels(units: DataFrame) -> DataFrame:
    return units.withColumn("label", label(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("name"), F.col("unit_kind")))
