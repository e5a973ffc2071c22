"""Embedders: the default hashes tokens into a fixed number of counts; others run one process or one session a worker."""

from __future__ import annotations

import hashlib
import json
import subprocess
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspect.functions.vectors import normalized

TOKEN = r"([\p{L}\p{N}_]+)"
HASH_DIM = 256
MOST_ROWS, MOST_TOKENS = 512, 1_000_000
MOST_TEXTS, MOST_CHARS, FLOOR = 16, 24_000, 256


class Embedder(Protocol):
    """Texts to vectors, one each and in order. Instances are made in the worker by a factory and kept there."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def token_bucket(token: str, dim: int = HASH_DIM) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim


def _cells(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(keys, counts by row and bucket) of rows (key, tokens), at most MOST_ROWS and about MOST_TOKENS tokens at a time.

    Each distinct token of a batch is hashed once.
    """
    keys, tokens = batch.column(0), batch.column(1)
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, words = np.cumsum(sizes), tokens.flatten().dictionary_encode()
    bucket, code = np.array([token_bucket(t, dim) for t in words.dictionary.to_pylist()], np.int64), words.indices.to_numpy(zero_copy_only=False)
    at = 0
    while at < len(keys):
        before = int(ends[at - 1]) if at else 0
        to = min(at + MOST_ROWS, max(at + 1, int(np.searchsorted(ends, before + MOST_TOKENS, "right"))))
        cell = np.repeat(np.arange(to - at) * dim, sizes[at:to]) + bucket[code[before : int(ends[to - 1])]]
        yield keys.slice(at, to - at), np.bincount(cell, minlength=(to - at) * dim).reshape(to - at, dim)
        at = to


def _unit_length(keys: pa.Array, counts: np.ndarray, key: str) -> pa.RecordBatch:
    v = counts.astype(float)
    norm = np.sqrt((v * v).sum(1))
    v[norm > 0] /= norm[norm > 0, None]
    return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1], v.ravel())], names=[key, "vec"])


def hashed_tokens(texts: DataFrame, key: str, dim: int = HASH_DIM, unique: bool = False) -> DataFrame:
    """(key, vec): counts of hashed lower-case tokens at length 1; a text without tokens has a zero vector.

    Tokens are split in the JVM; they are hashed, counted and laid into vectors in Arrow batches, MOST_ROWS vectors at a time. Texts of
    one key count together: their counts, of which a text has at most dim, are shuffled. If keys are unique, nothing is.
    """
    tokens = texts.select(F.col(key), F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(1)).alias("tokens"))
    kind = dict(texts.dtypes)[key]

    def vectors(batches):
        for batch in batches:
            for keys, counts in _cells(batch, dim):
                yield _unit_length(keys, counts, key)

    def sparse(batches):
        for batch in batches:
            for keys, counts in _cells(batch, dim):
                row, b = np.nonzero(counts)
                at = pa.array(np.searchsorted(row, np.arange(len(keys) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(at, pa.array(b, pa.int32())), pa.ListArray.from_arrays(at, pa.array(counts[row, b], pa.int64()))], names=[key, "b", "n"])

    def summed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, MOST_ROWS):
                keys, b, n = (batch.column(k).slice(at, MOST_ROWS) for k in range(3))
                cell = np.repeat(np.arange(len(keys)) * dim, np.asarray(b.value_lengths())) + np.asarray(b.flatten())
                yield _unit_length(keys, np.bincount(cell, np.asarray(n.flatten(), float), len(keys) * dim).reshape(len(keys), dim), key)

    if unique:
        return tokens.mapInArrow(vectors, f"{key} {kind}, vec array<double>")
    counts = tokens.mapInArrow(sparse, f"{key} {kind}, b array<int>, n array<long>")
    by = counts.groupBy(key).agg(F.flatten(F.collect_list("b")).alias("b"), F.flatten(F.collect_list("n")).alias("n"))
    return by.mapInArrow(summed, f"{key} {kind}, vec array<double>")


_LIVE: dict[str, Embedder] = {}


def filled(sizes: Iterable[int], most_texts: int = MOST_TEXTS, most_chars: int = MOST_CHARS, floor: int = FLOOR) -> Iterator[int]:
    """The numbers of texts in consecutive batches of texts of these lengths; a text counts with `floor` characters at least, and a
    batch is full with most_texts texts or with most_chars characters."""
    n = chars = 0
    for size in sizes:
        n, chars = n + 1, chars + max(size, floor)
        if n >= most_texts or chars >= most_chars:
            yield n
            n = chars = 0
    if n:
        yield n


def embed(texts: DataFrame, key: str, factory: Callable[[], Embedder], name: str, most_texts: int = MOST_TEXTS, most_chars: int = MOST_CHARS) -> DataFrame:
    """(key, vec) with any embedder, in batches of texts of like length.

    The whole table is laid in range partitions by length, so that batches pad little wherever texts come from; a partition's
    texts are filled into batches in that order, across Arrow batches, and only its last batch may be short.
    """
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterable[pd.DataFrame]):
        if name not in _LIVE:
            _LIVE[name] = factory()
        live = _LIVE[name]
        rest = pd.DataFrame({key: [], "text": []})

        def done(part: pd.DataFrame) -> pd.DataFrame:
            vecs = live.embed(part["text"].tolist())
            if len(vecs) != len(part):
                raise ValueError(f"{len(vecs)} vectors for {len(part)} texts")
            return pd.DataFrame({key: part[key].to_numpy(), "vec": [list(map(float, v)) for v in vecs]})

        for pdf in batches:
            rest = pd.concat([rest, pdf[[key, "text"]]], ignore_index=True) if len(rest) else pdf[[key, "text"]].reset_index(drop=True)
            at, sizes = 0, list(filled(rest["text"].str.len(), most_texts, most_chars))
            for n in sizes[:-1]:  # the last one may go on
                yield done(rest.iloc[at : at + n])
                at += n
            rest = rest.iloc[at:]
        at = 0
        for n in filled(rest["text"].str.len(), most_texts, most_chars):
            yield done(rest.iloc[at : at + n])
            at += n

    rows = texts.select(key, "text", F.length("text").alias("size")).repartitionByRange("size", key).sortWithinPartitions("size", key)
    raw = rows.select(key, "text").mapInPandas(run, f"{key} {kind}, vec array<double>")
    return raw.select(key, normalized(F.col("vec")).alias("vec"))


class Process:
    """A child process that reads {"id", "text"} and writes {"id", "vec"}, a JSON object a line."""

    def __init__(self, command: list[str]):
        self.command = command

    def embed(self, texts: list[str]) -> list[list[float]]:
        lines = "".join(json.dumps({"id": i, "text": t}) + "\n" for i, t in enumerate(texts))
        done = subprocess.run(self.command, input=lines, capture_output=True, text=True, check=True)
        found = {r["id"]: r["vec"] for r in map(json.loads, filter(None, done.stdout.splitlines()))}
        if set(found) != set(range(len(texts))):
            raise ValueError("the process gave unknown or missing ids")
        return [found[i] for i in range(len(texts))]


class OnnxDir:
    """An exported model: model.onnx, tokenizer.json and meta.json (max_seq, dim) in one folder; pooled output [batch, dim]."""

    def __init__(self, folder: str, max_tokens: int = 16_384, max_texts: int = 64):
        import onnxruntime
        from tokenizers import Tokenizer

        with open(f"{folder}/meta.json") as f:
            self.meta = json.load(f)
        self.tokenizer = Tokenizer.from_file(f"{folder}/tokenizer.json")
        self.tokenizer.enable_truncation(self.meta["max_seq"])
        self.session = onnxruntime.InferenceSession(f"{folder}/model.onnx", providers=["CPUExecutionProvider"])
        self.max_tokens, self.max_texts = max_tokens, max_texts

    def batches(self, sizes: list[int]) -> list[list[int]]:
        """Rows in groups of like length: at most max_texts each, at most max_tokens with padding."""
        out: list[list[int]] = []
        for i in sorted(range(len(sizes)), key=lambda i: sizes[i]):
            if not out or len(out[-1]) >= self.max_texts or (len(out[-1]) + 1) * sizes[i] > self.max_tokens:
                out.append([])
            out[-1].append(i)
        return out

    def embed(self, texts: list[str]) -> list[list[float]]:
        coded = [self.tokenizer.encode(t) for t in texts]
        out: list[list[float]] = [[] for _ in texts]
        names = [x.name for x in self.session.get_inputs()]
        for rows in self.batches([len(c.ids) for c in coded]):
            width = max(len(coded[i].ids) for i in rows)
            ids, mask = np.zeros((len(rows), width), np.int64), np.zeros((len(rows), width), np.int64)
            for k, i in enumerate(rows):
                n = len(coded[i].ids)
                ids[k, :n], mask[k, :n] = coded[i].ids, 1
            got = self.session.run(None, dict(zip(names, (ids, mask))))[0]
            if got.shape != (len(rows), self.meta["dim"]):
                raise ValueError(f"the model gave {got.shape}, not {(len(rows), self.meta['dim'])}")
            for k, i in enumerate(rows):
                out[i] = got[k].tolist()
        return out
