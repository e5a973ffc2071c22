"""Vector expressions and codecs: dot product, unit length, little-endian float bytes, packed matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, summed in double from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, then) -> Column:
    """then(value) with the value computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def normalized(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    wide = F.transform(v, lambda x: x.cast("double"))
    scaled = lambda w, n: F.when(n > 0, F.transform(w, lambda x: x / n)).otherwise(w)
    return let(wide, lambda w: let(F.sqrt(dot(w, w)), lambda n: scaled(w, n)))


def to_bytes(vec) -> bytes:
    return np.asarray(vec, "<f4").tobytes()


def from_bytes(blob: bytes) -> np.ndarray:
    if len(blob) % 4:
        raise ValueError(f"{len(blob)} bytes are no vector of floats")
    return np.frombuffer(blob, "<f4")


def packed(vectors) -> np.ndarray | None:
    """A row-major matrix of double, or None if there is no row, no dimension, or rows of several widths."""
    rows = [np.asarray(v, float) for v in vectors]
    if not rows or not len(rows[0]) or any(len(r) != len(rows[0]) for r in rows):
        return None
    return np.stack(rows)
