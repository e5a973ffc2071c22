"""Helpers shared by the operators: words, keys of texts, and (from the library) joins that no hot key can slow down.

Words are runs of anything but space and the controls 0x09-0x0D.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinspect.operators.joins import HEAVY_KEYS, heavy_from, join_heavy

__all__ = ["HEAVY_KEYS", "heavy_from", "join_heavy"]

GAP = r"[\x20\x09-\x0D]+"
#: The same class for str.translate, and for Python regular expressions.
GAP_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"
WORD_RE = re.compile(r"[^\x20\x09-\x0D]+")


def word_list(text: Column) -> Column:
    """The words of a text; null and empty texts have none. A split leaves an empty piece at most at either end."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def n_chars_of(text: Column, chars: str) -> Column:
    """How many characters of the text belong to chars."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def text_key(text: Column) -> dict[str, Column]:
    """Two hashes, of 128 bits together, that stand for a text."""
    t = F.coalesce(text, F.lit(""))
    return {"k1": F.xxhash64(t), "k2": F.xxhash64(F.lit(1), t)}
