"""Terms of texts as bytes: runs of 0-9, a-z and whatever isn't ASCII, A-Z lower-cased; and text batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

#: Keeps digits, a-z and bytes from 0x80 on, lowers A-Z, and turns everything else into a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order; null has none."""
    return text.translate(_TABLE).split() if text else []


class Numbers(dict):
    """Numbers things from 0 in the order in which they are first asked for."""

    def __missing__(self, thing) -> int:
        n = self[thing] = len(self)
        return n


def chunks(batches, most_rows: int, most_words: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(ids, terms of each text) of rows (id, text as bytes), for at most so many rows and, but for one long text, words."""
    ids, texts, words = [], [], 0
    for batch in batches:
        for one, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = terms_of(text.as_py())
            if ids and (len(ids) >= most_rows or words + len(found) > most_words):
                yield ids, texts
                ids, texts, words = [], [], 0
            ids.append(one)
            texts.append(found)
            words += len(found)
    if ids:
        yield ids, texts
