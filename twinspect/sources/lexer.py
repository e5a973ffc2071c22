"""Masks: the text with strings and comments blanked out, at equal length, so that structure can be read with patterns."""

from __future__ import annotations

import re

_NUMBER_SIGN = ("php",)
_RAW_RUST = re.compile(r'b?r(#*)"')
_CHAR_RUST = re.compile(r"'(?:\\[^\n]{1,9}?|[^'\\\n])'")
_REGEX_BEFORE = frozenset("(,=:[!&|?{};+-*%~^<>\n")


def mask(src: str, lang: str) -> tuple[str, list[tuple[int, int]]]:
    """(masked text, spans of comments). Line ends stay; quotes, contents and comments become spaces."""
    out, comments, i, n = list(src), [], 0, len(src)

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    def comment(a: int, b: int) -> int:
        blank(a, b)
        comments.append((a, min(b, n)))
        return b

    def quoted(at: int, quote: str, escapes: bool, lines: bool) -> int:
        k = at
        while k < n:
            if escapes and src[k] == "\\":
                k += 2
                continue
            if src.startswith(quote, k):
                return k + len(quote)
            if src[k] == "\n" and not lines:
                return k
            k += 1
        return n

    last = "\n"
    while i < n:
        c = src[i]
        if lang in ("python", "ruby"):
            if c == "#":
                end = src.find("\n", i)
                i = comment(i, n if end < 0 else end)
                continue
            if lang == "ruby" and src.startswith("=begin", i) and (i == 0 or src[i - 1] == "\n"):
                end = src.find("\n=end", i)
                i = comment(i, n if end < 0 else end + 5)
                continue
            if lang == "python" and src[i : i + 3] in ('"""', "'''"):
                end = quoted(i + 3, src[i : i + 3], True, True)
                blank(i, end)
                i = end
                continue
        elif src.startswith("//", i) or (c == "#" and lang in _NUMBER_SIGN and not src.startswith("#[", i)):
            end = src.find("\n", i)
            i = comment(i, n if end < 0 else end)
            continue
        elif src.startswith("/*", i):
            depth, k = 1, i + 2
            while k < n and depth:
                if lang == "rust" and src.startswith("/*", k):
                    depth, k = depth + 1, k + 2
                elif src.startswith("*/", k):
                    depth, k = depth - 1, k + 2
                else:
                    k += 1
            i = comment(i, k)
            continue
        if lang == "rust" and (m := _RAW_RUST.match(src, i)) and not (i and (src[i - 1].isalnum() or src[i - 1] == "_")):
            end = quoted(m.end(), '"' + m[1], False, True)
        elif lang == "rust" and c == "'":
            m = _CHAR_RUST.match(src, i)
            end = m.end() if m else i + 1  # else a lifetime
        elif lang == "csharp" and (src.startswith('@"', i) or src.startswith('$@"', i)):
            k = src.index('"', i) + 1
            while True:
                k = quoted(k, '"', False, True)
                if k < n and src[k] == '"':
                    k += 1
                    continue
                break
            end = k
        elif c == "`" and lang in ("typescript", "go"):
            end = quoted(i + 1, "`", lang == "typescript", True)
        elif c == '"' or (c == "'" and lang != "rust"):
            end = quoted(i + 1, c, True, lang in ("rust", "php", "ruby"))
        elif c == "/" and lang == "typescript" and last in _REGEX_BEFORE:
            k, inside = i + 1, False
            while k < n and src[k] != "\n" and (src[k] != "/" or inside):
                if src[k] == "\\":
                    k += 1
                elif src[k] in "[]":
                    inside = src[k] == "["
                k += 1
            end = k + 1 if k < n and src[k] == "/" else i + 1
        else:
            if not c.isspace():
                last = c
            i += 1
            continue
        if end > i + 1:
            blank(i, end)
        last = '"'
        i = max(end, i + 1)
    return "".join(out), comments
