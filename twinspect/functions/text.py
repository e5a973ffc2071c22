"""Column expressions over unit texts, paths, labels and selectors; each has no state and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIRECTIVE = "twinspect:ignore"

# File extensions and the language of each.
LANGUAGES = {
    "rs": "rust", "ts": "typescript", "tsx": "typescript", "py": "python", "go": "go", "java": "java", "cs": "csharp", "php": "php", "rb": "ruby", "c": "c",
    "h": "cpp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp",
}
# How a path shows that it holds tests.
TEST_PARTS = ["/tests/", ".test.", ".spec.", "__tests__", "/test_", "/src/test/", "/conftest", "/spec/", ".Tests/"]
TEST_ENDS = ["_test.rs", "tests.rs", "_test.go", "_test.py", "_spec.rb", "_test.rb", "Test.php", "Tests.cs"]
# Names of languages in fenced code, and in a terminal highlighter.
FENCE_NAMES = {"csharp": "csharp", "cpp": "cpp", "c": "c", "go": "go", "java": "java", "php": "php", "python": "python", "ruby": "ruby", "rust": "rust", "typescript": "typescript"}
HIGHLIGHT_NAMES = {"csharp": "cs", "cpp": "cpp", "c": "c", "go": "go", "java": "java", "php": "php", "python": "py", "ruby": "rb", "rust": "rs", "typescript": "ts"}
# Characters of lines that only structure code.
STRUCTURAL = r"^[{}\[\]();,:.]*$"
EXCLUDED = ["/.git/"]


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def lines_of(text: Column) -> Column:
    """Lines without their ends: a last empty piece doesn't count, a carriage return before a line feed belongs to the end."""
    pieces = F.split(text, "\n")
    whole = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)
    return F.transform(whole, lambda x: F.regexp_replace(x, r"\r$", ""))


def effective_lines(text: Column) -> Column:
    """Lines that are neither blank nor made of brackets and separators alone."""
    bare = F.transform(lines_of(text), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.size(F.filter(bare, lambda x: (x != "") & ~x.rlike(STRUCTURAL)))


def doc_stripped(text: Column) -> Column:
    """The text without doc comments (///, //!, /** */, /*! */), whole lines at a time; other comments stay."""
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("out"))

    def step(acc, line):
        s = F.regexp_replace(line, r"^\s+", "")
        closes = line.contains("*/")
        opens = s.startswith("/**") | s.startswith("/*!")
        drop = acc["inside"] | opens | s.startswith("///") | s.startswith("//!")
        inside = F.when(acc["inside"], ~closes).otherwise(opens & ~closes)
        return F.struct(inside.alias("inside"), F.when(drop, acc["out"]).otherwise(F.concat(acc["out"], F.array(line))).alias("out"))

    return F.array_join(F.aggregate(lines_of(text), start, step)["out"], "\n")


def embed_text(text: Column) -> Column:
    """What is embedded: the doc-stripped text, or the text itself where nothing is left."""
    stripped = doc_stripped(text)
    return F.when(F.trim(stripped) == "", text).otherwise(stripped)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def language(path: Column) -> Column:
    """By extension; null for others."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, extension(path))


def root_language(path: Column) -> Column:
    """As root detection counts files: C++ and headers are one language, written c++."""
    return F.when(language(path) == "cpp", "c++").otherwise(language(path))


def is_test_path(path: Column) -> Column:
    out = F.lit(False)
    for part in TEST_PARTS:
        out = out | path.contains(part)
    for end in TEST_ENDS:
        out = out | path.endswith(end)
    return out


def is_excluded(path: Column, patterns: list[str] | None = None) -> Column:
    out = F.lit(False)
    for part in EXCLUDED + list(patterns or []):
        out = out | path.contains(part)
    return out


def has_directive(lines: Column, start_line: Column, directive: str = DIRECTIVE) -> Column:
    """Whether the directive stands on the 1-based line or one of the three above."""
    first = F.greatest(start_line - 3, F.lit(1))
    return F.exists(F.slice(lines, first, start_line - first + 1), lambda x: x.contains(directive))


def label(path: Column, start: Column, end: Column, name: Column, kind: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(" "), name, F.when(kind == "block", " [block]").otherwise(""))


def paths_equal(a: Column, b: Column) -> Column:
    """Equal but for leading ./, or one a suffix of the other from a slash on."""
    a, b = F.regexp_replace(a, r"^(\./)+", ""), F.regexp_replace(b, r"^(\./)+", "")
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


SELECTOR = r"^((?:(?!::)[\s\S])*?)(?::(\d+)-(\d+))?::([\s\S]*)$"


def selector(text: Column) -> dict[str, Column]:
    """path, lo, hi, name of `path[:lo-hi]::name`; null where the text is none."""
    ok = text.rlike(SELECTOR)
    part = lambda k: F.when(ok, F.regexp_extract(text, SELECTOR, k))
    return {"path": part(1), "lo": part(2).try_cast("int"), "hi": part(3).try_cast("int"), "name": part(4)}


def hunk_range(header: Column) -> dict[str, Column]:
    """lo, hi of the new side of a hunk header; null if it adds no line or cannot be read."""
    at = F.regexp_extract(header, r"\+(\d+)", 1).try_cast("long")
    n = F.regexp_extract(header, r"\+\d+,(\d+)", 1).try_cast("long")
    n = F.coalesce(n, F.when(~header.rlike(r"\+\d+,"), F.lit(1)))
    ok = n > 0
    return {"lo": F.when(ok, at), "hi": F.when(ok, at + n - 1)}


def fence(text: Column) -> Column:
    """Backticks for a code fence: one more than the longest run inside, three at least."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), lambda x: F.length(x))
    return F.repeat(F.lit("`"), F.greatest(F.coalesce(F.array_max(runs), F.lit(0)), F.lit(2)) + 1)


def markdown_escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def _replaced(text: Column, table: list[tuple[str, str]]) -> Column:
    for a, b in table:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


# Escapes of workflow commands, the percent sign first.
MESSAGE_ESCAPES = [("%", "%25"), ("\r", "%0D"), ("\n", "%0A")]
PROPERTY_ESCAPES = [*MESSAGE_ESCAPES, (":", "%3A"), (",", "%2C")]


def message_escaped(text: Column) -> Column:
    return _replaced(text, MESSAGE_ESCAPES)


def property_escaped(text: Column) -> Column:
    return _replaced(text, PROPERTY_ESCAPES)


def label_parts(text: Column) -> dict[str, Column]:
    """path, start, end, name of a label; null where it is none."""
    pattern = r"^(.*):(\d+)-(\d+)\s+(.*)$"
    ok = text.rlike(pattern)
    part = lambda k: F.when(ok, F.regexp_extract(text, pattern, k))
    return {"path": part(1), "start": part(2).try_cast("int"), "end": part(3).try_cast("int"), "name": part(4)}
