"""Function and block units of source files. Each language has a scanner over masked text; Python is parsed.

Limits against a grammar: macros that open braces unevenly, old-style C definitions, and functions whose header spans a
preprocessor condition may be missed; an arrow function without braces ends at its line. A file that a scanner cannot
make sense of gives the units found so far and never fails.
"""

from __future__ import annotations

import ast
import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass, field

from twinspect.functions.text import DIRECTIVE, LANGUAGES, STRUCTURAL, TEST_ENDS, TEST_PARTS
from twinspect.sources.lexer import mask

MIN_BLOCK_LINES = 8
FUNCTION, BLOCK = "function", "block"


@dataclass(frozen=True)
class ExtractOptions:
    granularity: tuple[str, ...] = (FUNCTION, BLOCK)
    min_block_lines: int = MIN_BLOCK_LINES
    strip_comments: bool = False
    directive: str = DIRECTIVE

    def __post_init__(self):
        if unknown := set(self.granularity) - {FUNCTION, BLOCK}:
            raise ValueError(f"unknown unit kinds: {sorted(unknown)}")


@dataclass
class Found:
    """A unit as offsets into the source."""

    name: str
    start: int
    end: int
    body: tuple[int, int] | None
    kind: str = FUNCTION
    is_test: bool = False
    blocks: list["Found"] = field(default_factory=list)


_CONTROL = frozenset("if else for foreach while switch do try catch finally return synchronized sizeof throw new class struct enum union namespace interface lock using fixed unsafe".split())
_HEADS = {
    "rust": re.compile(r"(?P<lead>(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s*\"?\w*\"?)?)\s+)*)fn\s+(?P<name>\w+)"),
    "go": re.compile(r"func\s*(?:\([^)]*\)\s*)?(?P<name>\w+)\s*[\[(]"),
    "php": re.compile(r"(?:(?:public|protected|private|static|final|abstract|readonly)\s+)*function\s+&?\s*(?P<name>\w+)\s*\("),
    "typescript": re.compile(
        r"(?:(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+))"
        r"|(?P<var>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b[^{]*|(?:<(?:[^{}]|\{[^{}]*\})*>\s*)?(?:\((?:[^{}]|\{[^{}]*\})*\)|[\w$]+)\s*(?::[^={}]+)?=>\s*)$"
        r"|(?:(?:public|private|protected|static|readonly|async|get|set|override|abstract)\s+)*[*#]?(?P<method>[\w$]+)\s*(?:<[^{}]*>)?\s*\((?:[^{}]|\{[^{}]*\})*\)\s*(?::[^{}]+)?$"
    ),
    "java": re.compile(r"(?:[\w<>\[\],.?@&\s]*?[\w>\]]\s+)?(?P<name>\w+)\s*\([^{}]*\)\s*(?:throws[\w\s.,]+)?$"),
    "csharp": re.compile(r"(?:[\w<>\[\],.?()\s]*?[\w>\]?)]\s+)?(?P<name>\w+)\s*(?:<(?:[^<>{}()]|<[^<>{}()]*>)*>)?\s*\([^{}]*\)\s*(?::\s*(?:base|this)\s*\([^{}]*\)\s*)?(?:where[^{}]+)?$"),
    "c": re.compile(r"[\w\s*&:<>,~\[\]]*?(?P<name>~?\w+(?:::~?\w+)*|operator\s*\S+)\s*\([^;{}]*\)\s*(?:(?:const|noexcept|override|final|mutable|volatile|&&?)\s*|->\s*[\w:<>*&\s]+)*(?::[^;{}]*)?$"),
}
_HEADS["cpp"] = _HEADS["c"]
_BLOCK_WORDS = re.compile(r"\b(if|else|for|foreach|while|loop|match|switch|try|catch|finally|do)\b")
_ATTRIBUTE = {"rust": re.compile(r"#!?\[[^\]]*\]\s*"), "csharp": re.compile(r"\[[^\]]*\]\s*"), "php": re.compile(r"#\[[^\]]*\]\s*"), "java": re.compile(r"@\w+(?:\.\w+)*(?:\s*\([^)]*\))?\s*")}


def _head_start(masked: str, open_: int, floor: int) -> int:
    """Where the statement that owns the brace begins: behind the last ; { or } outside parentheses."""
    depth, k = 0, open_ - 1
    while k >= floor:
        c = masked[k]
        if c in ")]":
            depth += 1
        elif c in "([":
            if depth == 0:
                break
            depth -= 1
        elif depth <= 0 and c in ";{}":
            break
        k -= 1
    return k + 1


def _brace_units(src: str, masked: str, lang: str) -> list[Found]:
    found: list[Found] = []
    stack: list[tuple[int, Found | None, str | None]] = []  # open brace, what it belongs to, name of a test module
    tests = 0
    for m in re.finditer(r"[{}]", masked):
        at = m.start()
        if m[0] == "}":
            if stack:
                open_, unit, module = stack.pop()
                if unit is not None:
                    unit.end, unit.body = at + 1, (open_, at + 1)
                if module == "tests":
                    tests -= 1
            continue
        head_at = _head_start(masked, at, stack[-1][0] + 1 if stack else 0)
        head = masked[head_at:at]
        lead = len(head) - len(head.lstrip())
        attrs = ""
        while lang in _ATTRIBUTE and (a := _ATTRIBUTE[lang].match(head, lead)):
            attrs += src[head_at + a.start() : head_at + a.end()]
            if lang == "rust" or lang == "php":
                lead = a.end()
            else:
                break
        skip = _ATTRIBUTE[lang].match(head, lead).end() if lang in ("java", "csharp") and _ATTRIBUTE[lang].match(head, lead) else lead
        while lang in ("java", "csharp") and (a := _ATTRIBUTE[lang].match(head, skip)):
            attrs += src[head_at + a.start() : head_at + a.end()]
            skip = a.end()
        text = head[skip:].rstrip()
        if lang in ("c", "cpp"):
            text = re.sub(r"^(?:\s*#[^\n]*\n)+", lambda x: " " * len(x[0]), text)
            shift = len(text) - len(text.lstrip())
            lead, text = lead + shift, text.lstrip()
            public = re.match(r"(?:public|private|protected)\s*:\s*(?!:)", text)
            if public:
                lead, text = lead + public.end(), text[public.end() :]
            template = re.match(r"template\s*<[^{}]*?>\s*(?=[\w~])", text)
            body_text = text[template.end() :] if template else text
        else:
            body_text = text
        owner = next((u for _, u, _ in reversed(stack) if u is not None and u.kind == FUNCTION), None)
        unit = _function(src, lang, head_at, lead, body_text, attrs, stack, owner, skip if lang in ("java", "csharp") else lead)
        module = None
        if lang == "rust" and (mm := re.search(r"\bmod\s+(\w+)\s*$", text)):
            module = mm[1]
            tests += module == "tests"
        if unit is not None:
            unit.is_test = unit.is_test or tests > 0
            found.append(unit)
            unit.blocks.append(Found(f"{unit.name}::body", at, at + 1, None, BLOCK))
            stack.append((at, unit, module))
        elif owner is not None and (lang == "rust" or not re.search(r"(?:=|\(|,|\breturn|:)\s*$", text)):  # else a value in braces
            word = _BLOCK_WORDS.findall(re.sub(r"\([^()]*\)", "", text) or "")
            name = {"foreach": "for", "switch": "match", "finally": "body", "do": "loop"}.get(word[0], word[0]) if word else ("closure" if text.endswith(("|", "=>")) else "block")
            if text.startswith("else") or re.match(r"\}?\s*else\b", text):
                name = "else"
            block = Found(f"{owner.name}::{name}", at, at + 1, None, BLOCK)
            owner.blocks.append(block)
            stack.append((at, block, module))
        else:
            stack.append((at, None, module))
    for u in found:
        if u.body:
            u.blocks[0].start, u.blocks[0].end, u.blocks[0].body = u.body[0], u.body[1], u.body
    return [u for u in found if u.body is not None]


def _function(src, lang, head_at, lead, text, attrs, stack, owner, skip) -> Found | None:
    pattern = _HEADS.get(lang)
    if pattern is None or not text:
        return None
    if lang in ("rust", "go", "php"):
        m = pattern.search(text)
        if lang == "go":  # statements end with their lines there
            m = max((x for x in pattern.finditer(text) if x.start() == 0 or text[: x.start()].endswith("\n")), key=lambda x: x.start(), default=None)
        if not m or (lang == "php" and text.endswith("=")):
            return None
        name = m["name"]
        start = head_at + skip + m.start()
        test = "test" in attrs if lang == "rust" else name.startswith("test") if lang == "php" else False
        return Found(name, start, start, None, is_test=test)
    if lang == "typescript":
        in_class = bool(stack) and stack[-1][1] is None
        m = pattern.search(text)
        if not m:
            return None
        name = m["name"] or m["var"] or m["method"]
        if name in _CONTROL or (m["method"] and (not in_class or m.start() != 0)):
            return None
        return Found(name, head_at + skip + m.start(), 0, None)
    if "=" in re.sub(r"\([^{}]*\)|operator\s*\S+|[<>=!]=", "", text) and lang != "csharp":
        return None
    m = pattern.match(text)
    if not m or m["name"].split("::")[-1] in _CONTROL or re.match(r"(?:class|struct|enum|namespace|interface|union|record)\b", text) or re.search(r"\b(?:new|return|else)\b", text[: m.start("name")]):
        return None
    if lang == "java" and owner is not None and stack and stack[-1][1] is not None and not re.search(r"\w\s+\w+\s*\(", text):
        return None
    start = head_at + lead
    if lang == "java":
        test = any(x.lstrip().startswith("@") and "Test" in x for x in (attrs + text[: m.start("name")]).splitlines())
    elif lang == "csharp":
        test = any(w in attrs for w in ("Test", "Fact", "Theory"))
    else:
        test = False
    return Found(m["name"].split("::")[-1], start, start, None, is_test=test)


def _arrow_bodies(src: str, masked: str, lang: str) -> list[Found]:
    """Functions without braces: arrow functions of one expression, expression-bodied C# methods."""
    out = []
    if lang == "typescript":
        for m in re.finditer(r"\b(?:const|let|var)\s+([\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^{}()]*\)|[\w$]+)\s*(?::[^={}\n]+)?=>\s*(?=[^\s{])", masked):
            end = min((x for x in (masked.find(";", m.end()), masked.find("\n", m.end())) if x >= 0), default=len(masked))
            out.append(Found(m[1], m.start(1), end, (m.end(), end)))
    elif lang == "csharp":
        for m in re.finditer(r"(?m)^[ \t]*((?:[\w<>\[\],.?]+\s+)+(\w+)\s*(?:<[^{}()]*>)?\s*\([^{}()]*\)\s*)=>", masked):
            end = masked.find(";", m.end())
            end = len(masked) if end < 0 else end + 1
            out.append(Found(m[2], m.start(1), end, (m.end(), end)))
    return out


def _offsets(src: str):
    """A function from the parser's line and column, which counts UTF-8 bytes, to the offset in src."""
    starts = [0, *(m.end() for m in re.finditer(r"\r\n?|\n", src)), len(src)]

    def at(line: int, col: int) -> int:
        if line >= len(starts):
            return len(src)
        text = src[starts[line - 1] : starts[line]]
        return starts[line - 1] + (col if text.isascii() else len(text.encode("utf-8", "surrogatepass")[:col].decode("utf-8", "replace")))

    return at


def _python_units(src: str) -> list[Found]:
    at = _offsets(src)
    found: list[Found] = []

    def span(stmts) -> tuple[int, int]:
        first = min([stmts[0].lineno, *(d.lineno for d in getattr(stmts[0], "decorator_list", []))])
        col = stmts[0].col_offset
        return at(first, col), at(stmts[-1].end_lineno, stmts[-1].end_col_offset)

    def walk(node, owner: Found | None) -> None:
        for child in ast.iter_child_nodes(node):
            here = owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                start = at(first, child.col_offset)
                here = Found(child.name, start, at(child.end_lineno, child.end_col_offset), span(child.body), is_test=child.name.startswith("test"))
                here.blocks.append(Found(f"{child.name}::body", *span(child.body), span(child.body), BLOCK))
                found.append(here)
            elif owner is not None and isinstance(child, ast.stmt):
                kinds = [("body", {ast.If: "if", ast.For: "for", ast.AsyncFor: "for", ast.While: "while", ast.Try: "try", ast.With: "body", ast.AsyncWith: "body"}.get(type(child)))]
                if not (isinstance(child, ast.If) and len(child.orelse) == 1 and isinstance(child.orelse[0], ast.If) and src[at(child.orelse[0].lineno, child.orelse[0].col_offset) :].startswith("elif")):
                    kinds.append(("orelse", "else"))
                kinds.append(("finalbody", "body"))
                for attr, name in kinds:
                    stmts = getattr(child, attr, None)
                    if name and isinstance(stmts, list) and stmts and not isinstance(child, (ast.ClassDef,)):
                        owner.blocks.append(Found(f"{owner.name}::{name}", *span(stmts), span(stmts), BLOCK))
            elif owner is not None and isinstance(child, ast.ExceptHandler):
                owner.blocks.append(Found(f"{owner.name}::catch", *span(child.body), span(child.body), BLOCK))
            walk(child, here)

    walk(ast.parse(src), None)
    return found


def _indented_units(src: str, masked: str) -> list[Found]:
    """Python that does not parse: a function reaches to the next line that is not indented deeper."""
    lines, out, at = masked.splitlines(keepends=True), [], 0
    offsets = []
    for x in lines:
        offsets.append(at)
        at += len(x)
    for i, line in enumerate(lines):
        m = re.match(r"([ \t]*)(?:async\s+)?def\s+(\w+)", line)
        if not m:
            continue
        j = last = i
        for j in range(i + 1, len(lines)):
            if lines[j].strip():
                if len(lines[j]) - len(lines[j].lstrip()) <= len(m[1]):
                    break
                last = j
        end = offsets[last] + len(lines[last].rstrip())
        body = (offsets[min(i + 1, last)], end)
        out.append(Found(m[2], offsets[i] + len(m[1]), end, body, is_test=m[2].startswith("test")))
    return out


_RUBY = re.compile(r"(?m)(?<![\w.:@$])(?:(?P<def>def\s+(?:self\.|\w+\.)?(?P<name>[\w?!=\[\]<>+\-*/%~^&|]+))|(?P<open>(?:class|module|begin|case)\b|do\b)|(?P<line>(?<=\n)[ \t]*(?:if|unless|while|until|for)\b|^(?:if|unless|while|until|for)\b)|(?P<assigned>=\s*(?:if|unless|while|case|begin)\b)|(?P<end>end\b))")


def _ruby_units(src: str, masked: str) -> list[Found]:
    out, stack = [], []
    loop_do = False
    for m in _RUBY.finditer(masked):
        if m["end"]:
            if stack and (unit := stack.pop()) is not None:
                unit.end = m.end()
                unit.body = (unit.body[0], m.start())
                out.append(unit)
        elif m["def"]:
            line_end = masked.find("\n", m.end())
            line_end = len(masked) if line_end < 0 else line_end
            rest = masked[m.end() : line_end]
            unit = Found(m["name"], m.start(), 0, (line_end, line_end), is_test=m["name"].startswith("test_"))
            if re.match(r"\s*(?:\([^)]*\))?\s*=(?!=)", rest):  # an endless method
                unit.end, unit.body = line_end, (m.end(), line_end)
                out.append(unit)
            else:
                stack.append(unit)
        elif m["line"]:
            stack.append(None)
            loop_do = bool(re.search(r"\b(?:while|until|for)$", m[0]))
            loop_line = masked.find("\n", m.end())
        elif m["open"] == "do" and loop_do and (loop_line < 0 or m.start() < loop_line):
            loop_do = False  # belongs to the loop
        else:
            stack.append(None)
    return sorted(out, key=lambda u: u.start)


def language_of(path: str) -> str | None:
    return LANGUAGES.get(path.rsplit(".", 1)[-1]) if "." in path.rsplit("/", 1)[-1] else None


def is_test_path(path: str) -> bool:
    return any(p in path for p in TEST_PARTS) or any(path.endswith(e) for e in TEST_ENDS)


def _docstrings(src: str) -> list[tuple[int, int]]:
    at = _offsets(src)
    try:
        parsed = ast.parse(src)
    except (SyntaxError, ValueError):
        return []
    out = []
    for node in ast.walk(parsed):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            first = node.body[0]
            if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
                out.append((at(first.lineno, first.col_offset), at(first.end_lineno, first.end_col_offset)))
    return out


def cut_out(src: str, start: int, end: int, spans: list[tuple[int, int]]) -> str:
    """src[start:end] without the spans; if any is inside, lines are right-trimmed and empty ones go."""
    inside = sorted((max(a, start), min(b, end)) for a, b in spans if a < end and b > start)
    if not inside:
        return src[start:end]
    out, at = [], start
    for a, b in inside:
        if a > at:
            out.append(src[at:a])
        at = max(at, b)
    out.append(src[at:end])
    return "\n".join(x.rstrip() for x in "".join(out).split("\n") if x.strip())


def effective_lines(text: str) -> int:
    return sum(1 for x in text.split("\n") if x.strip() and not re.match(STRUCTURAL, x.strip()))


def units_of(path: str, src: str, options: ExtractOptions = ExtractOptions()) -> list[dict]:
    """The units of one file, in order of their start; functions come before their own blocks."""
    lang = language_of(path)
    if lang is None:
        return []
    masked, comments = mask(src, lang)
    cuts = list(comments)
    if lang == "python":
        try:
            found = _python_units(src)
        except (SyntaxError, ValueError, RecursionError):
            found = _indented_units(src, masked)
        cuts += _docstrings(src)
    elif lang == "ruby":
        found = _ruby_units(src, masked)
    else:
        found = sorted(_brace_units(src, masked, lang) + _arrow_bodies(src, masked, lang), key=lambda u: u.start)
    lines = src.split("\n")
    ends = [m.start() for m in re.finditer("\n", src)]
    path_test, out = is_test_path(path), []
    for unit in found:
        for part in (unit, *unit.blocks) if BLOCK in options.granularity else (unit,):
            if part.kind not in options.granularity:
                continue
            first = bisect_left(ends, part.start) + 1
            last = bisect_left(ends, max(part.start, part.end - 1)) + 1
            if part.kind == BLOCK and last - first + 1 < options.min_block_lines:
                continue
            text = cut_out(src, part.start, part.end, cuts) if options.strip_comments else src[part.start : part.end]
            if not text.strip():
                continue
            body = part.body or (part.start, part.end)
            head = bisect_left(ends, unit.start) + 1
            out.append({
                "path": path, "name": part.name, "lang": lang, "unit_kind": part.kind, "start_line": first, "end_line": last,
                "effective_lines": effective_lines(cut_out(src, *body, cuts)), "hash": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), "text": text,
                "ignored": any(options.directive in x for x in lines[max(0, head - 4) : head]), "is_test": path_test or unit.is_test,
            })
    return out
