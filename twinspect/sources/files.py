"""Source trees: listing with ignore rules, reading through Spark, root detection, git diffs, manifests, aliases, config."""

from __future__ import annotations

import fnmatch
import json
import os
import re
import subprocess
import tomllib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspect.functions.text import EXCLUDED, LANGUAGES
from twinspect.sources.units import ExtractOptions, language_of, units_of

UNIT_SCHEMA = "path string, name string, lang string, unit_kind string, start_line int, end_line int, effective_lines int, hash string, text string, ignored boolean, is_test boolean"


def excluded(path: str, patterns: list[str] = ()) -> bool:
    return any(p in path for p in (*EXCLUDED, *patterns))


class IgnoreRules:
    """One .gitignore: the last pattern that matches decides."""

    def __init__(self, base: str, text: str):
        self.base, self.rules = base, []
        for line in text.splitlines():
            line = line.rstrip("\r")
            if not line.endswith("\\ "):
                line = line.rstrip(" ")
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            body = line[1:] if negated else line[1:] if line[:2] in ("\\#", "\\!") else line
            only_dirs = body.endswith("/")
            body = body.rstrip("/")
            anchored = "/" in body
            self.rules.append((negated, only_dirs, re.compile(self.translate(body.lstrip("/"), anchored))))

    @staticmethod
    def translate(pattern: str, anchored: bool) -> str:
        out, i = "" if anchored else r"(?:.*/)?", 0
        while i < len(pattern):
            if pattern.startswith("**/", i):
                out, i = out + r"(?:.*/)?", i + 3
            elif pattern.startswith("**", i):
                out, i = out + ".*", i + 2
            elif pattern[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif pattern[i] == "?":
                out, i = out + "[^/]", i + 1
            elif pattern[i] == "[" and (m := re.match(r"\[[!^]?\]?[^\]]*\]", pattern[i:])):
                out, i = out + fnmatch.translate(m[0].replace("[^", "[!")).removeprefix("(?s:").split(")")[0], i + len(m[0])
            else:
                c = pattern[i + 1] if pattern[i] == "\\" and i + 1 < len(pattern) else pattern[i]
                out, i = out + re.escape(c), i + (2 if pattern[i] == "\\" else 1)
        return out + r"\Z"

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        rel = os.path.relpath(path, self.base).replace(os.sep, "/")
        found = None
        for negated, only_dirs, rule in self.rules:
            if (is_dir or not only_dirs) and rule.match(rel):
                found = not negated
        return found


def _rules_above(root: str) -> list[IgnoreRules]:
    out, at = [], Path(root).resolve()
    for folder in reversed([*at.parents]):
        if (f := folder / ".gitignore").is_file():
            out.append(IgnoreRules(str(folder), f.read_text(errors="replace")))
    for folder in (at, *at.parents):
        if (f := folder / ".git/info/exclude").is_file():
            out.append(IgnoreRules(str(folder), f.read_text(errors="replace")))
            break
    return out


def walk(root: str, patterns: list[str] = (), respect_gitignore: bool = True) -> Iterator[str]:
    """Supported files below root (or root itself), hidden ones included; excluded and ignored folders aren't entered."""

    def visit(folder: str, rules: list[IgnoreRules]) -> Iterator[str]:
        if respect_gitignore and os.path.isfile(f := os.path.join(folder, ".gitignore")):
            rules = [*rules, IgnoreRules(os.path.realpath(folder), Path(f).read_text(errors="replace"))]
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            is_dir = e.is_dir(follow_symlinks=False)
            if excluded(e.path + ("/" if is_dir else ""), patterns):
                continue
            real = os.path.join(os.path.realpath(folder), e.name)
            verdict = next((v for r in reversed(rules) if (v := r.verdict(real, is_dir)) is not None), False)
            if verdict:
                continue
            if is_dir:
                yield from visit(e.path, rules)
            elif language_of(e.path):
                yield e.path

    if os.path.isfile(root):
        if language_of(root) and not excluded(root, patterns):
            yield root
    else:
        yield from visit(root, _rules_above(root) if respect_gitignore else [])


def extract_sources(sources: DataFrame, options: ExtractOptions = ExtractOptions()) -> DataFrame:
    """Units of rows (path, content: binary); what is not UTF-8 or of no known language gives none."""

    def run(batches):
        names = [c.split()[0] for c in UNIT_SCHEMA.split(", ")]
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    out += units_of(path, bytes(content).decode("utf-8"), options)
                except UnicodeDecodeError:
                    continue
            yield pd.DataFrame(out, columns=names)

    return sources.select("path", "content").mapInPandas(run, UNIT_SCHEMA)


def extract_roots(spark: SparkSession, roots: list[str], patterns: list[str] = (), respect_gitignore: bool = True, options: ExtractOptions = ExtractOptions()) -> DataFrame:
    """Units of local trees. Paths are listed on the driver, files are read where they are parsed, so trees must be on a
    path that executors share; for other stores read them with read_tree()."""
    paths = sorted({p for r in roots for p in walk(r, list(patterns), respect_gitignore)})
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism)))

    def read(batches):
        for pdf in batches:
            found = []
            for p in pdf["path"]:
                try:
                    found.append((p, Path(p).read_bytes()))
                except OSError:
                    continue
            yield pd.DataFrame(found, columns=["path", "content"])

    return extract_sources(rows.mapInPandas(read, "path string, content binary"), options)


def read_tree(spark: SparkSession, folder: str, patterns: list[str] = ()) -> DataFrame:
    """(path, content) of all supported files below a folder of any store that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")
    ext = F.regexp_extract("path", r"\.([^./]+)$", 1)
    keep = ext.isin(list(LANGUAGES))
    for p in (*EXCLUDED, *patterns):
        keep = keep & ~F.col("path").contains(p)
    return files.where(keep)


def listed_files(folder: str) -> list[str]:
    """Relative paths: what git knows or would add, else all but dot-names and the excludes."""
    done = subprocess.run(["git", "-C", folder, "ls-files", "--cached", "--others", "--exclude-standard"], capture_output=True, text=True)
    if done.returncode == 0:
        return sorted(set(filter(None, done.stdout.splitlines())))
    out = []
    for base, dirs, names in os.walk(folder):
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and not excluded("/" + os.path.relpath(os.path.join(base, d), folder) + "/"))
        out += [os.path.relpath(os.path.join(base, n), folder) for n in sorted(names) if not n.startswith(".")]
    return out


def detect_roots(folder: str) -> tuple[list[str], dict[str, int]]:
    """(roots, files by language): first path components of supported files; "." stands for all if a file is at the top."""
    roots, langs = set(), Counter()
    for p in listed_files(folder):
        lang = language_of(p)
        if lang:
            langs["c++" if lang == "cpp" else lang] += 1
            roots.add(p.split("/")[0] if "/" in p else ".")
    return (["."] if "." in roots else sorted(roots)), dict(sorted(langs.items()))


def repo_root(folder: str) -> str:
    """The top folder of the git repository, else the folder itself."""
    done = subprocess.run(["git", "-C", folder, "rev-parse", "--show-toplevel"], capture_output=True, text=True)
    return done.stdout.strip() or os.path.abspath(folder) if done.returncode == 0 else os.path.abspath(folder)


def git_diff(folder: str, base: str = "HEAD") -> str:
    """The diff without context against base, over supported files; a failing git is an error."""
    globs = [f"*.{e}" for e in LANGUAGES]
    done = subprocess.run(["git", "-C", folder, "diff", "-U0", base, "--", *globs], capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"git diff {base}: {done.stderr.strip()}")
    return done.stdout


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, original, level) of a JSON array; an empty one is an error."""
    rows = spark.read.schema("file string, original string, level int").option("multiLine", True).json(path)
    if rows.isEmpty():
        raise ValueError(f"manifest {path} has no entries")
    return rows


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, label, model_key, backend, provider, model_dir, script): "-" is null; the first row of an alias counts."""
    names = ["alias", "label", "model_key", "backend", "provider", "model_dir", "script"]
    raw = spark.read.text(path).withColumn("no", F.monotonically_increasing_id())
    raw = raw.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    parts = F.split("value", "\t")
    rows = raw.select("no", *[F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("-")).alias(n) for i, n in enumerate(names)])
    return rows.groupBy("alias").agg(F.min_by(F.struct(*names[1:]), "no").alias("x")).select("alias", "x.*")


@dataclass
class ExtractConfig:
    roots: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    respect_gitignore: bool = True
    strip_comments: bool = False
    granularity: list[str] = field(default_factory=lambda: ["function", "block"])
    min_block_lines: int = 8


@dataclass
class EmbedConfig:
    model: str = "hashed-tokens"
    backend: str | None = None
    provider: str = "auto"
    model_dir: str | None = None
    script: str | None = None

    def __post_init__(self):
        if self.provider not in ("auto", "cpu", "cuda"):
            raise ValueError(f"unknown provider {self.provider!r}: auto, cpu or cuda")


@dataclass
class ScanConfig:
    threshold: float | None = None
    index: str = "exact"
    min_lines: int = 5
    skip_tests: bool = False
    unit_kind: str | None = None
    min_cluster: int = 2


@dataclass
class Config:
    """Settings; unknown names are errors, and relative paths are meant from the file's folder."""

    db: str = "twinspect-store"
    extract: ExtractConfig = field(default_factory=ExtractConfig)
    embed: EmbedConfig = field(default_factory=EmbedConfig)
    scan: ScanConfig = field(default_factory=ScanConfig)

    def __post_init__(self):
        self.named: set[tuple[str, str]] = set()  # (part, setting) that a file names

    def is_set(self, part: str, name: str) -> bool:
        """Whether a file names the setting or its value is not the default."""
        mine = getattr(self, part)
        return (part, name) in self.named or getattr(mine, name) != getattr(type(mine)(), name)

    @staticmethod
    def read(path: str) -> Config:
        def fill(kind, values, at):
            known = {f.name: f for f in fields(kind)}
            if unknown := set(values) - set(known):
                raise ValueError(f"unknown settings {at}: {', '.join(sorted(unknown))}")
            return kind(**{k: fill(type(known[k].default_factory()), v, f"[{k}]") if isinstance(v, dict) and is_dataclass(known[k].default_factory()) else v for k, v in values.items()})

        base = Path(path).resolve().parent
        with open(path, "rb") as f:
            values = tomllib.load(f)
        out = fill(Config, values, "at the top")
        out.named = {(part, name) for part, v in values.items() if isinstance(v, dict) for name in v}
        at = lambda p: p if p is None or os.path.isabs(p) else str(base / p)
        out.db, out.extract.roots = at(out.db), [at(r) for r in out.extract.roots]
        out.embed.model_dir, out.embed.script = at(out.embed.model_dir), at(out.embed.script)
        return out

    @staticmethod
    def discover(start: str, name: str = "twinspect.toml") -> Config:
        """The nearest config file of start and the folders above, else defaults."""
        here = Path(start).resolve()
        return next((Config.read(str(d / name)) for d in (here, *here.parents) if (d / name).is_file()), Config())

    def render(self) -> str:
        """The settings as TOML."""
        out = [f"db = {json.dumps(self.db)}"]
        for part in ("extract", "embed", "scan"):
            out.append(f"\n[{part}]")
            out += [f"{f.name} = {json.dumps(v)}" for f in fields(getattr(self, part)) if (v := getattr(getattr(self, part), f.name)) is not None]
        return "\n".join(out) + "\n"
