"""The command line: python -m twinspect COMMAND, from the folder of the sources.

Settings come from the nearest twinspect.toml; options win over them. The exit status is 1 for `diff --check` and `ci` with
findings, 2 for an error.
"""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from twinspect.operators import diffs, evaluate
from twinspect.plans import report
from twinspect.plans.engine import CI_MODES, Engine
from twinspect.sources import files
from twinspect.sources.store import MAIN

KINDS = ("function", "block")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="twinspect", description="Find similar units of code and text.")
    top.add_argument("--db", help="folder of the store")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, embeds: bool = True) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=text)
        if embeds:
            c.add_argument("--model", help="name under which vectors are kept")
            c.add_argument("--backend", choices=("hashed-tokens", "onnx", "process"))
            c.add_argument("--provider", choices=("auto", "cpu", "cuda"))
            c.add_argument("--model-dir")
            c.add_argument("--script")
        return c

    def compares(c: argparse.ArgumentParser) -> None:
        c.add_argument("--base", help="git revision to compare with")
        c.add_argument("--policy", choices=diffs.POLICIES)
        c.add_argument("-t", "--threshold", type=float)
        c.add_argument("--min-lines", type=int)
        c.add_argument("--json", help="file for the reports")

    c = command("init", "write a config file for the folder's sources", False)
    c.add_argument("--yes", action="store_true", help="replace a config file that is there")
    command("refresh", "extract the config's roots and embed what is new")
    c = command("extract", "replace a corpus by the units of roots", False)
    c.add_argument("--root", action="append", default=[])
    c.add_argument("--corpus", default=MAIN)
    c.add_argument("--exclude", action="append", default=[])
    c.add_argument("--respect-gitignore", action=argparse.BooleanOptionalAction, default=None)
    c.add_argument("--strip-comments", action="store_true", default=None)
    c.add_argument("--granularity", action="append", choices=KINDS)
    c.add_argument("--min-block-lines", type=int)
    command("embed", "embed what has no vector")
    c = command("scan", "report clusters of similar units")
    c.add_argument("--no-refresh", action="store_true")
    c.add_argument("-t", "--threshold", type=float)
    c.add_argument("--index", choices=("exact", "sparse", "auto"))
    c.add_argument("--min-lines", type=int)
    c.add_argument("--skip-tests", action="store_true", default=None)
    c.add_argument("--unit-kind", choices=KINDS)
    c.add_argument("--json", help="file for all pairs")
    c.add_argument("--show-bodies", action="store_true")
    c.add_argument("--top", type=int, default=50)
    c.add_argument("-m", "--min-cluster", type=int)
    c = command("diff", "compare the functions that a change touches with the corpus")
    compares(c)
    c.add_argument("--skip-tests", action="store_true")
    c.add_argument("--check", action="store_true", help="exit status 1 if one is a duplicate")
    c = command("ci", "scan or diff with the defaults of a check")
    compares(c)
    c.add_argument("--mode", choices=CI_MODES, default="auto")
    c.add_argument("--refresh-base", action="store_true", help="take the corpus from the base revision")
    c.add_argument("--include-tests", action="store_true")
    c.add_argument("--root", action="append", default=[])
    c.add_argument("--exclude", action="append", default=[])
    c = command("inject-eval", "rank the originals of planted rewrites")
    c.add_argument("--manifest", required=True)
    c.add_argument("--label")
    c.add_argument("--min-lines", type=int, default=5)
    c.add_argument("--unit-kind", choices=KINDS, default="function")
    c.add_argument("--min-recall5", type=float)
    c.add_argument("--summary-row", action="store_true", help="one table row in place of the levels")
    c.add_argument("--alias", help="embed what is pending with the model that this alias stands for, and rank with it")
    c.add_argument("--aliases", help="table of aliases; an alias that it doesn't have is a model's key")
    command("status", "count units and vectors", False)
    return top


def settled(a: argparse.Namespace, folder: str) -> files.Config:
    """The config with the options that concern its own settings."""
    config = files.Config.discover(folder)
    if a.db:
        config.db = a.db
    for name in ("model", "backend", "provider", "model_dir", "script"):
        if getattr(a, name, None) is not None:
            setattr(config.embed, name, getattr(a, name))
    if a.command == "extract":
        config.extract.exclude += a.exclude
        for name in ("respect_gitignore", "strip_comments", "granularity", "min_block_lines"):
            if getattr(a, name) is not None:
                setattr(config.extract, name, getattr(a, name))
    return config


def init(folder: str, replace: bool) -> str:
    path = Path(folder) / "twinspect.toml"
    if path.exists() and not replace:
        raise ValueError(f"{path} is there; --yes replaces it")
    roots, langs = files.detect_roots(folder)
    if not langs:
        raise ValueError(f"no supported source files below {folder}")
    path.write_text(files.Config(extract=files.ExtractConfig(roots=roots)).render(), encoding="utf-8")
    return "\n".join([f"{path}: roots {', '.join(roots)}", *[f"{n:>8}  {lang}" for lang, n in langs.items()]])


def use_alias(config: files.Config, spark: SparkSession, alias: str, table: str | None, label: str | None) -> str:
    """Sets the config's embedder to what the alias stands for; returns the label of its row."""
    row = files.read_aliases(spark, table).where(F.col("alias") == alias).first() if table else None
    if row is None:
        config.embed.model = alias
        return label or alias
    if row["model_dir"] and not Path(row["model_dir"]).is_dir():
        raise ValueError(f"the model folder of {alias}, {row['model_dir']}, isn't there")
    config.embed = files.EmbedConfig(row["model_key"] or alias, row["backend"], row["provider"] or config.embed.provider, row["model_dir"], row["script"])
    return label or row["label"] or alias


def run(a: argparse.Namespace, spark: SparkSession, folder: str) -> int:
    e = Engine(spark, settled(a, folder))
    if a.command == "refresh":
        if not e.config.extract.roots:
            raise ValueError("the config names no roots")
        print(f"{e.refresh()} new vectors")
    elif a.command == "extract":
        roots = a.root or e.config.extract.roots
        if not roots:
            raise ValueError("no roots: --root or a config that names them")
        e.extract([r if "://" in r else os.path.abspath(r) for r in roots], a.corpus)
        print(f"{e.store.units.where(F.col('corpus') == a.corpus).count()} units in {a.corpus}")
    elif a.command == "embed":
        print(f"{e.embed()} new vectors")
    elif a.command == "scan":
        found = e.scan(a.threshold, not a.no_refresh, a.index, a.min_lines, a.skip_tests, a.unit_kind, a.min_cluster)
        print(e.scan_report(found, a.top, a.show_bodies))
        if a.json:
            e.pairs_json(found, a.json)
    elif a.command == "diff":
        reports = e.diff(folder, a.base or "HEAD", a.threshold, a.policy or "touched", 5 if a.min_lines is None else a.min_lines, a.skip_tests, a.json)
        print(e.diff_text(reports))
        return int(a.check and any(r["verdict"] == "DUP" for r in reports))
    elif a.command == "ci":
        out = e.ci(folder, a.mode, a.base, a.threshold, a.policy or "new-pairs", a.min_lines, a.include_tests, a.refresh_base, a.json, a.root, a.exclude)
        print("\n\n".join([*([out["scan"]] if "scan" in out else []), *([e.diff_text(out["diff"])] if "diff" in out else [])]))
        return int(out.get("findings", 0) > 0)
    elif a.command == "inject-eval":
        if a.alias:
            a.label = use_alias(e.config, spark, a.alias, a.aliases, a.label)
            e = Engine(spark, e.config)
            e.embed()
        _, levels = e.eval_clones(files.read_manifest(spark, a.manifest), a.min_lines, a.unit_kind)
        rows = levels.orderBy("level").collect()  # a handful of levels
        if a.summary_row:
            o = evaluate.overall(levels).first()
            print(f"| {report.cell(a.label or e.model)} | {o['n']} | {o['macro_f1']:.3f} | {o['worst_recall5']:.3f} |")
        else:
            for r in rows:
                print(f"level {r['level']}: {r['n']} plants, recall at 1 {r['recall1']:.3f}, at 5 {r['recall5']:.3f}, mean cosine {r['mean_cos']:.4f}")
        if a.min_recall5 is not None:
            evaluate.gate(levels, a.min_recall5)
    elif a.command == "status":
        units, models = e.status()
        for r in units.orderBy("corpus", "lang", "unit_kind").collect():
            print(f"{r['count']:>8}  {r['corpus']}  {r['lang']}  {r['unit_kind']}")
        for r in models.orderBy("model").collect():
            print(f"{r['count']:>8}  vectors of {r['model']}")
    return 0


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a, folder = parser().parse_args(args), os.getcwd()
    try:
        if a.command == "init":
            print(init(folder, a.yes))
            return 0
        return run(a, spark or SparkSession.builder.appName("twinspect").getOrCreate(), folder)
    except (ValueError, RuntimeError) as wrong:
        print(f"twinspect: {wrong}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
