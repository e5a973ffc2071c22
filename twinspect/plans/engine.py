"""The commands: refresh, extract, embed, scan, diff, ci, evaluation, status."""

from __future__ import annotations

import copy
import json
import os
import subprocess
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from twinspect.functions.text import is_excluded
from twinspect.operators import clusters, diffs, evaluate, overlap, similar
from twinspect.operators.embedding import Embedder, OnnxDir, Process, embed, hashed_tokens
from twinspect.plans import report
from twinspect.session import cut
from twinspect.sources import files
from twinspect.sources.store import INJECTED, MAIN, UnitStore, labels
from twinspect.sources.units import FUNCTION, ExtractOptions

HASHED = "hashed-tokens"
CI_MODES = ("auto", "diff", "scan", "both")
EMBED_CHUNK = 200_000


def embedder(config: files.EmbedConfig) -> Callable[[], Embedder] | None:
    """A factory for the workers; None stands for the built-in hashed tokens."""
    backend = config.backend or ("process" if config.script else "onnx" if config.model_dir else HASHED)
    if backend == HASHED:
        return None
    if backend == "process":
        if not config.script:
            raise ValueError("backend process needs a script")
        script = config.script
        return lambda: Process(["python", script])
    if backend == "onnx":
        if not config.model_dir:
            raise ValueError("backend onnx needs model_dir: a folder with model.onnx, tokenizer.json and meta.json")
        folder = config.model_dir
        return lambda: OnnxDir(folder)
    raise ValueError(f"unknown backend {backend!r}: {HASHED}, onnx or process")


class Engine:
    def __init__(self, spark: SparkSession, config: files.Config | None = None):
        self.spark, self.config = spark, config or files.Config()
        self.store = UnitStore(spark, self.config.db)

    @property
    def model(self) -> str:
        return self.config.embed.model

    # -- filling the store

    def options(self, **changes) -> ExtractOptions:
        e = self.config.extract
        return ExtractOptions(**({"granularity": tuple(e.granularity), "min_block_lines": e.min_block_lines, "strip_comments": e.strip_comments} | changes))

    def extract(self, roots: list[str] | None = None, corpus: str = MAIN, options: ExtractOptions | None = None) -> None:
        e = self.config.extract
        found = files.extract_roots(self.spark, roots or e.roots, e.exclude, e.respect_gitignore, options or self.options())
        self.store.replace_corpus(corpus, found)

    def vectors(self, texts: DataFrame) -> DataFrame:
        """(hash, vec) of rows (hash, text), one for each hash."""
        make = embedder(self.config.embed)
        return hashed_tokens(texts, "hash", unique=True) if make is None else embed(texts, "hash", make, self.model)

    def embed(self, chunk: int = EMBED_CHUNK) -> int:
        """Vectors for what has none; returns how many. The embedder is only made if something is pending.

        About `chunk` texts are embedded and committed at a time, so that a run after a failure embeds only what is left.
        """
        todo = cut(self.store.pending(self.model))
        n = todo.count()
        parts = -(-n // chunk)
        for k in range(parts):
            self.store.add_embeddings(self.model, self.vectors(todo.where(F.pmod(F.xxhash64("hash"), F.lit(parts)) == k)))
        return n

    def refresh(self) -> int:
        self.extract()
        return self.embed()

    # -- scan

    def scan(self, threshold: float | None = None, refresh: bool = True, index: str | None = None, min_lines: int | None = None, skip_tests: bool | None = None, unit_kind: str | None = None, min_cluster: int | None = None, pairs: bool = True) -> dict:
        """members, pairs and ordered summaries of the clusters that stay, summaries of every cluster, hidden overlaps, and the counts of
        units, ignored and kept ones, from the pass that reads the units. If pairs is false, none are listed: None stands for them."""
        s = self.config.scan
        threshold = s.threshold if threshold is None else threshold
        if threshold is None:
            raise ValueError("a scan needs a threshold")
        if refresh and self.config.extract.roots:
            self.refresh()
        seen = Observation()
        rows = cut(self.store.scannable(MAIN, self.model, s.min_lines if min_lines is None else min_lines, s.skip_tests if skip_tests is None else skip_tests, unit_kind or s.unit_kind, seen))
        units = cut(overlap.drop_overlapping_blocks(rows))
        find = lambda rows: similar.similar_pairs(rows, threshold, index or s.index, links=not pairs)
        members, left, before = clusters.pruned(find(units), units) if pairs else clusters.pruned_links(units, find)
        members, least = cut(members), s.min_cluster if min_cluster is None else min_cluster
        every = clusters.summary(members, left) if pairs else clusters.with_totals(members, left)
        summaries = clusters.ordered(every, min_members=least)
        kept = members.join(summaries.select("cluster_id"), "cluster_id", "left_semi")
        return {"members": kept, "pairs": left.join(kept.select(F.col("unit_id").alias("i")), "i", "left_semi") if pairs else None, "clusters": summaries, "every": every, "hidden": clusters.hidden_overlaps(members, before), "units": units, "counts": seen.get}

    def scan_report(self, found: dict, top: int = 50, bodies: bool = False) -> str:
        """The first `top` clusters as text; only their members, bodies and the pairs that are shown are fetched."""
        total = found["clusters"].count()
        named = labels(found["units"]).select("unit_id", "label", "hash", "lang")
        first = clusters.ordered(found["clusters"], top=top, min_members=1).join(found["hidden"], "cluster_id", "left")
        members = found["members"].select("cluster_id", "unit_id").join(F.broadcast(first.select("cluster_id")), "cluster_id", "left_semi").join(named, "unit_id")
        a, b = (named.select(F.col("unit_id").alias(x), F.col("label").alias(f"label_{x}")) for x in ("i", "j"))
        theirs = found["pairs"].join(members.select(F.col("unit_id").alias("i"), "cluster_id"), "i")
        n_pairs = {r["cluster_id"]: r["n"] for r in theirs.groupBy("cluster_id").agg(F.count("*").alias("n")).collect()}
        place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("cosine"), "i", "j"))
        pairs = theirs.withColumn("place", place).where(F.col("place") <= report.MAX_PAIRS).join(a, "i").join(b, "j")
        by_cluster, by_pair = {}, {}
        n_members = {r["cluster_id"]: r["n"] for r in members.groupBy("cluster_id").agg(F.count("*").alias("n")).collect()}
        nth = F.row_number().over(Window.partitionBy("cluster_id").orderBy("unit_id"))
        shown = cut(members.withColumn("nth", nth).where(F.col("nth") <= report.MAX_MEMBERS))
        for r in shown.orderBy("unit_id").collect():
            by_cluster.setdefault(r["cluster_id"], []).append(r)
        for r in pairs.orderBy(F.desc("cosine"), "i", "j").collect():
            by_pair.setdefault(r["cluster_id"], []).append({"a": r["label_i"], "b": r["label_j"], "cosine": r["cosine"]})
        out = []
        for c in first.orderBy("place").collect():
            rows = by_cluster[c["cluster_id"]]
            out.append({"labels": [r["label"] for r in rows], "hashes": [r["hash"] for r in rows], "langs": [r["lang"] for r in rows], "pairs": by_pair[c["cluster_id"]], "more_members": n_members[c["cluster_id"]] - len(rows), "n_pairs": n_pairs[c["cluster_id"]], "hidden_overlaps": c["hidden_overlaps"] or 0})
        texts = None
        if bodies:
            wanted = shown.select("hash").distinct()
            texts = {r["hash"]: r["text"] for r in self.store.texts.join(wanted, "hash", "left_semi").collect()}
        return report.scan_text(out, found["pairs"].count(), found["every"].count() - total, texts, total - len(out))

    def pairs_json(self, found: dict, path: str) -> None:
        """All retained pairs as {a, b, cosine} lines."""
        named = labels(found["units"]).select("unit_id", "label")
        a, b = (named.select(F.col("unit_id").alias(x), F.col("label").alias(y)) for x, y in (("i", "a"), ("j", "b")))
        report.write_json(found["pairs"].join(a, "i").join(b, "j").select("a", "b", "cosine"), path)

    # -- diff

    def touched(self, folder: str, base: str = "HEAD", min_lines: int = 5, skip_tests: bool = False) -> DataFrame:
        """Function units of the working tree that the diff against base touches."""
        text = self.spark.createDataFrame([(0, files.git_diff(folder, base))], "diff_id int, text string")
        ranges = cut(diffs.changed_ranges(text))
        paths = [r[0] for r in ranges.select("path").distinct().collect()]
        sources = [(p, (Path(folder) / p).read_bytes()) for p in sorted(paths) if (Path(folder) / p).is_file()]
        rows = files.extract_sources(self.spark.createDataFrame(sources, "path string, content binary"), self.options(granularity=(FUNCTION,)))
        rows = overlap.touched(rows, ranges).where((F.col("effective_lines") >= min_lines) & diffs.rankable(F.col("ignored"), F.col("is_test"), skip_tests))
        rows = rows.where(~is_excluded(F.col("path"), self.config.extract.exclude))
        return rows.withColumn("unit_id", F.xxhash64("path", "start_line", "end_line", "name").bitwiseAND(F.lit((1 << 62) - 1)))

    def diff(self, folder: str, base: str = "HEAD", threshold: float | None = None, policy: str = "touched", min_lines: int = 5, skip_tests: bool = False, json_path: str | None = None, check: bool = False) -> list[dict]:
        """Reports of touched functions with their nearest neighbours; check raises if one is DUP."""
        corpus = self.store.load(MAIN, self.model)
        if corpus.isEmpty():
            raise ValueError("the corpus has no units with vectors: extract and embed first")
        corpus = cut(corpus.where((F.col("unit_kind") == FUNCTION) & diffs.rankable(F.col("ignored"), F.col("is_test"), skip_tests)))
        if corpus.isEmpty():
            raise ValueError("the corpus has no function to compare with")
        changed = cut(self.touched(folder, base, min_lines, skip_tests))
        if changed.isEmpty():
            return []
        cached = self.store.embeddings_of(self.model).select("hash", "vec")
        texts = changed.select("hash", "text").dropDuplicates(["hash"]).join(cached.select("hash"), "hash", "left_anti")
        have = changed.join(cached, "hash").select("unit_id", F.col("vec").cast("array<double>").alias("vec"))
        fresh = changed.join(self.vectors(texts), "hash").select("unit_id", "vec")
        queries = cut(have.unionByName(fresh))
        stale = cut(diffs.stale_selves(changed, corpus))
        ranked = diffs.neighbours(queries, corpus.select("unit_id", "vec"), stale, diffs.TOP)
        verdicts = diffs.verdicts(queries, corpus.select("unit_id", "vec"), stale, threshold, policy)
        mine = labels(changed).select(F.col("unit_id").alias("q"), F.col("label").alias("unit"))
        near = labels(corpus).select(F.col("unit_id").alias("u"), F.col("label").alias("near"))
        rows = ranked.join(near, "u").groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", F.struct(F.col("near").alias("unit"), "cosine").alias("n")))).alias("ns"))
        rows = rows.join(verdicts, "q").join(mine, "q").select("unit", "verdict", "margin", F.col("ns.n").alias("neighbors")).orderBy("unit")
        out = [r.asDict(recursive=True) for r in rows.collect()]  # touched functions of one change
        if json_path:
            Path(json_path).write_text(json.dumps(out, indent=2), encoding="utf-8")
        if check and any(r["verdict"] == "DUP" for r in out):
            raise SystemExit(1)
        return out

    @staticmethod
    def diff_text(reports: list[dict]) -> str:
        out = []
        for r in reports:
            out.append(f"[{r['verdict']:>6}] {r['unit']}  (margin {r['margin']:+.3f})")
            out += [f"          {n['cosine']:.4f}  {n['unit']}" for n in r["neighbors"]]
        n = sum(r["verdict"] == "DUP" for r in reports)
        return "\n".join([*out, "", f"{n} of {len(reports)} touched function(s) flagged"])

    # -- ci

    def ci_engine(self, folder: str, roots: list[str], exclude: list[str], threshold: float | None, min_lines: int | None, include_tests: bool) -> Engine:
        """An engine of ci's settings: options, then what the config sets, then defaults of ci's own."""
        c = copy.deepcopy(self.config)
        top = files.repo_root(folder)
        if not roots and not c.extract.roots:
            roots, langs = files.detect_roots(top)
            if not langs:
                raise ValueError("no roots are set and no supported source files were found")
        if roots:
            c.extract.roots = [os.path.join(top, r) for r in roots]
        c.extract.exclude += exclude
        if not c.is_set("extract", "granularity"):
            c.extract.granularity = [c.scan.unit_kind or FUNCTION]
        if threshold is not None or c.scan.threshold is None:
            c.scan.threshold = 0.85 if threshold is None else threshold
        if min_lines is not None or not c.is_set("scan", "min_lines"):
            c.scan.min_lines = 8 if min_lines is None else min_lines
        if include_tests or not c.is_set("scan", "skip_tests"):
            c.scan.skip_tests = not include_tests
        return Engine(self.spark, c)

    def ci(self, folder: str, mode: str = "auto", base: str | None = None, threshold: float | None = None, policy: str = "new-pairs", min_lines: int | None = None, include_tests: bool = False, refresh_base: bool = False, json_path: str | None = None, roots: list[str] = (), exclude: list[str] = ()) -> dict:
        """Scan, diff or both; auto is diff for a pull request or a named base. With refresh_base the corpus is the base's own tree."""
        if mode not in CI_MODES:
            raise ValueError(f"unknown mode {mode!r}: {', '.join(CI_MODES)}")
        env = os.environ.get("GITHUB_BASE_REF") or None
        pulled = bool(env) or os.environ.get("GITHUB_EVENT_NAME") in ("pull_request", "pull_request_target")
        ref = base or (f"origin/{env}" if env else "HEAD")
        if mode == "auto":
            mode = "diff" if base or pulled else "scan"
        wanted = ("scan", "diff") if mode == "both" else (mode,)
        e = self.ci_engine(folder, list(roots), list(exclude), threshold, min_lines, include_tests)
        s, out = e.config.scan, {"mode": wanted}
        if "scan" in wanted:
            out["scan"] = e.scan_report(e.scan(), 25)
        if "diff" in wanted:
            if refresh_base:
                e.refresh_from(folder, ref)
            out["diff"] = e.diff(folder, ref, s.threshold, policy, s.min_lines, s.skip_tests, json_path)
            out["findings"] = sum(r["verdict"] == "DUP" for r in out["diff"])
        return out

    def refresh_from(self, folder: str, ref: str) -> None:
        """The main corpus from a worktree of ref, which is removed afterwards. Roots outside the repository are an error."""
        top = Path(subprocess.run(["git", "-C", folder, "rev-parse", "--show-toplevel"], capture_output=True, text=True, check=True).stdout.strip()).resolve()
        with tempfile.TemporaryDirectory() as tmp:
            tree = f"{tmp}/base"
            subprocess.run(["git", "-C", folder, "worktree", "add", "--detach", tree, ref], capture_output=True, check=True)
            try:
                roots = []
                for r in self.config.extract.roots or [str(top)]:
                    full = (top / r).resolve()
                    if full != top and top not in full.parents:
                        raise ValueError(f"root {r} is outside the repository")
                    roots.append(os.path.join(tree, os.path.relpath(full, top)))
                self.extract([r for r in roots if os.path.exists(r)])
                self.embed()
            finally:
                subprocess.run(["git", "-C", folder, "worktree", "remove", "--force", tree], capture_output=True)

    # -- evaluation, status

    def eval_clones(self, manifest: DataFrame, min_lines: int = 5, unit_kind: str = FUNCTION, min_recall5: float | None = None) -> tuple[DataFrame, DataFrame]:
        """(ranks of all plants, results by level). A missing original or plant is an error."""
        kind = lambda df: df.where(F.col("unit_kind") == unit_kind)
        main = cut(overlap.drop_overlapping_blocks(kind(self.store.load(MAIN, self.model)).where(F.col("effective_lines") >= min_lines)))
        injected = cut(overlap.drop_overlapping_blocks(kind(self.store.load(INJECTED, self.model))))
        if injected.isEmpty():
            raise ValueError("no injected units with vectors: extract them as corpus injected and embed first")
        ranks = cut(evaluate.evaluate(manifest, injected, main))
        if (missing := manifest.count() - ranks.count()) > 0:
            raise ValueError(f"{missing} plants or originals of the manifest were not found")
        by_level = evaluate.levels(ranks)
        if min_recall5 is not None:
            evaluate.gate(by_level, min_recall5)
        return ranks, by_level

    def status(self) -> tuple[DataFrame, DataFrame]:
        return self.store.status()
