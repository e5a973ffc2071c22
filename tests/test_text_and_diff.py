"""Text expressions, hunks, path rules, policies, selectors."""

import pytest
from pyspark.sql import functions as F

from twinspect.functions import text as T
from twinspect.operators import diffs, evaluate
from twinspect.plans import report


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("header,want", [("@@ -10,2 +12,3 @@", (12, 14)), ("@@ -10 +12 @@", (12, 12)), ("@@ -10,2 +12,0 @@", (None, None)), ("nonsense", (None, None)), (None, (None, None))])
def test_hunks(spark, header, want):
    r = T.hunk_range(F.col("x"))
    assert tuple(spark.createDataFrame([(header,)], "x string").select(r["lo"], r["hi"]).first()) == want


def test_diff_groups_ranges_by_file(spark):
    text = "--- a/src/a.rs\n+++ b/src/a.rs\n@@ -1,2 +1,4 @@\n+x\n@@ -20 +22 @@\n+y\n--- a/src/gone.rs\n+++ /dev/null\n@@ -1,9 +0,0 @@\n"
    got = diffs.changed_ranges(spark.createDataFrame([(0, text)], "diff_id int, text string")).collect()
    assert sorted(map(tuple, got)) == [("src/a.rs", 1, 4), ("src/a.rs", 22, 22)]


@pytest.mark.parametrize("a,b,want", [("repo/src/a.rs", "src/a.rs", True), ("src/a.rs", "./src/a.rs", True), ("xsrc/a.rs", "src/a.rs", False)])
def test_path_suffix(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(T.paths_equal(F.col("a"), F.col("b"))).first()[0] is want


@pytest.mark.parametrize("path,want", [("src/tests/a.rs", True), ("a/b_test.go", True), ("x.spec.ts", True), ("p/__tests__/a.ts", True), ("p/test_a.py", True), ("FooTest.php", True), ("FooTests.cs", True), ("src/contest.rs", False), ("src/lib.rs", False)])
def test_test_paths(spark, path, want):
    assert one(spark, path, T.is_test_path) is want


def test_selector_splits_at_the_first_name_mark(spark):
    parts = T.selector(F.col("x"))
    row = spark.createDataFrame([("lib/geo/tiles.rs:7-31::Tile::merge",), ("a:x-y::f",), ("none",)], "x string").select(*parts.values()).collect()
    assert tuple(row[0]) == ("lib/geo/tiles.rs", 7, 31, "Tile::merge")
    assert tuple(row[1]) == ("a:x-y", None, None, "f") and tuple(row[2]) == (None,) * 4


def test_doc_strip_and_lines(spark):
    text = "/// a\n//! b\n/** c\nd\n*/ gone\nfn x() {}\n// kept\n/*! e */\n"
    assert one(spark, text, T.doc_stripped) == "fn x() {}\n// kept"
    assert one(spark, "/// only", T.embed_text) == "/// only"
    assert one(spark, "a\r\nb\n", T.lines_of) == ["a", "b"] and one(spark, "", T.lines_of) == []
    assert one(spark, "fn f(\n){\n\n  x();\n}\n", T.effective_lines) == 2


def test_fence(spark):
    assert one(spark, "plain", T.fence) == "```" and one(spark, "a ``` b", T.fence) == "````"
    assert report.fenced("a ``` b", "python").startswith("````python\n")


def test_rankable(spark):
    rows = spark.createDataFrame([(False, False), (True, False), (False, True)], "i boolean, t boolean")
    for skip, want in ((True, [True, False, False]), (False, [True, False, True])):
        assert [r[0] for r in rows.select(diffs.rankable(F.col("i"), F.col("t"), skip)).collect()] == want


@pytest.mark.parametrize("policy,base,want", [("touched", None, "DUP"), ("new-pairs", [1.0, 0.0], "REVIEW"), ("new-pairs", [0.0, 1.0], "DUP"), ("new-pairs", None, "DUP"), ("added", None, "DUP"), ("added", [0.0, 1.0], "REVIEW")])
def test_policies(spark, policy, base, want):
    near = [0.95, (1 - 0.95**2) ** 0.5]
    corpus = [(10, near)] + ([(11, base)] if base else [])
    q = spark.createDataFrame([(1, [1.0, 0.0])], "unit_id long, vec array<double>")
    c = spark.createDataFrame(corpus, "unit_id long, vec array<double>")
    stale = spark.createDataFrame([(1, 11)] if base else [], "q long, u long")
    assert [r.verdict for r in diffs.verdicts(q, c, stale, 0.9, policy).collect()] == [want]
    with pytest.raises(ValueError):
        diffs.verdicts(q, c, stale, 0.9, "none")


def test_margin_of_a_single_neighbour(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "unit_id long, vec array<double>")
    c = spark.createDataFrame([(10, [0.5, 0.0])], "unit_id long, vec array<double>")
    r = diffs.margins(diffs.neighbours(q, c)).first()
    assert (r.cos1, r.margin) == (0.5, 0.5)


def test_evaluation(spark):
    schema = "unit_id long, path string, name string, start_line int, end_line int, vec array<double>"
    main = spark.createDataFrame([(1, "src/a.rs", "f", 1, 9, [1.0, 0.0]), (2, "src/b.rs", "g", 1, 9, [0.6, 0.8])], schema)
    planted = spark.createDataFrame([(7, "inj/p1.rs", "h", 1, 3, [0.0, 1.0]), (8, "inj/p1.rs", "f2", 5, 20, [0.9, 0.1])], schema)
    manifest = spark.createDataFrame([("p1.rs", "src/a.rs::f", 1)], "file string, original string, level int")
    r = evaluate.evaluate(manifest, planted, main).first()
    assert (r.q, r["rank"], round(r.margin, 6)) == (8, 1, round(0.9 - 0.62, 6))
    levels = evaluate.levels(evaluate.evaluate(manifest, planted, main))
    assert levels.first()["recall1"] == 1.0
    evaluate.gate(levels, 1.0)
    with pytest.raises(ValueError):
        evaluate.gate(levels, 1.1)


def test_report(spark, tmp_path):
    rows = [{"unit": "a.rs:1-9 f", "verdict": "DUP", "neighbors": [{"unit": "b|c", "cosine": 0.91}]}, {"unit": "a.rs:10-19 g", "verdict": "ok"}]
    text = report.summary(rows)
    assert text.splitlines()[:4] == ["## twinspect: 2 changed units", "* DUP: 1", "* REVIEW: 0", "* ok: 1"]
    assert "| a.rs:1-9 f | DUP | b\\|c | 0.9100 |" in text and "| a.rs:10-19 g | ok |  |  |" in text and "further" not in text
    many = report.summary(rows[1:] * 53)
    assert many.count("a.rs:10-19") == 50 and "3 further units" in many
    assert report.summary_of_file(str(tmp_path / "none.json"))[1] == 0
    (tmp_path / "bad.json").write_text("{")
    assert report.summary_of_file(str(tmp_path / "bad.json"))[1] == 1
    line = spark.range(1).select(report.annotation(F.lit("DUP"), F.lit("a,b.rs:3-9 f"), F.lit("0.9 x"))).first()[0]
    assert line == "::error file=a%2Cb.rs,line=3,endLine=9,title=twinspect dup::DUP: closest unit 0.9 x"
    assert spark.range(1).select(report.annotation(F.lit("ok"), F.lit("a.rs:3-9 f"), F.lit(""))).first()[0] is None
