"""Extraction by language, ignore rules, the store, the engine on a small tree, the stream, the config."""

import subprocess

import pytest
from pyspark.sql import functions as F

from twinspect.plans.engine import Engine, embedder
from twinspect.sources import files
from twinspect.sources.store import UnitStore
from twinspect.sources.units import ExtractOptions, units_of
from twinspect.streaming.ingest import ingest

ALL = ExtractOptions(min_block_lines=1)


def names(path, src, kind="function", **options):
    return [u["name"] for u in units_of(path, src, ExtractOptions(min_block_lines=1, **options)) if u["unit_kind"] == kind]


RUST = """// twinspect:ignore
pub fn outer(x: &'a str) -> u8 {
    for i in 0..3 {
        if i > 1 {
            println!("}} {");
        }
    }
    1
}
impl Foo {
    /// doc
    pub(crate) async fn m(&self) {}
}
#[cfg(test)]
mod tests {
    #[test]
    fn works() { let c = '{'; }
}
"""


def test_rust():
    got = {u["name"]: u for u in units_of("a.rs", RUST, ALL)}
    assert [n for n in got if "::" not in n] == ["outer", "m", "works"]
    assert {"outer::body", "outer::for", "outer::if"} <= set(got)
    assert got["outer"]["ignored"] and got["outer::for"]["ignored"] and not got["m"]["ignored"]
    assert got["works"]["is_test"] and not got["m"]["is_test"]
    assert (got["outer"]["start_line"], got["outer"]["end_line"]) == (2, 9)


@pytest.mark.parametrize("path,src,want", [
    ("a.ts", "export function foo<T>(a: T) { return a }\nconst bar = async (x: number): Promise<void> => { await x; };\nclass A { constructor(private x: number) { } run(a) { if (a) { b() } } }\n", ["foo", "bar", "constructor", "run"]),
    ("a.go", "package a\nfunc (s *S) Run(a int) error {\n\tfor i := range x { _ = `}` }\n\treturn nil\n}\nfunc Gen[T any](x T) T { return x }\n", ["Run", "Gen"]),
    ("A.java", "class A {\n  A(int x) { this.x = x; }\n  @Test\n  public void works() throws Exception { if (x) { y(); } }\n  <T> List<T> make(Map<String, T> m) { return null; }\n  abstract void nope();\n}\n", ["A", "works", "make"]),
    ("A.cs", "namespace N { class A { [Fact] public void Works() { int Local(int a) { return a; } }\n public int X() => 3;\n abstract void No(); public int P { get { return 1; } } } }", ["Works", "Local", "X"]),
    ("a.php", "<?php\nclass A { public function testIt($a) { if ($a) { return \"}\"; } # {\n } }\nfunction top() { return 1; }\n", ["testIt", "top"]),
    ("a.rb", "class A\n  def self.make(x)\n    if x\n      1\n    end\n    while x do\n      x = nil\n    end\n  end\n  def test_it; return 1 if x; end\nend\n", ["make", "test_it"]),
    ("a.c", "#include <x.h>\nstatic int *add(int a, int b) {\n  if (a) { return 0; }\n  return a + b;\n}\nstruct S { int x; };\nint arr[] = { 1, 2 };\n", ["add"]),
    ("a.cpp", "template <typename T>\nT maxi(T a, T b) { return a > b ? a : b; }\nclass C { public: C(int x) : x_(x) {} void run() const { while (1) { } } int x_; };\nvoid C::go(int a) { a--; }\n", ["maxi", "C", "run", "go"]),
    ("G.cs", "class A {\n Task<int> Get<T>(T x) { return null; }\n Dictionary<string, List<int>> Map<K>(K k) where K : new() { return null; }\n}\n", ["Get", "Map"]),
    ("d.ts", "const h = ({ a, b }: P) => {\n  return a;\n};\nclass C { m(x: { a: number }, y = 1): void { x; } }\n", ["h", "m"]),
    ("a.md", "fn x() {}", []),
])
def test_languages(path, src, want):
    assert names(path, src) == want


def test_test_marks():
    flag = lambda p, s: {u["name"]: u["is_test"] for u in units_of(p, s, ALL)}
    assert flag("A.java", "class A {\n @Test\n void a() { }\n void b() { }\n}")["a"] is True
    assert flag("A.cs", "class A { [Theory] void A1() { } void B() { } }") == {"A1": True, "A1::body": True, "B": False, "B::body": False}
    assert flag("a.py", "def test_x():\n    pass\n")["test_x"] is True


def test_python_and_its_fallback():
    src = '@dec\ndef f(a):\n    """doc"""\n    # c\n    if a:\n        return 1\n    else:\n        return 2\n'
    got = {u["name"]: u for u in units_of("a.py", src, ALL)}
    assert (got["f"]["start_line"], got["f"]["end_line"], got["f"]["effective_lines"]) == (1, 8, 4)
    assert {"f::body", "f::if", "f::else"} <= set(got)
    stripped = {u["name"]: u for u in units_of("a.py", src, ExtractOptions(strip_comments=True))}["f"]
    assert stripped["text"] == "@dec\ndef f(a):\n    if a:\n        return 1\n    else:\n        return 2" and stripped["hash"] != got["f"]["hash"]
    assert names("b.py", "def f(:\n    x\n\ndef g(a):\n    return a\n") == ["f", "g"]


def test_effective_lines_of_the_body():
    src = "fn f(\n    a: u8,\n    b: u8,\n) -> u8 {\n    // c\n\n    a + b\n}\n"
    assert units_of("a.rs", src)[0]["effective_lines"] == 1


def test_odd_input_does_not_fail():
    for src in ("", "{", "}}}", "fn", "fn x(", '"', "'", "/*", "`", "def", "\x00{", "fn a() { fn b() {"):
        for ext in ("rs", "ts", "py", "go", "java", "cs", "php", "rb", "c", "cpp"):
            units_of(f"a.{ext}", src, ALL)


def test_ignore_rules(tmp_path):
    for p in ("src/lib.rs", "generated/out.rs", "keep/a.rs", ".hidden/h.rs", "src/skip.rs", "notes.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("fn a() {}")
    (tmp_path / ".gitignore").write_text("/generated/\n*skip.rs\n!keep/\n")
    rel = lambda it: [p[len(str(tmp_path)) + 1 :] for p in it]
    assert rel(files.walk(str(tmp_path))) == [".hidden/h.rs", "keep/a.rs", "src/lib.rs"]
    assert "generated/out.rs" in rel(files.walk(str(tmp_path), respect_gitignore=False))
    assert rel(files.walk(str(tmp_path), ["/src/"])) == [".hidden/h.rs", "keep/a.rs"]


def test_roots(tmp_path):
    for p in ("src/a.rs", "scripts/b.py", "docs/c.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    assert files.detect_roots(str(tmp_path)) == (["scripts", "src"], {"python": 1, "rust": 1})
    (tmp_path / "top.h").write_text("x")
    assert files.detect_roots(str(tmp_path)) == (["."], {"c++": 1, "python": 1, "rust": 1})


def test_config(tmp_path):
    (tmp_path / "twinspect.toml").write_text('db = "s"\n[extract]\nroots = ["src"]\n[scan]\nthreshold = 0.7\n')
    (tmp_path / "a/b").mkdir(parents=True)
    c = files.Config.discover(str(tmp_path / "a/b"))
    assert c.db == str(tmp_path / "s") and c.extract.roots == [str(tmp_path / "src")] and c.scan.threshold == 0.7
    (tmp_path / "x.toml").write_text(c.render())
    assert files.Config.read(str(tmp_path / "x.toml")) == c
    (tmp_path / "bad.toml").write_text("nope = 1\n")
    with pytest.raises(ValueError):
        files.Config.read(str(tmp_path / "bad.toml"))
    with pytest.raises(ValueError):
        embedder(files.EmbedConfig(backend="none"))


def test_aliases_and_manifest(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("# c\n\na\tfirst\tk\t-\tcpu\t-\t-\na\tsecond\tk\tx\tcpu\t-\t-\n")
    assert [(r.alias, r.label, r.backend) for r in files.read_aliases(spark, str(tmp_path / "m.tsv")).collect()] == [("a", "first", None)]
    (tmp_path / "e.json").write_text("[]")
    with pytest.raises(ValueError):
        files.read_manifest(spark, str(tmp_path / "e.json"))


BODY = "    total = 0\n    for value in values:\n        if value > limit:\n            total += value\n    return total\n"


def test_engine_end_to_end(spark, tmp_path):
    repo = tmp_path / "repo"
    (repo / "src").mkdir(parents=True)
    (repo / "src/a.py").write_text("def alpha(values, limit):\n" + BODY)
    (repo / "src/b.py").write_text("def beta(values, limit):\n" + BODY + "\n\ndef other(path):\n    with open(path) as f:\n        data = f.read()\n    print(data)\n    return len(data)\n")
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "x")
    config = files.Config(db=str(tmp_path / "store"), extract=files.ExtractConfig(roots=[str(repo / "src")], granularity=["function"]))
    e = Engine(spark, config)
    assert e.refresh() == 3 and e.embed() == 0
    found = e.scan(0.8, refresh=False, min_lines=2)
    assert found["clusters"].count() == 1 and found["members"].count() == 2
    text = e.scan_report(found, bodies=True)
    assert "alpha" in text and "```python" in text
    with pytest.raises(ValueError):
        e.scan(refresh=False)
    (repo / "src/c.py").write_text("def gamma(values, limit):\n" + BODY)
    git("add", ".")
    reports = e.diff(str(repo), "HEAD", 0.8, "touched", 2)
    assert [r["verdict"] for r in reports] == ["DUP"] and len(reports[0]["neighbors"]) == 3
    assert "1 of 1 touched" in e.diff_text(reports)
    with pytest.raises(SystemExit):
        e.diff(str(repo), "HEAD", 0.8, "added", 2, check=True)
    units, models = e.status()
    assert units.first()["count"] == 3 and models.first()["count"] == 3
    e.extract([str(repo / "src")], "injected")
    manifest = spark.createDataFrame([("c.py", "a.py::alpha", 1)], "file string, original string, level int")
    e.embed()
    ranks, by_level = e.eval_clones(manifest, 2)
    assert ranks.first()["rank"] <= 2 and by_level.first()["recall5"] == 1.0
    assert e.ci(str(repo), "diff", "HEAD", 0.8, min_lines=2, refresh_base=True)["findings"] == 1


def test_store_replaces_and_keeps_first_text(spark, tmp_path):
    s = UnitStore(spark, str(tmp_path / "s"))
    row = lambda path, n, h, ignored=False: (path, "f", "rust", "function", 1, n, n, h, "t" + h, ignored, False)
    s.replace_corpus("main", spark.createDataFrame([row("a", 1, "x"), row("b", 2, "y"), row("c", 9, "z", True)], files.UNIT_SCHEMA))
    s.replace_corpus("injected", spark.createDataFrame([row("i", 3, "x")], files.UNIT_SCHEMA))
    assert s.pending("m").count() == 3
    s.add_embeddings("m", s.pending("m").select("hash", F.array(F.lit(3.0), F.lit(4.0)).alias("vec")))
    assert s.pending("m").count() == 0 and s.pending("other").count() == 3
    assert [round(x, 3) for x in s.embeddings.first()["vec"]] == [0.6, 0.8]
    assert [r.path for r in s.scannable("main", "m", 2, False).collect()] == ["b"] and s.n_ignored("main", "m") == 1
    s.replace_corpus("main", spark.createDataFrame([row("d", 5, "w")], files.UNIT_SCHEMA))
    assert sorted((r.corpus, r.path) for r in s.units.collect()) == [("injected", "i"), ("main", "d")]
    assert s.texts.count() == 4
    with pytest.raises(ValueError):
        s.replace_corpus("main", spark.createDataFrame([("p", "f", "rust", "odd", 1, 2, 2, "h", "t", False, False)], files.UNIT_SCHEMA))


def test_stream_adds_once(spark, tmp_path):
    s = UnitStore(spark, str(tmp_path / "s"))
    for k, rows in enumerate(([("a b",), ("a b",), ("c d",)], [("c d",), ("e f",)])):
        spark.createDataFrame(rows, "text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
        ingest(stream, s, "hashed-tokens", str(tmp_path / "ck")).awaitTermination()
        assert s.texts.count() == s.embeddings.count() == (2, 3)[k]


def test_python_offsets_count_characters_and_line_feeds():
    plain = 'def f(x):\n    """eeeeeeee groesse."""\n    y = x + 1\n    return compute(y)\n\n\ndef g(x):\n    return x\n'
    other = plain.replace("eeeeeeee groesse", "éééééééé Größe\u2028")
    feed = plain.replace("\n\n\ndef g", "\n\x0c\n\ndef g")
    want = [(u["name"], u["text"], u["effective_lines"], u["hash"]) for u in units_of("a.py", plain, ExtractOptions(strip_comments=True))]
    assert [t for _, t, _, _ in want] == ["def f(x):\n    y = x + 1\n    return compute(y)", "def g(x):\n    return x"]
    for src in (other, feed):
        assert [(u["name"], u["text"], u["effective_lines"], u["hash"]) for u in units_of("a.py", src, ExtractOptions(strip_comments=True))] == want
