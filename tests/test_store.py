"""Snapshots of the store: replacing, dropping, failing midway, older stores, what is kept on disk."""

import json
import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from twinspect.plans import report
from twinspect.sources import store as S
from twinspect.sources.store import UnitStore

ROWS = "path string, name string, lang string, unit_kind string, start_line int, end_line int, effective_lines int, hash string, text string, ignored boolean, is_test boolean"


def unit(k, **more):
    return tuple(({"path": f"p{k}", "name": f"n{k}", "lang": "python", "unit_kind": "function", "start_line": 1, "end_line": 9, "effective_lines": 5, "hash": f"h{k}", "text": f"t{k}", "ignored": False, "is_test": False} | more).values())


def extracted(spark, *ks, **more):
    return spark.createDataFrame([unit(k, **more) for k in ks], ROWS)


def names(df):
    return sorted(r["name"] for r in df.select("name").collect())


def test_replacing_by_nothing_empties_a_corpus(spark, tmp_path):
    s = UnitStore(spark, str(tmp_path / "s"))
    assert s.units.count() == s.texts.count() == s.embeddings.count() == 0 and s.versions() == []
    s.replace_corpus("main", extracted(spark, 1, 2))
    s.replace_corpus("other", extracted(spark, 2, 3))
    s.replace_corpus("main", extracted(spark).limit(0))
    assert names(s.units) == ["n2", "n3"] and s.units_of("main").count() == 0 and s.texts.count() == 3
    s.replace_corpus("other", extracted(spark, 4))
    assert names(s.units) == ["n4"] and s.texts.count() == 4
    s.drop_corpus("other")
    s.drop_corpus("never there")
    assert s.units.count() == 0 and s.versions() == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        s.replace_corpus("main", extracted(spark, 5, unit_kind="class"))
    assert s.versions()[-1] == 5


def test_a_writer_that_dies_midway_changes_nothing(spark, tmp_path, monkeypatch):
    s = UnitStore(spark, str(tmp_path / "s"))
    s.replace_corpus("main", extracted(spark, 1, 2))
    before = s.units, s.texts  # plans of a reader
    for step in ("_add_texts", "_commit"):
        with monkeypatch.context() as m:
            m.setattr(UnitStore, step, lambda *a: (_ for _ in ()).throw(OSError("gone")))
            with pytest.raises(OSError):
                s.replace_corpus("main", extracted(spark, 7, 8, 9))
        assert names(s.units) == ["n1", "n2"] and s.texts.count() == 2
    s.replace_corpus("main", extracted(spark, 7))
    assert names(s.units) == ["n7"] and names(before[0]) == ["n1", "n2"] and before[1].count() == 2


def test_vectors_are_added_once_and_replaced_when_told(spark, tmp_path):
    s = UnitStore(spark, str(tmp_path / "s"))
    s.replace_corpus("main", extracted(spark, 1, 2, 3))
    vectors = lambda *rows: spark.createDataFrame(list(rows), "hash string, vec array<double>")
    s.add_embeddings("m", vectors(("h1", [3.0, 4.0]), ("h1", [3.0, 4.0]), ("h2", [0.0, 0.0])))
    s.add_embeddings("m", vectors(("h1", [1.0, 0.0]), ("h3", [0.0, 2.0])))
    s.add_embeddings("m2", vectors(("h1", [1.0])))
    got = {r.hash: [round(x, 3) for x in r.vec] for r in s.embeddings_of("m").collect()}
    assert got == {"h1": [0.6, 0.8], "h2": [0.0, 0.0], "h3": [0.0, 1.0]} and s.embeddings.count() == 4
    s.add_embeddings("m", vectors(("h1", [1.0, 0.0])), replace=True)
    assert {r.hash: r.vec for r in s.embeddings_of("m").collect()}["h1"] == [1.0, 0.0] and s.embeddings_of("m").count() == 3
    assert names(s.load("main", "m2")) == ["n1"] and s.pending("m2").count() == 2 and s.pending("m").count() == 0


def test_counts_come_with_the_rows(spark, tmp_path):
    s = UnitStore(spark, str(tmp_path / "s"))
    rows = extracted(spark, 1, 2).unionByName(extracted(spark, 3, ignored=True)).unionByName(extracted(spark, 4, is_test=True)).unionByName(extracted(spark, 5, effective_lines=1))
    s.replace_corpus("main", rows)
    s.add_embeddings("m", spark.createDataFrame([(f"h{k}", [1.0]) for k in range(1, 6)], "hash string, vec array<double>"))
    for skip, kept in ((False, ["n1", "n2", "n4"]), (True, ["n1", "n2"])):
        seen = Observation()
        assert names(s.scannable("main", "m", 2, skip, None, seen)) == kept
        assert seen.get == {"units": 5, "ignored": 1, "kept": len(kept)}
    assert s.n_ignored("main", "m") == 1 and s.n_ignored("main", "m", "block") == 0


def test_older_stores_are_migrated(spark, tmp_path):
    folder = tmp_path / "s"
    old = extracted(spark, 1, 2).withColumns({"unit_id": F.monotonically_increasing_id(), "corpus": F.lit("main")})
    old.drop("unit_kind", "effective_lines", "text").write.partitionBy("corpus").parquet(str(folder / "units"))
    old.select("hash", "text").write.parquet(str(folder / "texts"))
    spark.createDataFrame([("h1", 2, [3.0, 4.0], "m")], "hash string, dim int, vec array<float>, model string").write.partitionBy("model").parquet(str(folder / "embeddings"))
    s = UnitStore(spark, str(folder))
    row = s.load("main", "m").first()
    assert [round(x, 3) for x in row["vec"]] == [0.6, 0.8] and (row["unit_kind"], row["effective_lines"], row["name"]) == ("function", 9, "n1")
    assert s.versions() == [1] and s.units.count() == s.texts.count() == 2
    s.replace_corpus("main", extracted(spark, 3))
    assert names(UnitStore(spark, str(folder)).units) == ["n3"]


def test_a_newer_schema_is_refused(spark, tmp_path):
    s = UnitStore(spark, str(tmp_path / "s"))
    s.replace_corpus("main", extracted(spark, 1))
    path = tmp_path / "s/_manifests/000000000001.json"
    state = json.loads(path.read_text())
    os.remove(tmp_path / "s/_manifests/.000000000001.json.crc") if (tmp_path / "s/_manifests/.000000000001.json.crc").exists() else None
    path.write_text(json.dumps(state | {"schema": S.SCHEMA + 1}))
    with pytest.raises(ValueError):
        s.units


def test_old_folders_go_and_many_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "KEEP", 2)
    monkeypatch.setattr(S, "MOST_FOLDERS", 3)
    s = UnitStore(spark, str(tmp_path / "s"))
    for k in range(6):
        s.add_texts(spark.createDataFrame([(f"h{k}", f"t{k}"), ("h0", "t0")], "hash string, text string").dropDuplicates(["hash"]))
    assert s.texts.count() == 6 and s.versions() == [5, 6] and len(s.state()["texts"]) <= 3
    on_disk = {f"_data/{n}" for n in os.listdir(tmp_path / "s/_data")}
    assert on_disk == {p for v in s.versions() for p in s._read(v)["texts"]}


def test_long_clusters_are_shown_in_part():
    c = {"labels": ["a", "b"], "hashes": ["1", "2"], "langs": ["python"] * 2, "pairs": [], "hidden_overlaps": 0, "more_members": 998}
    text = report.scan_text([c], 5, 0)
    assert "cluster 1: 1000 units" in text and "... 998 more units" in text


def test_the_first_text_of_a_hash_is_kept_and_nothing_with_texts_is_sorted(spark, tmp_path):
    """Of rows with one hash the first by path and line stays, also among equal ones and with many copies; joins hold keys only."""
    s = UnitStore(spark, str(tmp_path / "s"))
    rows = [unit(1, path=p, start_line=n, text=f"{p}{n}", hash="h") for p in ("b", "a", "c") for n in (7, 3, 5)] + [unit(2), unit(3, hash="x"), unit(3, hash="x", unit_kind="block")]
    s.replace_corpus("main", spark.createDataFrame(rows + [unit(9, path=f"z{k}", hash="h") for k in range(500)], ROWS).repartition(7))
    assert sorted((r.hash, r.text) for r in s.texts.collect()) == [("h", "a3"), ("h2", "t2"), ("x", "t3")]
    s.replace_corpus("other", extracted(spark, 2, 4))
    assert sorted(r.hash for r in s.texts.collect()) == ["h", "h2", "h4", "x"]
    s.add_embeddings("m", spark.createDataFrame([("h", [3.0, 4.0]), ("h", [3.0, 4.0]), ("x", [0.0, 2.0])], "hash string, vec array<double>").repartition(2))
    assert sorted((r.hash, tuple(round(v, 6) for v in r.vec)) for r in s.embeddings.collect()) == [("h", (0.6, 0.8)), ("x", (0.0, 1.0))]
    todo = s.pending("m")
    assert sorted(r.hash for r in todo.collect()) == ["h2", "h4"]
    for df in (todo, S._firsts(spark.createDataFrame([("a", "t"), ("a", "t")], "hash string, text string").localCheckpoint(), [])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Sort" not in plan.replace("SortedOutput", "")
