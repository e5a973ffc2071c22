import json
import subprocess

import pytest

from twinspect.__main__ import main
from twinspect.plans.engine import Engine
from twinspect.sources import files

BODY = "".join(f"    step_{i} = values[{i}] * limit + {i}\n" for i in range(9)) + "    return step_1\n"


@pytest.fixture
def project(tmp_path, monkeypatch):
    folder = tmp_path / "project"
    (folder / "lib").mkdir(parents=True)
    (folder / "lib/a.py").write_text("def first(values, limit):\n" + BODY)
    (folder / "lib/b.py").write_text("def second(values, limit):\n" + BODY)
    for args in (["init", "-q"], ["add", "."], ["-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "x"]):
        subprocess.run(["git", "-C", str(folder), *args], check=True, capture_output=True)
    for name in ("GITHUB_BASE_REF", "GITHUB_EVENT_NAME"):
        monkeypatch.delenv(name, raising=False)
    monkeypatch.chdir(folder)
    return folder


def test_commands(spark, project, capsys):
    def said(*args):
        status = main(list(args), spark)
        got = capsys.readouterr()
        assert status != 2 or got.err.startswith("twinspect: "), got.err
        return status, got.out + (got.err if status == 2 else "")

    assert said("scan", "--no-refresh")[0] == 2  # no threshold
    assert said("init")[0] == 0 and said("init")[0] == 2 and said("init", "--yes")[0] == 0
    assert files.Config.discover(".").extract.roots == [str(project / "lib")]
    assert said("extract", "--granularity", "function") == (0, "2 units in main\n")
    assert said("embed") == (0, "2 new vectors\n") and said("embed") == (0, "0 new vectors\n")
    status, text = said("scan", "--no-refresh", "-t", "0.8", "--json", str(project / "pairs"))
    assert status == 0 and "first" in text and "second" in text
    assert "2  main" in said("status")[1]
    (project / "lib/c.py").write_text("def third(values, limit):\n" + BODY)
    subprocess.run(["git", "add", "."], check=True)
    status, text = said("diff", "-t", "0.8", "--check", "--json", str(project / "out.json"))
    assert status == 1 and "1 of 1 touched" in text and len(json.loads((project / "out.json").read_text())) == 1
    assert said("diff", "-t", "0.8")[0] == 0
    (project / "plants.json").write_text(json.dumps([{"file": "c.py", "original": "a.py::first", "level": 1}]))
    assert said("extract", "--corpus", "injected", "--root", "lib", "--granularity", "function")[0] == 0 and said("embed")[0] == 0
    status, text = said("inject-eval", "--manifest", str(project / "plants.json"), "--summary-row", "--label", "x")
    assert (status, text[:9]) == (0, "| x | 1 |"), text
    (project / "models.tsv").write_text("# alias\tlabel\nsmall\tSmall model\tother-key\t-\t-\t-\t-\nlost\tLost\tk\tonnx\tcpu\tnowhere\t-\n")
    evaluate = ("inject-eval", "--manifest", str(project / "plants.json"), "--summary-row", "--aliases", str(project / "models.tsv"), "--alias")
    assert said(*evaluate, "small")[1].startswith("| Small model | 1 |") and "other-key" in said("status")[1]
    assert said(*evaluate, "small", "--label", "mine")[1].startswith("| mine | 1 |")
    assert said(*evaluate, "own-key")[1].startswith("| own-key | 1 |")
    assert said(*evaluate, "lost")[0] == 2


def test_ci_settings(spark, project):
    found = Engine(spark, files.Config(db="s")).ci_engine(".", [], ["gen"], None, None, False).config
    assert found.extract.roots == [str(project / "lib")] and found.extract.exclude == ["gen"] and found.extract.granularity == ["function"]
    assert (found.scan.threshold, found.scan.min_lines, found.scan.skip_tests) == (0.85, 8, True)
    (project / "twinspect.toml").write_text('[extract]\nroots = ["lib"]\n[scan]\nthreshold = 0.7\nmin_lines = 5\nskip_tests = false\nunit_kind = "block"\n')
    mine = Engine(spark, files.Config.discover("."))
    found = mine.ci_engine(".", [], [], None, None, False).config
    assert (found.scan.threshold, found.scan.min_lines, found.scan.skip_tests, found.extract.granularity) == (0.7, 5, False, ["block"])
    found = mine.ci_engine(".", ["x"], [], 0.9, 3, True).config
    assert (found.extract.roots, found.scan.threshold, found.scan.min_lines) == ([str(project / "x")], 0.9, 3)


def test_embedding_goes_on_after_a_failure(spark, project, monkeypatch):
    e = Engine(spark, files.Config(db=str(project / "store"), extract=files.ExtractConfig(roots=[str(project / "lib")], granularity=["function"])))
    (project / "lib/c.py").write_text("".join(f"def f{i}(values, limit):\n    x = {i}\n" + BODY + "\n\n" for i in range(12)))
    e.extract()
    real, calls = e.store.add_embeddings, []

    def fails(*args):
        calls.append(args)
        if len(calls) == 3:
            raise RuntimeError("lost")
        real(*args)

    monkeypatch.setattr(e.store, "add_embeddings", fails)
    n = e.store.pending(e.model).count()
    assert n == 14
    with pytest.raises(RuntimeError):
        e.embed(chunk=4)
    done = e.store.embeddings.count()
    assert 0 < done < 14 and e.embed(chunk=4) == 14 - done and e.store.embeddings.count() == 14
