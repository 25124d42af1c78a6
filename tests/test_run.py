import json

from symgrain import cli
from symgrain.operators.pattern import pack, symmetrize
from symgrain.plans.scored_run import scored_run
from symgrain.sources import generators, jsonl

LINE = '{"n":4,"nnz":12,"indptr":[0,3,6,8,12],"indices":[0,1,3,0,1,3,2,3,0,1,2,3],"hash":"x","source":"st"}'


def log_of(spark, path):
    return [r["value"].split("\t") for r in spark.read.text(path).collect()]


def test_scored_run(spark, tmp_path):
    grid = symmetrize(generators.grid2d(spark, 9))
    corpus, log = str(tmp_path / "corpus"), str(tmp_path / "log")
    jsonl.write(pack(grid, grid.selectExpr("mid", "a as id").distinct()), corpus)
    (tmp_path / "corpus" / "more.jsonl").write_text(LINE + "\n" + LINE + "\n")
    found = scored_run(spark, corpus, log, "first\trun", seconds=300)
    assert found["status"] == "OK" and 0 < found["score"] <= 1 and found["rows"].count() == 3
    document = json.loads(found["document"])
    assert document["metrics"]["matrices"] == 3 and document["metrics"]["buckets"]["gt_10k"]["count"] == 0
    assert sorted(r["nnz"] for r in found["rows"].collect()) == [8, 8, 288]
    (line,) = log_of(spark, log)
    assert line[1] == "OK" and line[4] == "first run"


def test_failed_runs_are_logged(spark, tmp_path):
    log = str(tmp_path / "log")
    (tmp_path / "bad.jsonl").write_text(LINE + "\nnot json\n")
    assert "n missing" in scored_run(spark, str(tmp_path / "bad.jsonl"), log, "n")["reason"]
    assert "no patterns" in scored_run(spark, str(tmp_path / "absent"), log)["reason"]
    assert scored_run(spark, "x", log, gate=lambda: "refused")["reason"] == "refused"
    lines = log_of(spark, log)
    assert len(lines) == 3 and all(x[1:4] == ["FAIL", "NaN", "NaN"] for x in lines)
    assert any(x[4].endswith(" | n") for x in lines)


def test_commands(spark, tmp_path, capsys):
    deps = tmp_path / "deps.toml"
    deps.write_text('[dependencies]\nalpha = "1.2.3"\n')
    assert cli.emit_deps(spark, str(deps)) == 0 and capsys.readouterr().out == "alpha=1.2.3\n"
    deps.write_text('[dependencies]\nalpha = "^1"\n')
    assert cli.emit_deps(spark, str(deps)) == 1
    assert cli.emit_deps(spark, str(tmp_path / "none")) == 0
    crate = tmp_path / "vendor" / "x-1.0.0"
    crate.mkdir(parents=True)
    (crate / "Cargo.toml").write_text("[package]\n")
    assert cli.scan_tree(spark, str(tmp_path / "vendor")) == 0 and cli.scan_tree(spark, str(tmp_path / "no")) == 0
    (crate / "Cargo.toml").write_text("[build-dependencies]\ncc = '1'\n")
    assert cli.scan_tree(spark, str(tmp_path / "vendor")) == 1
    assert cli.main(["what"]) == 2
