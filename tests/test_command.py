"""The command line over a session of the tests."""

import json

import pytest

from assayer import __main__ as command
from assayer.operators import predict as Q


def always_a():
    return Q.EchoPredictor(lambda p: "Final Answer: (A)")


def test_listed(spark, capsys):
    assert command.main(["list", "datasets", "--task-type", "translation", "--format", "json"]) == 0
    assert [r["name"] for r in json.loads(capsys.readouterr().out)] == ["parallel_conversations"]
    assert command.main(["list", "processors", "--format", "csv"]) == 0
    assert capsys.readouterr().out.startswith("name,kind,required,optional,defaults\ndevnagari_transliterator,")
    assert command.main(["list", "datasets", "--metric", "bleu"]) == 0
    assert "afrimedqa" in capsys.readouterr().out
    assert command.main(["info", "metrics", "wer"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["kind"] == "metric"
    assert command.main(["info", "metrics", "none"]) == 1


def test_evaluated(spark, tmp_path, capsys):
    rows = [(f"Q{i}", "w", "x", "y", "z", i % 2) for i in range(4)]
    spark.createDataFrame(rows, "question string, opa string, opb string, opc string, opd string, cop int").write.parquet(f"{tmp_path}/q")
    asked = ["eval", "--model", "tests.test_command:always_a", "--datasets", "medmcqa", "--sources", f"medmcqa={tmp_path}/q", "--output", f"{tmp_path}/r.json"]
    assert command.main([*asked, "--processor-args", "medmcqa.general_text_processor:use_lowercasing=true", "--cache", f"{tmp_path}/cache"]) == 0
    assert "medmcqa" in capsys.readouterr().out
    own = json.loads((tmp_path / "r.json").read_text())["medmcqa"]
    assert own["metrics"]["exact_match"] == {"score": {"exact_match": 0.5}, "num_samples": 4} and own["task_type"] == "mcqa"
    assert command.main([*asked, "--max-samples", "1", "--metrics", "accuracy"]) == 0
    assert json.loads((tmp_path / "r.json").read_text())["medmcqa"]["metrics"]["accuracy"]["num_samples"] == 1
    assert command.main([*asked, "--dry-run"]) == 0


def test_arguments_are_checked_first(spark):
    with pytest.raises(ValueError, match="no source"):
        command.jobs(spark, ["medqa"], {})
    with pytest.raises(ValueError, match="needs"):
        command.jobs(spark, ["mmlu_subset"], {"mmlu_subset": "/nowhere"})
    with pytest.raises(KeyError):
        command.jobs(spark, ["nothing"], {"nothing": "/nowhere"})
    with pytest.raises(ValueError, match="module"):
        command.loaded("json")
