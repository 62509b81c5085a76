import json

from pyspark.sql import functions as F

from mixlens.cli import main
from mixlens.operators import providers
from mixlens.sources import tables as S


def test_from_source_to_reports(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in "source data records scores reports violations quality export".split()}
    S.write_lines(S.demo_rows(spark).select("instruction", F.lit("").alias("input"), "output"), at["source"])
    models = tmp_path / "models.json"
    models.write_text(json.dumps({"models": [{"name": "a", "model_id": "x/a"}, {"name": "b", "model_id": "x/b"}]}))
    run = lambda *a: main(list(a), spark)
    assert run("build", at["source"], at["data"], "--samples", "10") == 0
    n = spark.read.parquet(at["data"]).count()
    assert run("validate", at["data"], at["violations"]) == 0
    assert json.loads(spark.read.text(at["data"] + "_stats").first().value)["total_samples"] == n
    for _ in range(2):  # the second run finds everything done
        assert run("infer", at["data"], str(models), at["records"], "--add", "c") == 0
    assert spark.read.json(at["records"]).count() == n * 4 * 3
    assert run("evaluate", at["records"], at["data"], at["scores"]) == 0
    assert run("analyze", at["scores"], at["reports"], "--exclude", "x/b") == 0
    assert {r.model for r in spark.read.json(at["reports"] + "/ranking").collect()} == {"x/a", "c"}
    assert run("report", at["data"], at["quality"]) == 0
    assert run("export", at["data"], at["export"]) == 0
    assert run("probe", str(models), at["quality"] + "-probe") == 0 and spark.read.json(at["quality"] + "-probe").filter("ok").count() == 2
    assert spark.read.parquet(at["export"] + "/train").count() == int(0.9 * n)


def test_all_in_one(spark, tmp_path, monkeypatch):
    models = tmp_path / "models.json"
    models.write_text(json.dumps({"inference": {"models": [{"name": "a", "model_id": "x/a"}, {"name": "b", "model_id": "x/b"}]}}))
    out = str(tmp_path / "run")
    assert main(["all", str(models), out, "--smoke", "--yes", "--exclude", "b"], spark) == 0
    assert spark.read.parquet(out + "/scores").count() == 2 * 4  # two samples, four levels, one model
    monkeypatch.setattr("builtins.input", lambda _: "2")
    assert main(["all", str(models), out, "--smoke"], spark) == 0
    assert {r.model for r in spark.read.json(out + "/reports/ranking").collect()} == {"x/a", "x/b"}
    monkeypatch.setattr("builtins.input", lambda _: "q")
    assert main(["all", str(models), str(tmp_path / "none"), "--smoke"], spark) == 0 and not (tmp_path / "none").exists()


def test_probe(spark):
    models = spark.createDataFrame([("a", "x/a")], "name string, model_id string")
    assert providers.probe(models, lambda m: providers.EchoGenerator()).first().ok
    demo = S.demo_dataset(spark, 25)
    assert demo.select("original_instruction").distinct().count() == 25 and demo.filter("size(constraints) = 3 AND level_3_adversarial <> ''").count() == 25
