import json

import pytest
from pyspark.sql import functions as F

from mixlens.operators import analysis as A
from mixlens.operators import build, evaluate, selection, validation
from mixlens.sources import tables as S
from mixlens.streaming import resume

LEVELS = [("m", 0, 1.0, 0.5, 0.80), ("m", 1, 0.8333, 0.5, 0.70), ("m", 2, 0.6667, 0.4, 0.56), ("m", 3, 0.6667, 0.45, 0.58)]
SCHEMA = "model string, level int, constraint_pass_rate double, semantic_score double, combined_score double"


def test_drop_rates(spark):
    levels = spark.createDataFrame(LEVELS, SCHEMA)
    details = A.pdr_details(levels)
    got = {(r.level, r.metric): r.pdr for r in details.collect()}
    assert [got[k, "constraint_pass_rate"] for k in (1, 2, 3)] == [16.67, 33.33, 33.33]
    assert [got[k, "semantic_score"] for k in (1, 2, 3)] == [0.0, 20.0, 10.0]
    assert [got[k, "combined_score"] for k in (1, 2, 3)] == [12.5, 30.0, 27.5]
    assert [round(r.pdr, 4) for r in A.pdr_by_level(details).orderBy("level").collect()] == [9.7233, 27.7767, 23.61]
    assert A.robustness(levels, details).first().robustness_score == pytest.approx(79.63)
    composite = A.pdr_details(levels, metric="combined_score")
    assert A.robustness(levels, composite).first().robustness_score == pytest.approx(76.6667, abs=1e-3)
    assert tuple(A.worst_and_mean(levels).first()) == ("m", 0.56, 0.66)


def test_drop_rate_edges(spark):
    levels = spark.createDataFrame([("zero", 0, 0.0, 0.0, 0.0), ("zero", 1, 1.0, 1.0, 1.0), ("none", 1, 0.5, 0.5, 0.5), ("up", 0, 0.5, 0.5, 0.5), ("up", 2, 1.0, 1.0, 1.0)], SCHEMA)
    details = A.pdr_details(levels)
    assert {r.pdr for r in details.filter("model = 'zero'").collect()} == {0.0}
    assert details.filter("model = 'none'").count() == 0
    got = {r.model: r.robustness_score for r in A.robustness(levels, details).collect()}
    assert got == {"zero": 100.0, "none": 100.0, "up": 200.0}


def test_ranking_ties_follow_the_input(spark):
    rows = spark.createDataFrame([("b", 0, 0.5, 5), ("a", 0, 0.5, 9), ("c", 0, 0.9, 7)], "model string, level int, composite double, ord long")
    rows = rows.withColumns({"cpr": F.lit(1.0), "semantic": F.lit(1.0)})
    assert [r.model for r in A.wlr_ranking(rows).orderBy("rank").collect()] == ["c", "b", "a"]
    assert [r.model for r in A.wlr_ranking(rows, exclude=["c"]).orderBy("rank").collect()] == ["b", "a"]


def test_places_follow_the_total_order(spark):
    rows = spark.createDataFrame([(f"c{k % 3}", f"t{(k * 37) % 101:03d}") for k in range(101)], "category string, original_instruction string")
    got = selection.finalize_ids(rows.repartition(5)).orderBy("category", "original_instruction").collect()
    assert [r.id for r in got] == [f"item_{k:05d}" for k in range(101)]


def test_resume_of_everything_is_empty(spark):
    rows = spark.createDataFrame([("m", "s", 0, True, "x"), ("m", "t", 0, False, "")], "model_id string, sample_id string, level int, success boolean, response string")
    assert evaluate.pending(rows, rows).count() == 0
    assert resume.remaining(rows, rows).count() == 0
    assert resume.remaining(rows, rows, retry_failures=True).count() == 1
    assert [r.sample_id for r in evaluate.pending(rows).collect()] == ["s"]


def test_missing_sample(spark):
    rows = spark.createDataFrame([("m", "s", 0, True, "x", "c")], "model_id string, sample_id string, level int, success boolean, response string, category string")
    none = spark.createDataFrame([], f"id string, gold_response string, constraints array<{evaluate.C.CONSTRAINT}>")
    got = evaluate.evaluate(rows, none).first()
    assert (got.cpr, got.rouge_l, got.composite) == (1.0, 0.0, 0.6)


def test_built_rows_are_valid(spark):
    source = S.demo_rows(spark).select("instruction", F.lit("").alias("input"), "output")
    made = build.build(source, 10)
    assert made.count() > 0
    assert validation.violations(made).filter("severity = 'error'").count() == 0


def test_lines_of_json(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"id": "a", "constraints": [{"constraint_type": "length", "target_value": [3, 9]}, {"constraint_type": "keyword", "target_value": ["x", "y"]}, {"constraint_type": "format", "target_value": "json"}]}\n\nbroken\n')
    schema = f"id string, constraints array<{S.CONSTRAINT_IN}>"
    with pytest.raises(Exception):
        S.read_lines(spark, str(path), schema).collect()
    rows = S.read_lines(spark, str(path), schema, "lenient")
    got = rows.select(S.typed_constraints(F.col("constraints")).alias("c")).first().c
    assert (got[0].min_words, got[0].max_words, got[1].keywords, got[2].format_id) == (3, 9, ["x", "y"], "json")
    assert S.read_lines(spark, str(tmp_path / "none"), schema, "lenient").count() == 0
    S.write_lines(rows, str(tmp_path / "out"))
    assert S.read_lines(spark, str(tmp_path / "out"), schema).count() == 1


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"shared": 1}))
    with pytest.raises(ValueError):
        S.load_templates(str(tmp_path / "c.json"))
    with pytest.raises(FileNotFoundError):
        S.load_config(str(tmp_path / "none.json"))
    with pytest.raises(ValueError):
        S.environment_value("MIXLENS_UNSET_KEY", required=True)
