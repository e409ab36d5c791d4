"""The evaluate and analyse stages write every table they promise."""

from optiq.plans import analyse as AN
from optiq.plans import bindings as B
from optiq.plans import evaluate as EV
from optiq.session import scratch_path

SF = "/root/testdata/sf0.001"


def test_write_evaluation(spark):
    graded = EV.grade_replies(B.raw_responses(spark, SF))
    paths = EV.write_evaluation(graded, scratch_path(spark, "eval-out"))
    assert spark.read.json(paths["detailed"]).count() == graded.count()
    flat = spark.read.option("header", True).csv(paths["flat"])
    assert "reasoning_text" not in flat.columns and "reasoning_metrics" not in flat.columns
    levels = {r.level for r in spark.read.json(paths["summaries"]).select("level").collect()}
    assert levels == {"model", "distractor_set", "model_distractor_set"}


def test_write_analysis(spark):
    paths = AN.write_analysis(B.responses(spark, SF), scratch_path(spark, "analysis-out"))
    counts = {k: spark.read.parquet(p).count() for k, p in paths.items()}
    assert counts["psychometric_analysis"] == 200
    assert counts["distractor_type_analysis"] == 15
    assert counts["anova_results"] == 18
    assert counts["calibration_metrics"] == 3
