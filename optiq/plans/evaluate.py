"""Grading flow: evaluation plan joined with received replies, parsed in one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optiq.functions import parse as PF


def grade_replies(raw: DataFrame, with_reasoning: bool = True) -> DataFrame:
    """Raw replies -> graded responses (answer, correctness, confidence, reasoning)."""
    reply = F.col("raw_response")
    # the labelled answer is extracted once into a column: the option lambdas
    # then compare against a column, not a re-evaluated regex
    ext = raw.withColumn("_ext", PF.extract_answer(reply))
    a, opts = F.col("_ext"), F.col("options")
    answer = F.when(a.isNotNull(), PF.snap_to_option(a, opts)).otherwise(
        PF.fallback_answer(reply, opts))
    reasoning = PF.extract_reasoning(reply) if with_reasoning else F.lit("")
    graded = ext.select(
        *[F.col(c) for c in raw.columns],
        answer.alias("llm_answer"),
        PF.extract_confidence(reply).alias("confidence"),
        reasoning.alias("reasoning_text"),
    )
    return (graded
            .withColumn("is_correct", PF.grade_exact(F.col("llm_answer"), F.col("correct_answer")))
            .withColumn("reasoning_metrics", PF.reasoning_metrics(F.col("reasoning_text"))))


def error_rows(plan: DataFrame, received: DataFrame, key: str = "response_id") -> DataFrame:
    """Planned calls without a received reply become error rows: answer "Error",
    NULL confidence and latency, empty reasoning, counted as incorrect."""
    got = received.select(key, "raw_response", F.col("response_time").alias("_rt"))
    j = plan.join(got, key, "left")
    missing = F.col("raw_response").isNull()
    return (j.withColumn("error", missing)
            .withColumn("raw_response", F.coalesce(F.col("raw_response"),
                                                  F.lit("Error: no reply received")))
            .withColumn("response_time", F.when(~missing, F.col("_rt")))
            .drop("_rt"))


def grade_with_errors(plan: DataFrame, received: DataFrame) -> DataFrame:
    joined = error_rows(plan, received)
    graded = grade_replies(joined)
    err = F.col("error")
    return (graded
            .withColumn("llm_answer", F.when(err, F.lit(PF.ERROR_ANSWER)).otherwise(F.col("llm_answer")))
            .withColumn("confidence", F.when(~err, F.col("confidence")))
            .withColumn("reasoning_text", F.when(err, F.lit("")).otherwise(F.col("reasoning_text")))
            .withColumn("is_correct", ~err & F.col("is_correct"))
            .withColumn("reasoning_metrics", PF.reasoning_metrics(F.col("reasoning_text"))))


def write_evaluation(graded: DataFrame, out_dir: str) -> dict[str, str]:
    """The evaluator's outputs from graded replies: detailed results as JSON,
    the same without the long reasoning columns as CSV, and the model / set /
    model x set summaries (rounded as the evaluator reports them) as JSON."""
    import os

    from optiq.operators.summary import model_distractor_summary
    from optiq.sources.files import sink_csv, sink_json

    paths = {name: os.path.join(out_dir, name) for name in ("detailed", "flat", "summaries")}
    sink_json(graded, paths["detailed"])
    sink_csv(graded, paths["flat"])
    sink_json(model_distractor_summary(graded, rounded=True), paths["summaries"])
    return paths
