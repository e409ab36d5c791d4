"""Item analysis and confidence calibration.

Shape of every operator: partial aggregation at the finest key first
(question x model, model x bin, ...), then small re-aggregations. No window
spans a whole model or question, so one key holding a third of all rows is
combined map-side instead of landing in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optiq.operators.joins import join_bounded
from optiq.operators.summary import value_counts_top1
from optiq.session import cut_lineage

N_BINS = 10


def _ok() -> Column:
    return F.col("is_correct").cast("double")


def _pearson_from_sums(n, sx, sy, sxx, syy, sxy, varies) -> Column:
    """Sample Pearson r from raw moment sums; NULL unless ``varies`` (both sides
    non-constant, decided exactly rather than from a rounded variance)."""
    cov = sxy - sx * sy / n
    vx = sxx - sx * sx / n
    vy = syy - sy * sy / n
    den = F.sqrt(vx) * F.sqrt(vy)
    return F.when(varies & (vx > 0) & (vy > 0), F.try_divide(cov, den))


def _question_model_cells(responses: DataFrame) -> DataFrame:
    """Sufficient statistics per (question, model): one partial aggregation over
    the responses that every per-question statistic is rolled up from."""
    df = responses.where(F.col("question").isNotNull() & F.col("model").isNotNull())
    ok = F.col("is_correct")
    conf, rt = F.col("confidence"), F.col("response_time")

    return df.groupBy("question", "model").agg(
        F.min("response_id").alias("first"),
        F.count(_ok()).alias("n"), F.sum(_ok()).alias("sx"),
        F.sum(conf).alias("s_conf"), F.count(conf).alias("n_conf"),
        F.sum(F.when(ok, conf)).alias("s_conf_ok"), F.count(F.when(ok, conf)).alias("n_conf_ok"),
        F.sum(F.when(~ok, conf)).alias("s_conf_bad"), F.count(F.when(~ok, conf)).alias("n_conf_bad"),
        F.sum(rt).alias("s_rt"), F.count(rt).alias("n_rt"),
        F.sum(F.when(ok, rt)).alias("s_rt_ok"), F.count(F.when(ok, rt)).alias("n_rt_ok"),
        F.sum(F.when(~ok, rt)).alias("s_rt_bad"), F.count(F.when(~ok, rt)).alias("n_rt_bad"))


def _discrimination_from_cells(j: DataFrame) -> list[Column]:
    """Aggregates over (question, model) cells joined with the model score ``y``."""
    return [F.sum("n").alias("_n"), F.sum("sx").alias("_sx"),
            F.sum(F.col("n") * F.col("y")).alias("_sy"),
            F.sum(F.col("n") * F.col("y") * F.col("y")).alias("_syy"),
            F.sum(F.col("sx") * F.col("y")).alias("_sxy"),
            F.min("y").alias("_ylo"), F.max("y").alias("_yhi")]


def _discrimination_col() -> Column:
    n, sx = F.col("_n"), F.col("_sx")
    return _pearson_from_sums(n, sx, F.col("_sy"), sx, F.col("_syy"), F.col("_sxy"),
                              (n > 1) & (sx > 0) & (sx < n) & (F.col("_ylo") < F.col("_yhi")))


def _cells_with_model_score(cells: DataFrame) -> DataFrame:
    """Attach the model's overall accuracy (a small table, broadcast by measured size)."""
    per_model = cells.groupBy("model").agg((F.sum("sx") / F.sum("n")).alias("y"))
    return join_bounded(cells, per_model, "model")


def item_discrimination(responses: DataFrame) -> DataFrame:
    """Pearson r between correctness on an item and the answering model's overall accuracy.

    The model's overall accuracy is constant within (question, model), so the
    correlation is assembled from (question, model) partial sums joined with a
    small per-model table.
    NULL for a single row, no variation in correctness, or a constant score.
    """
    cells = cut_lineage(_question_model_cells(responses))
    j = _cells_with_model_score(cells)
    return (j.groupBy("question").agg(*_discrimination_from_cells(j))
            .select("question", _discrimination_col().alias("discrimination")))


def item_analysis(responses: DataFrame) -> DataFrame:
    """One row per question text over all models and sets (14 columns).

    p_value, difficulty, discrimination, confidence and latency split by
    correctness, the most chosen wrong answer (ties: smallest text) and the
    subject of the first row (lowest response_id). Everything except the
    wrong-answer counts (a different grain) is rolled up from one
    (question, model) aggregate, materialised once.
    """
    cells = cut_lineage(_question_model_cells(responses))
    j = _cells_with_model_score(cells)

    def ratio(s, n):
        return F.sum(s) / F.sum(n)

    q = j.groupBy("question").agg(
        F.min("first").alias("response_id"),
        ratio("sx", "n").alias("p_value"),
        ratio("s_conf", "n_conf").alias("avg_confidence"),
        ratio("s_conf_ok", "n_conf_ok").alias("correct_confidence"),
        ratio("s_conf_bad", "n_conf_bad").alias("incorrect_confidence"),
        ratio("s_rt", "n_rt").alias("avg_response_time"),
        ratio("s_rt_ok", "n_rt_ok").alias("correct_time"),
        ratio("s_rt_bad", "n_rt_bad").alias("incorrect_time"),
        *_discrimination_from_cells(j))
    df = responses.where(F.col("question").isNotNull())
    wrong = value_counts_top1(df.where(~F.col("is_correct")), "question", "llm_answer")
    # the first response's subject is fetched by its id: a string minimum would sort all rows
    subjects = (df.join(q.select("question", "response_id"), ["question", "response_id"])
                .groupBy("question").agg(F.min("subject").alias("subject")))
    out = (q.withColumn("discrimination", _discrimination_col()).join(wrong, "question", "left")
           .join(subjects, "question", "left"))
    return out.select(
        "question",
        "subject",
        "p_value",
        (F.lit(1.0) - F.col("p_value")).alias("difficulty"),
        "discrimination",
        "avg_confidence", "correct_confidence", "incorrect_confidence",
        (F.col("correct_confidence") - F.col("incorrect_confidence")).alias(
            "confidence_discrimination"),
        "avg_response_time", "correct_time", "incorrect_time",
        F.coalesce(F.col("top_llm_answer"), F.lit("N/A")).alias("most_chosen_wrong"),
        F.coalesce(F.col("top_count"), F.lit(0).cast("long")).alias("wrong_count"),
    )


def bin_fixed(confidence: Column, n: int = N_BINS) -> Column:
    """Right-closed bins on [0, 100] with the lowest edge included: 0..n-1.

    Integer form of cutting confidence/100 at linspace(0, 1, n+1).
    """
    cut = F.ceil(confidence * n / F.lit(100.0)).cast("int") - 1
    return F.least(F.greatest(cut, F.lit(0)), F.lit(n - 1))


def bin_center(b: Column, n: int = N_BINS) -> Column:
    return (b.cast("double") * 2 + 1) / (2.0 * n)


def reliability_bins(responses: DataFrame, n: int = N_BINS) -> DataFrame:
    """Per (model, bin): n, accuracy and mean normalised confidence.

    Only rows with both a confidence and a correctness value take part.
    """
    df = responses.where(F.col("confidence").isNotNull() & F.col("is_correct").isNotNull()
                         & F.col("model").isNotNull())
    return (df.withColumn("bin", bin_fixed(F.col("confidence"), n))
            .groupBy("model", "bin")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.avg(_ok()).alias("accuracy"),
                 F.avg(F.col("confidence") / 100.0).alias("confidence"))
            .withColumn("bin_center", bin_center(F.col("bin"), n)))


def calibration_metrics(responses: DataFrame, n: int = N_BINS) -> DataFrame:
    """Per model: ECE over occupied bins, Brier score, mean confidence, accuracy,
    overconfidence. Accuracy here is over rows that carry a confidence."""
    df = responses.where(F.col("confidence").isNotNull() & F.col("is_correct").isNotNull()
                         & F.col("model").isNotNull())
    c = F.col("confidence") / 100.0
    per_bin = (df.withColumn("bin", bin_fixed(F.col("confidence"), n))
               .groupBy("model", "bin")
               .agg(F.count(F.lit(1)).alias("n"), F.sum(_ok()).alias("s_ok"),
                    F.sum(c).alias("s_c"), F.sum((c - _ok()) * (c - _ok())).alias("s_sq")))
    return (per_bin.groupBy("model")
            .agg(F.sum(F.col("n") * F.abs(F.col("s_c") / F.col("n") - F.col("s_ok") / F.col("n")))
                 .alias("_ece_num"),
                 F.sum("n").alias("_n"), F.sum("s_sq").alias("_sq"),
                 F.sum("s_c").alias("_c"), F.sum("s_ok").alias("_ok"))
            .select("model",
                    (F.col("_ece_num") / F.col("_n")).alias("ece"),
                    (F.col("_sq") / F.col("_n")).alias("brier_score"),
                    (F.col("_c") / F.col("_n")).alias("avg_confidence"),
                    (F.col("_ok") / F.col("_n")).alias("avg_accuracy"),
                    ((F.col("_c") - F.col("_ok")) / F.col("_n")).alias("overconfidence")))


def calibration_compare(calibration: DataFrame) -> DataFrame:
    """Chart data: ECE and overconfidence per model."""
    return calibration.select("model", "ece", "overconfidence")
