"""Accuracy / confidence / latency summaries (one pass, partial aggregation).

All summaries are single ``groupBy``/``GROUPING SETS`` aggregations: the map
side combines rows before the shuffle, so a model or set holding a third of
all rows costs one partial-aggregate row per task, not a hot reducer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _acc(ok: str = "is_correct") -> Column:
    return F.avg(F.col(ok).cast("double"))


def _metric_aggs(rounded: bool) -> list[Column]:
    acc = _acc() * 100.0
    conf = F.avg("confidence")
    rt = F.avg("response_time")
    if rounded:
        acc, conf, rt = F.round(acc, 2), F.round(conf, 2), F.round(rt, 3)
    return [acc.alias("accuracy"), conf.alias("avg_confidence"),
            rt.alias("avg_response_time"), F.count(F.lit(1)).alias("count")]


def _calibration(rounded: bool) -> Column:
    cal = F.lit(1.0) - F.abs(_acc() - F.avg("confidence") / 100.0)
    return F.round(cal, 3) if rounded else cal


def model_summary(responses: DataFrame, rounded: bool = False) -> DataFrame:
    """Per model: accuracy %, mean confidence, mean latency, 1-|acc-conf|, count."""
    return (responses.where(F.col("model").isNotNull()).groupBy("model")
            .agg(*_metric_aggs(rounded), _calibration(rounded).alias("confidence_calibration")))


def distractor_summary(responses: DataFrame, rounded: bool = False) -> DataFrame:
    """Per distractor set: accuracy %, mean confidence, mean latency, count."""
    return (responses.where(F.col("distractor_set").isNotNull()).groupBy("distractor_set")
            .agg(*_metric_aggs(rounded)))


LEVELS = {0: "model_distractor_set", 1: "model", 2: "distractor_set", 3: "total"}


def _level(gid: Column) -> Column:
    expr = None
    for code, name in LEVELS.items():
        expr = (F.when(gid == code, F.lit(name)) if expr is None
                else expr.when(gid == code, F.lit(name)))
    return expr


def _cell_sums(responses: DataFrame) -> DataFrame:
    """Sufficient statistics at the finest grain (model, set): one partial
    aggregation over the responses; every coarser level is rolled up from it."""
    ok = F.col("is_correct").cast("double")
    return (responses.where(F.col("model").isNotNull() & F.col("distractor_set").isNotNull())
            .groupBy("model", "distractor_set")
            .agg(F.count(F.lit(1)).alias("n"), F.count(ok).alias("n_ok"), F.sum(ok).alias("s_ok"),
                 F.count("confidence").alias("n_conf"), F.sum("confidence").alias("s_conf"),
                 F.count("response_time").alias("n_rt"), F.sum("response_time").alias("s_rt")))


def model_distractor_summary(responses: DataFrame, rounded: bool = False) -> DataFrame:
    """The three summaries of the evaluator in ONE pass over the responses.

    The responses are aggregated once to (model, set) cells; GROUPING SETS
    ((model), (distractor_set), (model, distractor_set)) then runs on the cell
    table, so input rows are hashed once instead of once per grouping set.
    The level is read from grouping_id(), never inferred from NULL keys.
    Calibration is reported at the model level only, as in the reference.
    """
    cells = _cell_sums(responses)
    agg = cells.groupingSets(
        [["model"], ["distractor_set"], ["model", "distractor_set"]],
        "model", "distractor_set",
    ).agg(F.sum("n").alias("count"),
          (F.sum("s_ok") / F.sum("n_ok")).alias("_acc"),
          (F.sum("s_conf") / F.sum("n_conf")).alias("_conf"),
          (F.sum("s_rt") / F.sum("n_rt")).alias("_rt"),
          F.grouping_id().alias("_gid"))
    acc, conf, rt = F.col("_acc") * 100.0, F.col("_conf"), F.col("_rt")
    cal = F.lit(1.0) - F.abs(F.col("_acc") - F.col("_conf") / 100.0)
    if rounded:
        acc, conf, rt, cal = F.round(acc, 2), F.round(conf, 2), F.round(rt, 3), F.round(cal, 3)
    return agg.select(
        _level(F.col("_gid")).alias("level"), "model", "distractor_set",
        acc.alias("accuracy"), conf.alias("avg_confidence"), rt.alias("avg_response_time"),
        F.when(F.col("_gid") == 1, cal).alias("confidence_calibration"),
        "count")


def summary_cube(responses: DataFrame) -> DataFrame:
    """All four levels including the grand total (CUBE)."""
    df = responses.where(F.col("model").isNotNull() & F.col("distractor_set").isNotNull())
    agg = df.cube("model", "distractor_set").agg(
        *_metric_aggs(False), _calibration(False).alias("confidence_calibration"),
        F.grouping_id().alias("_gid"))
    return agg.select(_level(F.col("_gid")).alias("level"), "model", "distractor_set",
                      "accuracy", "avg_confidence", "avg_response_time",
                      "confidence_calibration", "count")


def set_summary(responses: DataFrame) -> DataFrame:
    """Legacy per-set summary: accuracy % over all rows, mean latency over non-null."""
    return (responses.where(F.col("distractor_set").isNotNull()).groupBy("distractor_set")
            .agg((_acc() * 100.0).alias("accuracy"),
                 F.avg("response_time").alias("response_time"),
                 F.count(F.lit(1)).alias("n_responses")))


def distractor_stats(responses: DataFrame) -> DataFrame:
    """Per (model, set): mean/count of correctness, mean/sd of confidence and latency,
    calibration error |acc - conf/100|. Standard deviations are sample (ddof 1)."""
    df = responses.where(F.col("model").isNotNull() & F.col("distractor_set").isNotNull())
    ok = F.col("is_correct").cast("double")
    return (df.groupBy("model", "distractor_set")
            .agg(F.avg(ok).alias("is_correct_mean"),
                 F.count(ok).alias("is_correct_count"),
                 F.avg("confidence").alias("confidence_mean"),
                 F.stddev_samp("confidence").alias("confidence_std"),
                 F.avg("response_time").alias("response_time_mean"),
                 F.stddev_samp("response_time").alias("response_time_std"))
            .withColumn("calibration_error",
                        F.abs(F.col("is_correct_mean") - F.col("confidence_mean") / 100.0)))


def conditional_mean(df: DataFrame, group, value: str, cond: Column) -> DataFrame:
    """Mean of ``value`` over rows where ``cond`` holds and where it does not."""
    keys = [group] if isinstance(group, str) else list(group)
    return df.groupBy(*keys).agg(
        F.avg(F.when(cond, F.col(value))).alias(f"{value}_when_true"),
        F.avg(F.when(~cond, F.col(value))).alias(f"{value}_when_false"))


def value_counts_top1(df: DataFrame, group: str, value: str,
                      none_value: str = "N/A") -> DataFrame:
    """Most frequent non-null ``value`` per group (ties: smallest value).

    Two partial aggregations (count per value, then min over (-count, value))
    replace sorting each group, so a hot group never lands in one task.
    """
    counts = (df.where(F.col(value).isNotNull()).groupBy(group, value)
              .agg(F.count(F.lit(1)).alias("_n")))
    best = counts.groupBy(group).agg(
        F.min(F.struct((-F.col("_n")).alias("neg"), F.col(value).alias("v"))).alias("_b"))
    return best.select(group, F.col("_b.v").alias(f"top_{value}"),
                       (-F.col("_b.neg")).alias("top_count"))


def fanout_means(joined: DataFrame) -> DataFrame:
    """Legacy means after the 1:N set -> question join.

    Row ``weighting='fanout'`` averages over the joined rows (the reference's
    number, which weights each set by its question count); row
    ``weighting='per_set'`` averages one value per set.
    """
    parity = joined.agg(F.avg("accuracy").alias("average_accuracy"),
                        F.avg("response_time").alias("average_response_time"))
    per_set = (joined.groupBy("distractor_set")
               .agg(F.first("accuracy", ignorenulls=True).alias("a"),
                    F.first("response_time", ignorenulls=True).alias("t"))
               .agg(F.avg("a").alias("average_accuracy"),
                    F.avg("t").alias("average_response_time")))
    return (parity.withColumn("weighting", F.lit("fanout"))
            .unionByName(per_set.withColumn("weighting", F.lit("per_set"))))
