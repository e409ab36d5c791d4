"""Tables behind the reference's figures (drawing itself is out of scope)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optiq.operators.reshape import melt


def item_scatter(items: DataFrame, difficulty_line: float = 0.5,
                 discrimination_line: float = 0.3) -> DataFrame:
    """Difficulty vs discrimination / time / confidence per item with the
    quadrant of the two reference lines."""
    return items.select(
        "question", "subject", "difficulty", "discrimination", "avg_response_time",
        "avg_confidence", "confidence_discrimination",
        (F.col("difficulty") > difficulty_line).alias("hard"),
        (F.col("discrimination") > discrimination_line).alias("discriminating"))


def title_case_metric(c):
    """'meteor_score_mean' -> 'Meteor Score'."""
    return F.initcap(F.replace(F.replace(c, F.lit("_mean"), F.lit("")), F.lit("_"), F.lit(" ")))


def metric_bars(agg: DataFrame, id_col: str = "distractor_type") -> DataFrame:
    """Long table of the per-type metric means with display names."""
    means = [c for c in agg.columns if c.endswith("_mean")]
    long = melt(agg, [id_col], means, "metric", "value")
    return long.withColumn("metric", title_case_metric(F.col("metric")))


def quality_vs_accuracy(joined: DataFrame) -> DataFrame:
    """Per-set scatter data: accuracy and time against mean quality metrics."""
    return joined.groupBy("distractor_set").agg(
        F.first("accuracy").alias("accuracy"), F.first("response_time").alias("response_time"),
        F.avg("meteor_scores").alias("meteor_scores"),
        F.avg("legal_relevance_scores").alias("legal_relevance_scores"),
        F.avg("grammar_scores").alias("grammar_scores"),
        F.avg("semantic_scores").alias("semantic_scores"),
        F.avg("diversity").alias("diversity"))
