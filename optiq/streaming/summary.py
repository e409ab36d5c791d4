"""Incremental model x distractor-set summary over a stream of graded replies.

The batch summary (``operators.summary.model_distractor_summary``) answers
"how did each model do on each set"; here the same aggregates are kept per
event-time window as replies arrive. A watermark bounds the state: a window
is final (and its state dropped) once the watermark passes its end, so state
grows with the number of open windows, not with the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from optiq.plans.bindings import responses_from_events

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def read_event_stream(spark: SparkSession, path: str, glob: str = "events*.parquet",
                      max_files_per_trigger: int = 100) -> DataFrame:
    return (spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", max_files_per_trigger).parquet(path))


def windowed_summary(responses: DataFrame, window: str = "1 day",
                     watermark: str = "2 hours") -> DataFrame:
    """Per (event-time window, model, set): n, accuracy %, mean confidence and latency."""
    return (responses.withWatermark("ts", watermark)
            .groupBy(F.window("ts", window).alias("window"), "model", "distractor_set")
            .agg(F.count(F.lit(1)).alias("count"),
                 (F.avg(F.col("is_correct").cast("double")) * 100.0).alias("accuracy"),
                 F.avg("confidence").alias("avg_confidence"),
                 F.avg("response_time").alias("avg_response_time")))


def start_summary(spark: SparkSession, source: str, checkpoint: str, sink_path: str,
                  window: str = "1 day", watermark: str = "2 hours"):
    """Append finished windows as parquet; the checkpoint (in the shared folder)
    lets the query resume after a driver or executor loss."""
    summary = windowed_summary(responses_from_events(read_event_stream(spark, source)),
                               window, watermark)
    return (summary.writeStream.outputMode("append").format("parquet")
            .option("checkpointLocation", checkpoint).option("path", sink_path).start())


def graded_summary(spark: SparkSession, source: str, window: str = "1 day",
                   watermark: str = "2 hours") -> DataFrame:
    """Raw replies arriving as a stream are graded by the same Column
    functions as the batch path, then summarised per event-time window."""
    from optiq.plans.bindings import raw_responses_from_events
    from optiq.plans.evaluate import grade_replies
    graded = grade_replies(raw_responses_from_events(read_event_stream(spark, source)),
                           with_reasoning=False)
    return windowed_summary(graded, window, watermark)
