"""The streaming summary equals the batch aggregation on the same events."""

from pyspark.sql import functions as F

from optiq.plans import bindings as B
from optiq.session import scratch_path
from optiq.streaming import summary as ST

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark):
    stream = ST.windowed_summary(B.responses_from_events(ST.read_event_stream(spark, SF)))
    name = "optiq_stream_test"
    q = (stream.writeStream.outputMode("complete").format("memory").queryName(name)
         .option("checkpointLocation", scratch_path(spark, "stream-ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = spark.table(name)
    batch = (B.responses(spark, SF)
             .groupBy(F.window("ts", "1 day").alias("window"), "model", "distractor_set")
             .agg(F.count(F.lit(1)).alias("count")))
    a = {(r.window.start, r.model, r.distractor_set): r["count"] for r in got.collect()}
    b = {(r.window.start, r.model, r.distractor_set): r["count"] for r in batch.collect()}
    assert a == b and len(a) > 0


def test_graded_stream_matches_batch(spark):
    from optiq.plans import evaluate as EV
    stream = ST.graded_summary(spark, SF)
    name = "optiq_graded_stream_test"
    q = (stream.writeStream.outputMode("complete").format("memory").queryName(name)
         .option("checkpointLocation", scratch_path(spark, "stream-ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = {(r.window.start, r.model, r.distractor_set): (r["count"], round(r.accuracy, 9))
           for r in spark.table(name).collect()}
    g = EV.grade_replies(B.raw_responses(spark, SF), with_reasoning=False)
    batch = (g.groupBy(F.window("ts", "1 day").alias("window"), "model", "distractor_set")
             .agg(F.count(F.lit(1)).alias("n"),
                  (F.avg(F.col("is_correct").cast("double")) * 100.0).alias("acc")))
    want = {(r.window.start, r.model, r.distractor_set): (r.n, round(r.acc, 9))
            for r in batch.collect()}
    assert got == want and len(got) > 0
